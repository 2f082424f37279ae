"""braidwork: branching-narrative graph analytics as PySpark DataFrame operators."""
