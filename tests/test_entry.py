import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_folders(tmp_path):
    for name in ("__spark_entry__.py", "braidwork"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sorted(set(o) - set(q)), [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'])"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split(" ", 1)
    assert int(said[0]) > 100 and said[1].strip() == "[] []"


def test_every_query_but_the_optional_ones_has_sql():
    import __spark_entry__

    own = [n for n in __spark_entry__.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"]
    assert set(own) == set(__spark_entry__.oracle_sql()) & set(own)
