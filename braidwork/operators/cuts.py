"""Greedy cuts of long sequences without a fold: where a bin that begins at an item would end, for every item at once, and then which items begin one.

Ends are found by looking sums up among sums. That an item begins a bin is known by
following pointers from the first item on; pointers are doubled, so a group with n
bins takes about log n joins, and a group of any length is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.loops import written
from braidwork.operators.ordered import ordered

_KEY = ["grp", "place"]


def placed(df: DataFrame, group: str, order: str, *sizes: str) -> DataFrame:
    """(grp, ord, place, before_c, sum_c, ..): items of each group numbered from 0 in order, with the sums of whole-number sizes before and up to each. Written.

    grp holds the group as ``g``: structs join where both hold null, too.
    """
    rows = df.select(F.struct(F.col(group).alias("g")).alias("grp"), F.col(order).alias("ord"), F.xxhash64(group).alias("mark"), *[F.col(c).cast("long").alias(c) for c in sizes])
    found = ordered(rows, "mark", "grp", "ord", segment="mark", sums=sizes).drop("mark", "rank")
    return written(found.withColumns({f"before_{c}": F.col(f"sum_{c}") - F.col(c) for c in sizes}))


def first_at(queries: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """queries(grp, place, value), items(grp, at, value) -> (grp, place, found): the first item whose value is that of the query or more, null if none is.

    Values don't fall with ``at``. Both sides are dealt to stretches of ``width``; a query
    looks in its own stretch, then at the first item of the stretches after it.
    """
    stretch = F.floor(F.col("value") / width).alias("stretch")
    none = F.lit(None).cast("long")
    both = queries.select("grp", stretch, "value", "place", none.alias("at")).unionByName(items.select("grp", stretch, "value", none.alias("place"), F.col("at").cast("long").alias("at")))
    down = W.partitionBy("grp", "stretch").orderBy(F.desc("value"), F.col("place").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = both.withColumn("found", F.min("at").over(down)).where("place IS NOT NULL")
    later = W.partitionBy("grp").orderBy(F.desc("stretch")).rowsBetween(W.unboundedPreceding, -1)
    far = both.groupBy("grp", "stretch").agg(F.min("at").alias("first")).withColumn("far", F.min("first").over(later)).select("grp", "stretch", "far")
    return near.join(far, ["grp", "stretch"], "left").select("grp", "place", F.coalesce("found", "far").alias("found"))


def bins(pointers: DataFrame) -> DataFrame:
    """pointers(grp, place, next) -> (grp, place, bin_no): bins begin at place 0 and wherever a pointer leads from the beginning of another; null ends a group."""
    jumps = written(pointers.select("grp", "place", "next").where("next IS NOT NULL"))
    steps = []
    while not jumps.where("place = 0").isEmpty():
        steps.append(jumps)
        on = jumps.select("grp", F.col("place").alias("next"), F.col("next").alias("after"))
        jumps = written(jumps.join(on, ["grp", "next"]).select("grp", "place", F.col("after").alias("next")))
    begins = written(pointers.where("place = 0").select(*_KEY))
    for jump in reversed(steps):
        begins = written(begins.unionByName(begins.join(jump, _KEY).select("grp", F.col("next").alias("place"))))
    marked = pointers.select(*_KEY).join(begins.withColumn("begins", F.lit(1).cast("long")), _KEY, "left")
    flags = marked.select("grp", F.col("place").alias("item"), F.coalesce("begins", F.lit(0)).alias("begins"), F.xxhash64("grp").alias("mark"))
    counted = ordered(flags, "mark", "grp", "item", segment="mark", sums=("begins",))
    return counted.select("grp", F.col("item").alias("place"), (F.col("sum_begins") - 1).alias("bin_no"))
