"""Joins, windows, pages and set operations of the read model, each DataFrame to DataFrame."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def child_counts(parents: DataFrame, children: DataFrame, parent: str, child: str) -> DataFrame:
    """Each parent key with its number of children, zero included."""
    counts = children.groupBy(F.col(child).alias(parent)).agg(F.count("*").alias("child_count"))
    return parents.select(parent).join(counts, parent, "left").select(parent, F.coalesce("child_count", F.lit(0)).alias("child_count"))


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps ``n`` of a group in each task before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def runs(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Gaps and islands: (group, run_no, first, last, value, length) of consecutive rows with equal value."""
    w = W.partitionBy(group).orderBy(order)
    starts = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_start", starts)
    numbered = marked.withColumn("run_no", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(group, "run_no").agg(
        F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.first(value).alias("run_value"), F.count("*").alias("length")
    )


def prior_values(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Each row with the values of the rows before it in its group, joined by ``;`` (empty for the first)."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.array_join(F.collect_list(value).over(w), ";"), F.lit("")))


def keyset_page(df: DataFrame, order: list[str], after: tuple, limit: int) -> DataFrame:
    """The page of ``limit`` rows after the cursor, by all of ``order``, so ties at an edge are neither lost nor repeated."""
    cursor = list(zip(order, map(F.lit, after), strict=True))
    beyond = [functools.reduce(operator.and_, [*(F.col(c) == v for c, v in cursor[:i]), F.col(cursor[i][0]) > cursor[i][1]]) for i in range(len(cursor))]
    return df.where((F.col(order[0]) >= cursor[0][1]) & functools.reduce(operator.or_, beyond)).orderBy(*order).limit(limit)  # the first condition reaches the scan


def byte_page(df: DataFrame, group: str, order: str, size: str, cap: int) -> DataFrame:
    """Of each group, the rows from the first on whose sizes together stay within ``cap``."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(size).over(w)).where(F.col("cumulative") <= cap)


def ranked_search(df: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """(key, rank) of rows that hold the needle, in Unicode lower case: 0 equal, 4 prefix, 5 substring."""
    low, wanted = F.lower(text), needle.lower()
    rank = F.when(low == wanted, 0).when(F.startswith(low, F.lit(wanted)), 4).when(F.contains(low, F.lit(wanted)), 5)
    return df.select(key, rank.alias("match_rank")).where("match_rank IS NOT NULL")


def _whole(kinds: set[str], *columns: str) -> list[Column]:
    """Columns as whole numbers: days where all ``kinds`` are dates, microseconds where some are instants, else as they are."""
    if kinds == {"date"}:
        return [F.unix_date(c).cast("long") for c in columns]
    return [F.unix_micros(F.col(c).cast("timestamp")) if kinds & {"date", "timestamp", "timestamp_ntz"} else F.col(c).cast("long") for c in columns]


def dyadic_blocks(first: Column, last: Column) -> Column:
    """array<struct<level, block>>: the fewest blocks [block * 2^level, (block + 1) * 2^level) that make up first to last, at most two a level."""
    start = F.struct(first.alias("a"), (last + 1).alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(t: Column, level: Column) -> Column:
        going = t.a < t.b
        left, right = going & (t.a.bitwiseAND(1) == 1), going & (t.b.bitwiseAND(1) == 1) & (t.a + t.a.bitwiseAND(1) < t.b)
        block = lambda when, value: F.when(when, F.array(F.struct(level.cast("int").alias("level"), value.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
        a, b = F.when(left, t.a + 1).otherwise(t.a), F.when(right, t.b - 1).otherwise(t.b)
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), F.concat(t.out, block(left, t.a), block(right, t.b - 1)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, step, lambda t: t.out)


def innermost_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, ident: str) -> DataFrame:
    """Points inside an interval of the same keys, each with the tightest: latest start, then earliest end, then smallest id.

    Which of two intervals is the tighter does not depend on the point. So intervals are cut into
    dyadic blocks, of which each keeps its tightest, and a place (not each row of points with
    all its columns) meets one block a level however many intervals lie over it. Ends are inclusive; those before their start hold no point.
    """
    kinds = {points.schema[at].dataType.typeName(), intervals.schema[start].dataType.typeName(), intervals.schema[end].dataType.typeName()}
    (n,), (a, b) = _whole(kinds, at), _whole(kinds, start, end)
    rank = F.struct((-F.col("_a")).alias("a"), F.col("_b").alias("b"), F.col(ident).alias("ident"))
    cut = intervals.withColumns({"_a": a, "_b": b}).where("_a <= _b").withColumn("_x", F.explode(dyadic_blocks(F.col("_a"), F.col("_b"))))
    best = cut.groupBy(*keys, F.col("_x.level").alias("_level"), F.col("_x.block").alias("_block")).agg(F.min(rank).alias("_best"))
    levels = [r[0] for r in best.select("_level").distinct().collect()]  # 63 at most
    if not levels:
        return points.limit(0).withColumn("owner", F.lit(None).cast(intervals.schema[ident].dataType))
    placed = points.withColumn("_n", n)
    met = placed.select(*keys, "_n").distinct().withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_block", F.expr("shiftright(_n, _level)"))
    owners = met.join(best, [*keys, "_level", "_block"]).groupBy(*keys, "_n").agg(F.min("_best").alias("_best")).select(*keys, "_n", F.col("_best.ident").alias("owner"))
    return placed.join(owners, [*keys, "_n"]).groupBy(*points.columns, "_n").agg(F.min("owner").alias("owner")).drop("_n")


def merged_intervals(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, start, end, n) of overlapping or touching intervals put together."""
    w = W.partitionBy(group).orderBy(start, end)
    fresh = F.when(F.col(start) <= F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)), 0).otherwise(1)
    numbered = df.withColumn("_fresh", fresh).withColumn("_no", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(group, "_no").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_no")


def inventory_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, removed, changed or unchanged, from a full join on the key; null digests are equal to each other."""
    a = old.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def contradictions(facts: DataFrame, scope: list[str], value: str, ident: str) -> DataFrame:
    """(scope.., n_values, first_id, last_id) of scopes, nulls equal, that hold more than one value. Pairs are not spelled out."""
    return facts.groupBy(*scope).agg(
        F.count_distinct(value).alias("n_values"), F.min(ident).alias("first_id"), F.max(ident).alias("last_id")
    ).where("n_values > 1")
