"""Packing of ordered items into bins under budgets, and levels of reduction over them.

Greedy packing depends on all items before; where each bin would end is looked up for
all items at once (``cuts``), so no group lies in one task. Slices and fan-in are
arithmetic on places, which are counted over ranges of the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.cuts import bins, first_at, placed
from braidwork.operators.loops import written

#: How strongly the end of an item of a kind invites a cut. Fixed values.
CUT_STRENGTH = {"condition": 1, "choice": 2, "jump": 3, "return": 4, "ending": 4}

#: Places of a group that one task looks at side by side.
STRETCH = 10_000


def next_fit(df: DataFrame, group: str, order: str, sizes: dict[str, int], most_items: int) -> DataFrame:
    """(group, order, bin_no): items in order, a new bin where one more would pass ``most_items`` or a budget of ``sizes`` (column -> most).

    An item over a budget by itself raises an error. Bins count from 0.
    """
    for c, most in sizes.items():
        df = df.withColumn(c, F.when(F.col(c) <= most, F.col(c)).otherwise(F.raise_error(F.lit(f"an item has more {c} than a bin may hold")).cast("long")))
    rows = placed(df, group, order, *sizes)
    ends = rows.select("grp", "place", (F.col("place") + most_items).alias("next"))
    for c, most in sizes.items():  # the first item whose sum goes beyond
        over = first_at(rows.select("grp", "place", (F.col(f"before_{c}") + most + 1).alias("value")), rows.select("grp", F.col("place").alias("at"), F.col(f"sum_{c}").alias("value")), max(most, 1))
        ends = ends.join(over, ["grp", "place"]).select("grp", "place", F.least("next", "found").alias("next"))
    return _binned(rows, ends, group, order, "bin_no")


def boundary_split(df: DataFrame, group: str, order: str, size: str, boundary: str, target: int) -> DataFrame:
    """(group, order, chunk_no): a chunk ends after the first item with ``boundary`` once it holds half of ``target``, or once it holds ``target``."""
    rows = placed(df.withColumn("_edge", F.col(boundary).cast("long")), group, order, size, "_edge")
    items = rows.select("grp", F.col("place").alias("at"), (2 * F.col(f"sum_{size}")).alias("value"), "_edge")
    start = 2 * F.col(f"before_{size}")
    full = first_at(rows.select("grp", "place", (start + 2 * target).alias("value")), items.drop("_edge"), 2 * target)
    half = first_at(rows.select("grp", "place", (start + target).alias("value")), items.where("_edge = 1").drop("_edge"), 2 * target).withColumnRenamed("found", "edge")
    ends = full.join(half, ["grp", "place"]).select("grp", "place", (F.least("found", "edge") + 1).alias("next"))
    return _binned(rows, ends, group, order, "chunk_no")


def _binned(rows: DataFrame, ends: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Items with the number of their bin, from where each bin would end."""
    last = rows.groupBy("grp").agg(F.max("place").alias("last"))
    pointers = written(ends.join(last, "grp").select("grp", "place", F.when(F.col("next") <= F.col("last"), F.col("next")).alias("next")))
    return rows.join(bins(pointers), ["grp", "place"]).select(F.col("grp.g").alias(group), F.col("ord").alias(order), F.col("bin_no").alias(name))


def strong_cuts(df: DataFrame, group: str, order: str, kind: str, size: str, *, most_items: int = 120, most_size: int, reach: int = 24) -> DataFrame:
    """(group, order, chunk_no): chunks of at most ``most_items`` and ``most_size``, cut near their end after the item whose kind invites it most.

    Where one more item would not fit, the chunk ends after the item of the strongest kind of
    ``CUT_STRENGTH`` among the ``reach`` + 1 last ones, of equally strong ones the last; without
    one it is filled. What fits at the end stays whole. An item over ``most_size`` is a chunk of its own.
    """
    strength = F.coalesce(*[F.when(F.col(kind) == k, v) for k, v in CUT_STRENGTH.items()], F.lit(0))
    rows = placed(df.withColumn("_strength", strength), group, order, size, "_strength")
    over = first_at(rows.select("grp", "place", (F.col(f"before_{size}") + most_size + 1).alias("value")), rows.select("grp", F.col("place").alias("at"), F.col(f"sum_{size}").alias("value")), most_size)
    ends = over.select("grp", F.col("place").alias("start"), F.least(F.when(F.col("found").isNotNull(), F.greatest("found", F.col("place") + 1)), F.col("place") + most_items).alias("place"))
    last = F.collect_list(F.struct("_strength", "place")).over(W.partitionBy("grp", "into").orderBy("place").rowsBetween(-reach - 1, -1))
    near = _with_margin(rows, reach + 1).withColumn("last", last).where("NOT margin").select("grp", "place", "last")
    best = F.array_max(F.filter("last", lambda x: (x["place"] >= F.col("start")) & (x["_strength"] > 0)))
    cut = written(ends.join(near, ["grp", "place"]).select("grp", F.col("start").alias("place"), F.coalesce(best["place"] + 1, F.col("place")).alias("next")))
    pointers = written(rows.select("grp", "place").join(cut, ["grp", "place"], "left"))
    return rows.join(bins(pointers), ["grp", "place"]).select(F.col("grp.g").alias(group), F.col("ord").alias(order), F.col("bin_no").alias("chunk_no"))


def _with_margin(rows: DataFrame, n: int) -> DataFrame:
    """Rows of each stretch of ``STRETCH`` places and, with ``margin`` true, the last ``n`` of the stretch before, moved into it."""
    tail = rows.where(F.col("place") % STRETCH >= STRETCH - n).withColumn("into", F.floor(F.col("place") / STRETCH) + 1)
    own = rows.withColumn("into", F.floor(F.col("place") / STRETCH)).withColumn("margin", F.lit(False))
    return own.unionByName(tail.withColumn("margin", F.lit(True)))


def balanced_slices(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """(group, order, slice_no): as few slices of at most ``most`` items as there can be, their sizes one apart at most."""
    n = F.count("*").over(W.partitionBy(group))
    at = F.row_number().over(W.partitionBy(group).orderBy(order)) - 1
    return df.select(group, order, F.floor(at * F.ceil(n / most) / n).alias("slice_no"))


def fan_in_levels(df: DataFrame, group: str, most: int = 24) -> DataFrame:
    """(group, level, n_nodes): the sizes of the levels of a reduction that takes ``most`` nodes into one until one is left."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    levels = F.expr(f"filter(transform(sequence(0, 40), k -> named_struct('level', k, 'n', CAST(ceil(n / pow({most}, k)) AS BIGINT))), x -> x.level = 0 OR x.n > 1 OR ceil(n / pow({most}, x.level - 1)) > 1)")
    return counts.select(group, F.explode(levels).alias("x")).select(group, F.col("x.level").alias("level"), F.col("x.n").alias("n_nodes"))


def fan_in_parents(df: DataFrame, group: str, order: str, most: int = 24) -> DataFrame:
    """(group, order, level_1, level_2): the numbers of the nodes above an item on the first two levels. A group of any size is dealt to many tasks."""
    at = F.col("place")
    return placed(df, group, order).select(F.col("grp.g").alias(group), F.col("ord").alias(order), F.floor(at / most).alias("level_1"), F.floor(at / (most * most)).alias("level_2"))


def batch_outcome(expected: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(key, outcome): each expected item and each output is accepted, missing, duplicate or unexpected."""
    got = outputs.groupBy(key).agg(F.count("*").alias("n"))
    wanted = expected.select(key).distinct().withColumn("wanted", F.lit(True))
    outcome = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("accepted")
    return wanted.join(got, key, "full").select(key, outcome.alias("outcome"))


def pages(df: DataFrame, group: str, order: str, size: int = 30) -> DataFrame:
    """(group, order, page_no, place): items cut into pages of ``size``."""
    at = F.col("place")
    return placed(df, group, order).select(F.col("grp.g").alias(group), F.col("ord").alias(order), F.floor(at / size).alias("page_no"), (at % size).alias("place"))


def run_estimate(df: DataFrame, group: str, tokens: str, per_call: int, fan_in: int, price_per_million: int) -> DataFrame:
    """(group, n_calls, n_reductions, tokens, cost): calls by ceiling division, one reduction a node above them, integer cost rounded half up."""
    totals = df.groupBy(group).agg(F.sum(tokens).cast("long").alias("tokens"))
    calls = F.ceil(F.col("tokens") / per_call)
    n = totals.withColumn("n_calls", calls.cast("long"))
    above = F.expr(f"CAST(aggregate(transform(sequence(1, 40), k -> IF(ceil(n_calls / pow({fan_in}, k - 1)) > 1, CAST(ceil(n_calls / pow({fan_in}, k)) AS BIGINT), 0L)), 0L, (a, x) -> a + x) AS BIGINT)")
    cost = F.expr(f"(tokens * {price_per_million} + 500000) div 1000000")
    return n.select(group, "n_calls", above.alias("n_reductions"), "tokens", cost.alias("cost"))
