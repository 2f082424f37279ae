"""Temperature mixing of sources, with DataFrame functions only.

Source shares of tokens are raised to an exponent between 0 (even) and 1 (as
found) and normalised. The exponent is bisected, on counts by source, to reach a
target entropy without repeating any source more often than a limit. Each
source's budget is then dealt as passes over a permutation of blocks of its
documents; only the last pass is cut. The place of the cut is found from the
words of ever narrower blocks, so no task orders a source's documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.llm.scratch import written

#: Share of the highest possible entropy (all sources even) to reach.
ENTROPY = 0.95

#: Passes over a source, at most.
REPEATS = 4.0

#: A pass is a permutation by a hash; so many of its leading bits number the blocks, and so many more at a time find the place of a cut.
BLOCK_BITS, LEVELS = 12, 3

#: Sources, or blocks of sources, up to which their table is broadcast.
MOST_BROADCAST = 500_000

#: Exponents tried at once in each step of the search, and steps.
_WAYS, _STEPS = 32, 4


def counted(docs: DataFrame, *, without: tuple[str, ...] = ()) -> DataFrame:
    """(row, source, n, key): each row of ``docs`` that has words, as a struct of its columns, with their number. Written.

    The texts are read here alone; columns named in ``without`` are not kept.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    row = F.struct(*[c for c in docs.columns if c not in without])
    return written(docs.select(row.alias("row"), F.col("source").alias("source"), n.alias("n"), F.xxhash64("doc_id", text).alias("key")).where("n > 0"), name="counted")


def source_totals(rows: DataFrame) -> DataFrame:
    """(source, words, documents) over every row of ``counted``; null is a source of its own."""
    return written(rows.groupBy("source").agg(F.sum("n").alias("words"), F.count("*").alias("documents")), name="sources")


def exponent(totals: DataFrame, *, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The largest exponent with the wanted entropy, raised to where no source repeats too often; 1 if that is met as found."""
    whole = totals.agg(F.sum("words").cast("double").alias("total"), F.count("*").alias("n")).first()
    if not whole.n or whole.n == 1:
        return 1.0
    shares = totals.select((F.col("words") / F.lit(whole.total)).alias("p"))

    def search(good) -> tuple[float, float]:
        """The bracket around the largest exponent of which ``good`` holds; good holds from 0 up to it."""
        low, high = 0.0, 1.0
        for _ in range(_STEPS):
            tried = [low + (high - low) * i / _WAYS for i in range(_WAYS + 1)]
            curve = (
                shares.withColumn("e", F.explode(F.array(*map(F.lit, tried))))
                .groupBy("e")
                .agg(F.sum(F.pow("p", "e")).alias("z"), F.sum(F.pow("p", "e") * F.log("p")).alias("l"), F.max(F.pow("p", F.col("e") - 1)).alias("m"))
                .select("e", (F.log("z") - F.col("e") * F.col("l") / F.col("z")).alias("entropy"), (F.col("m") / F.col("z")).alias("repeats"))
            )
            met = {r.e: good(r) for r in curve.collect()}  # a row an exponent
            if met[tried[-1]]:
                return tried[-1], tried[-1]
            k = max([i for i, e in enumerate(tried) if met[e]], default=0)
            low, high = tried[k], tried[k + 1]
        return low, high

    wanted = entropy * math.log(whole.n)
    even, _ = search(lambda r: r.entropy >= wanted - 1e-12)
    _, sparing = search(lambda r: r.repeats > repeats)
    return min(1.0, max(even, sparing if sparing > 1 / _WAYS**_STEPS else 0.0))


def plan(totals: DataFrame, e: float, *, budget: int | None = None) -> DataFrame:
    """(source, words, weight, budget, passes): passes is how often the budget covers the source."""
    whole = totals.agg(F.sum(F.pow(F.col("words").cast("double"), F.lit(e))).alias("z"), F.sum("words").alias("total")).first()
    weight = F.pow(F.col("words").cast("double"), F.lit(e)) / F.lit(whole.z or 1.0)
    return (
        totals.withColumn("weight", weight)
        .withColumn("budget", F.round(F.col("weight") * F.lit(budget or whole.total or 0)).cast("long"))
        .withColumn("passes", F.col("budget") / F.col("words"))
    )


def _block(level: int):
    """The number of a place's block, or of its part within the blocks of the levels before."""
    return F.pmod(F.shiftrightunsigned("place", 64 - BLOCK_BITS * (level + 1)), F.lit(1 << BLOCK_BITS))


def _cut(last: DataFrame) -> DataFrame:
    """The rows of last passes that fit; last(source, place, key, n, room, row, ..), room being the words that a source's pass may take.

    Rows come in the order of their places, and one is taken while the words
    before it are less than room. Words are summed by block, then by part of the
    block that room ends in, and so on: what is ordered is what shares the last
    part with the cut.
    """
    taken, rest = [], last
    before = W.partitionBy("source").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    for level in range(LEVELS):
        rest = rest.withColumn("at", _block(level))
        sizes = rest.groupBy("source", "at").agg(F.sum("n").alias("size"), F.first("room").alias("room"))  # 4096 rows a source
        sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where("before < room")
        sizes = written(sizes.select(F.col("source").alias("s"), F.col("at").alias("b"), (F.col("room") - F.col("before")).alias("left"), (F.col("before") + F.col("size") <= F.col("room")).alias("whole")), name="blocks")
        met = rest.join(F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("b")))
        taken.append(met.where("whole").drop("s", "b", "left", "whole", "at"))
        rest = met.where("NOT whole").withColumn("room", F.col("left")).drop("s", "b", "left", "whole", "at")
    inside = W.partitionBy("source").orderBy(F.shiftrightunsigned("place", 1), "place", "key").rowsBetween(W.unboundedPreceding, -1)
    out = rest.withColumn("sum", F.coalesce(F.sum("n").over(inside), F.lit(0))).where("sum < room").drop("sum")
    for part in taken:
        out = out.unionByName(part)
    return out


def mixed(docs: DataFrame, *, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs``, once for each pass that takes them, with pass_no, block_no, place and n_words.

    Sorting by pass_no, block_no, place (as an unsigned number) gives the mixing
    order of a source. The budget is ``budget`` words, by default as many as
    ``docs`` has. A source's last pass takes whole documents while the words
    before them are under its budget. Documents without words or text are left
    out: they have no tokens to deal; so an empty table gives none. Null is a
    source of its own; repeated rows are dealt each on its own, side by side.
    Columns of ``docs`` keep their names and values; of the four added ones,
    those whose names it has already are left out. Columns in ``without`` go.
    """
    rows = counted(docs, without=without)
    totals = source_totals(rows)
    plans = plan(totals, exponent(totals, entropy=entropy, repeats=repeats), budget=budget)
    named = written(plans.select(F.col("source").alias("s"), "words", "budget", "passes"), name="plans")
    named = F.broadcast(named) if named.count() <= MOST_BROADCAST else named
    passes = rows.join(named, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil("passes").cast("long") - 1, F.lit(0).cast("long"))))
    )
    dealt = passes.withColumn("place", F.xxhash64("key", "pass_no")).withColumn("room", F.col("budget") - F.col("pass_no") * F.col("words"))
    dealt = dealt.select("row", "source", "n", "key", "pass_no", "place", "room", (F.col("room") >= F.col("words")).alias("full"))
    found = dealt.where("full").unionByName(_cut(dealt.where("NOT full")))
    added = {"pass_no": F.col("pass_no"), "block_no": _block(0), "place": F.col("place"), "n_words": F.col("n")}
    kept = [c.lower() for c in docs.columns if c not in without]
    return found.select("row", *[v.alias(k) for k, v in added.items() if k not in kept]).select("row.*", *[k for k in added if k not in kept])
