"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Features are runs of 1 to n words. Their strings are counted over all texts; each
distinct string is hashed to a bucket once, buckets are summed, and what a
bucket gains joins back, through the dictionary, to the features of each document.

A join on feature strings would be as skewed as words are. The ``COMMON`` most
frequent strings (a bounded table) are therefore looked up where a document is read;
only the rarer ones of a document are dealt by string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import textops
from braidwork.llm.linking import left_join
from braidwork.llm.ordered import ordered
from braidwork.llm.scratch import step, written

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"

#: Strings looked up from a broadcast table, the most frequent ones; a string must also stand this often in the texts.
COMMON, COMMON_TIMES = 200_000, 20

#: Bytes that separate words: ASCII but for letters and digits.
SEPARATES = np.zeros(256, dtype=bool)
SEPARATES[:128] = True
SEPARATES[48:58] = SEPARATES[65:91] = SEPARATES[97:123] = False

_U = np.uint64


def _folded(column: pa.Array) -> pa.Array:
    """Separators become one blank each and A-Z a-z, so that a feature's words stand between single blanks unless separators repeat."""
    raw, at = textops.buffers(column)
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[SEPARATES] = 32
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(table[raw]))


def _features(texts: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length k up to ``most``: k, feature hashes, rows, first and last byte of each; and the folded bytes."""
    folded = _folded(texts)
    hashes, starts, ends, first = textops.words(folded, space=SEPARATES)
    raw = textops.buffers(folded)[0]
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    for k in range(1, most + 1):
        n = max(len(hashes) - k + 1, 0)
        whole = row[: n or None][:n] == row[k - 1 : k - 1 + n]
        value = np.zeros(n, _U)
        for i in range(k):
            value = textops.mix(value * _U(0x9E3779B97F4A7C15) + hashes[i : i + n]) if k > 1 else hashes[:n]
        yield k, value[whole], row[:n][whole], starts[:n][whole], ends[k - 1 : k - 1 + n][whole], raw


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The features between these bytes, their words joined by one blank."""
    data = raw.tobytes()
    return [" ".join(filter(None, data[a:b].decode().split(" "))) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _counted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in textops.pieces(batch.column(0), 1 << 22):
                for _, hashes, _, starts, ends, raw in _features(texts, most):
                    distinct, at, n = np.unique(hashes, return_index=True, return_counts=True)
                    if len(distinct):
                        yield pa.RecordBatch.from_arrays([pa.array(_strings(raw, starts[at], ends[at])), pa.array(distinct.view(np.int64)), pa.array(n)], names=["feature", "mark", "n"])

    return run


def feature_counts(texts: DataFrame, most: int) -> DataFrame:
    """(feature, mark, n): every distinct run of 1 to ``most`` words of texts(text), a hash of it, and how often it stands. Null texts have none."""
    parts = texts.select("text").mapInArrow(_counted(most), "feature string, mark long, n long")
    return parts.groupBy("feature").agg(F.first("mark").alias("mark"), F.sum("n").alias("n"))


def _bucketed(counts: DataFrame, buckets: int) -> DataFrame:
    return counts.withColumn("bucket", F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from two feature dictionaries: floor(1000 ln of the smoothed shares' ratio)."""
    summed = lambda counts, name: counts.groupBy("bucket").agg(F.sum("n").alias(name))
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(F.broadcast(summed(source, "s")), "bucket", "left").join(F.broadcast(summed(target, "t")), "bucket", "left").na.fill(0, ["s", "t"])
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * F.lit(float(all_s + buckets))) / ((d("s") + 1) * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _weighed(most: int, table: tuple[np.ndarray, np.ndarray]):
    """Rows (row, doc_id, text) -> (row, doc_id, n_words, n_features, gained, rare): the gain of features in ``table``, and the others with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = table.value
        for batch in batches:
            for start, texts in textops.pieces(batch.column(2), 1 << 22):
                n = len(texts)
                n_words, n_features, gained = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                rare_rows, rare_texts, rare_n = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
                for k, hashes, rows, starts, ends, raw in _features(texts, most):
                    count = np.bincount(rows, minlength=n)
                    n_words, n_features = count if k == 1 else n_words, n_features + count
                    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                    common = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                    # sums of whole numbers below 2**53 are exact in doubles
                    gained += np.bincount(rows[common], weights=gain[at[common]], minlength=n).astype(np.int64) if common.any() else 0
                    left = np.flatnonzero(~common)
                    order = left[np.lexsort((hashes[left], rows[left]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]])
                    heads = np.flatnonzero(new)
                    rare_rows.append(rows[order[heads]])
                    rare_n.append(np.diff(np.append(heads, len(order))))
                    rare_texts += _strings(raw, starts[order[heads]], ends[order[heads]])
                rows, times = np.concatenate(rare_rows), np.concatenate(rare_n)
                order = np.argsort(rows, kind="stable")
                pairs = pa.StructArray.from_arrays([pa.array(rare_texts, pa.string()).take(pa.array(order)), pa.array(times[order])], names=["feature", "times"])
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order], np.arange(n + 1)), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([*(c.slice(start, n) for c in batch.columns[:2]), pa.array(n_words), pa.array(n_features), pa.array(gained), rare], names=["row", "doc_id", "n_words", "n_features", "gained", "rare"])

    return run


def weights(docs: DataFrame, target: DataFrame, *, most: int = 1, buckets: int = BUCKETS, common: int = COMMON) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of docs: the floored mean of its features' gains, 0 where it has none. Written."""
    spark: SparkSession = docs.sparkSession
    with step() as keep:
        counts = written(_bucketed(feature_counts(docs, most), buckets), name="features", release=True)
        gained = written(gains(counts, _bucketed(feature_counts(target, most), buckets), buckets), name="gains")
        dictionary = counts.join(F.broadcast(gained), "bucket").select("feature", "mark", "n", "gain")
        # common strings that share a mark are left to the join on strings
        top = dictionary.where(F.col("n") >= COMMON_TIMES).orderBy(F.desc("n"), "feature").limit(common)
        top = written(top.groupBy("mark").agg(F.count("*").alias("alike"), F.max("gain").alias("gain"), F.max("feature").alias("feature")).where("alike = 1"), name="common")
        found = top.select("mark", "gain").toArrow()
        known, gain = found.column("mark").to_numpy().astype(np.int64).view(_U), found.column("gain").to_numpy().astype(np.int64)
        order = np.argsort(known)
        table = spark.sparkContext.broadcast((known[order], gain[order]))
        numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
        told = written(numbered.mapInArrow(_weighed(most, table), f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, gained long, rare array<struct<feature string, times long>>"), name="told")
        rare = told.select("row", F.explode("rare").alias("r")).select("row", "r.feature", "r.times")
        rest = left_join(rare, dictionary.select("feature", "gain", "n"), "feature", "n").groupBy("row").agg(F.sum(F.col("gain") * F.col("times")).alias("rest"))
        mean = F.when(F.col("n_features") > 0, F.expr("(gained + coalesce(rest, 0) - pmod(gained + coalesce(rest, 0), n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
        found = written(told.drop("rare").join(rest, "row", "left").select("doc_id", "n_words", "n_features", mean.alias("weight")), name="weights")
        keep(found)
    return found


def resampled(docs: DataFrame, target: DataFrame, *, most: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs(doc_id, text), drawn towards target(text) without replacement.

    score adds Gumbel noise from a hash of ``seed`` and doc_id to the weight; of the rows
    with ``least_words`` words or more, that percentage with the highest scores is drawn and
    ranked from 1, ties by the smaller doc_id. Null and empty texts have no feature and
    weight 0. A null doc_id is hashed as an empty one and comes first among ties; rows
    that tie in all are drawn in any order. Empty tables: no rows; no target: gains are of the smoothing alone.
    """
    known = weights(docs, target, most=most, buckets=buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(known.withColumn("score", F.col("weight") + noise), name="scored")
    enough = scored.where(F.col("n_words") >= least_words)
    n_drawn = percent * enough.count() // 100
    drawn = ordered(enough.select("doc_id", "n_features", "weight", "score"), F.desc("score"), F.asc_nulls_first("doc_id"), name="drawn")
    place = F.when(F.col("rank") < n_drawn, F.col("rank") + 1)
    rest = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.select("doc_id", "n_features", "weight", "score", place.alias("rank")).unionByName(rest)
