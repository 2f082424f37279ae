"""Host-level quality rules, with DataFrame functions only.

Each document is tested by fixed rules. Failures are counted by host; each
host's failure rate is shrunk towards the rate of all hosts by a beta prior
whose strength is fitted to the spread of the hosts' rates; hosts whose shrunk
rate passes a limit lose all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.scratch import step, written

#: Rejected hosts up to which they are broadcast.
MOST_BROADCAST = 500_000

#: A host whose shrunk failure rate is above this share is rejected.
HOST_LIMIT = 0.6

_SPACE = r"[\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """How many words lie in five-word windows that occur twice or more; ``windows`` holds a hash for each start."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = _let(
        ranked,
        lambda s: F.transform(
            s, lambda e, j: F.when((e.h == F.get(s, j - 1).h) | (e.h == F.get(s, j + 1).h), e.i)
        ),
    )
    starts = F.sort_array(F.filter(starts, lambda i: i.isNotNull()))
    steps = _let(starts, lambda p: F.transform(p, lambda at, k: F.coalesce(F.least(F.get(p, k + 1) - at, F.lit(5)), F.lit(5))))
    return F.aggregate(steps, F.lit(0), lambda total, n: total + n)


def document_features(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and rules_failed.

    Null text counts as empty. Columns of ``docs`` with these names are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parsed = docs.withColumns(
        {
            "_words": F.filter(F.split(text, _SPACE + "+"), lambda w: w != ""),
            "_lines": F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x)),
        }
    )
    five = F.when(
        F.size("_words") >= 5,
        _let(F.col("_words"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.slice(w, i, 5)))),
    ).otherwise(F.array().cast("array<bigint>"))
    parsed = parsed.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, _SPACE + "+", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": five,
        }
    )
    parsed = parsed.withColumn(
        "n_repeat_words",
        F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(_covered(F.col("_windows"))).cast("long"),
    ).drop("_words", "_lines", "_windows")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    more = (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) | (F.col("word_chars") > 12 * F.col("n_words"))
    return parsed.withColumn("base_failed", failed).withColumn("rules_failed", failed | more)


def host_verdicts(features: DataFrame, *, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_rejected): from the counts of every document of each host. Null hosts get no verdict."""
    counts = features.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_host")).agg(
        F.count("*").alias("n"), F.sum(F.col("rules_failed").cast("long")).alias("failed")
    )
    rate = F.col("failed") / F.col("n")
    prior = counts.agg(
        (F.sum("failed") / F.sum("n")).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("spread")
    ).select("mean", F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.coalesce(F.try_divide(F.col("mean") * (1 - F.col("mean")), F.col("spread")) - 1, F.lit(1e6)))).alias("strength"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return counts.crossJoin(F.broadcast(prior)).select("_host", (shrunk > limit).alias("host_rejected"))  # one row of prior


def judged(features: DataFrame, *, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``features`` with ``kept``: false where base_failed or the host is rejected.

    ``features`` should be a written table: it is read for the hosts' counts and
    again for the verdicts. Only rejected hosts are joined back, by broadcast up
    to ``MOST_BROADCAST`` of them, so a large host stays in as many parts as it has.
    """
    rejected = written(host_verdicts(features, host=host, limit=limit).where("host_rejected"), name="rejected")
    rejected = F.broadcast(rejected) if rejected.count() <= MOST_BROADCAST else rejected
    joined = features.join(rejected, features[host] == rejected["_host"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).drop("_host", "host_rejected")


def without_rejected(docs: DataFrame, *, limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs``(doc_id, text, source, ..) that ``judged`` keeps, with their own columns alone.

    Null and empty texts fail (they have under ten words). Repeated rows are
    judged alike; a null source gets no verdict as a host; an empty table gives
    none. Columns of ``docs`` may have any names: rows are carried whole.
    """
    key = F.xxhash64("doc_id", "text", "source")
    slim = docs.select(key.alias("key"), F.col("text").alias("text"), F.col("source").alias("source"))
    with step() as keep:
        features = written(document_features(slim).select("key", "source", "base_failed", "rules_failed"), name="features")
        bad = written(judged(features, limit=limit).where("NOT kept").select("key").distinct(), name="bad")
        keep(bad)
    bad = F.broadcast(bad) if bad.count() <= MOST_BROADCAST else bad
    return docs.select(key.alias("key"), F.struct("*").alias("row")).join(bad, "key", "left_anti").select("row.*")
