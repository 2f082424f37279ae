"""Versions of stored rows: refresh, reuse, checkpoints, edits, leases and what they cost.

Stores are plain tables: a state is the table of its latest rows, a change is a
new table. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: To which states a checkpoint may go. Fixed values.
TRANSITIONS = {
    "pending": ("cached", "in_flight", "cancelled"),
    "cached": ("validated", "fallback", "failed"),
    "in_flight": ("validated", "fallback", "failed", "cancelled"),
    "validated": ("validated",),
    "fallback": ("cached", "in_flight", "fallback"),
    "failed": ("cached", "in_flight", "cancelled"),
    "cancelled": ("cached", "in_flight", "cancelled"),
}


def refreshed(old: DataFrame, new: DataFrame, diff: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` for keys that were added or changed, of ``old`` for unchanged ones; diff(key, status)."""
    fresh = diff.where("status IN ('added', 'changed')").select(key)
    same = diff.where("status = 'unchanged'").select(key)
    return new.join(fresh, key, "left_semi").unionByName(old.join(same, key, "left_semi"))


def without_dependants(rows: DataFrame, dependencies: DataFrame, diff: DataFrame, key: str) -> DataFrame:
    """``rows``(key, ..) but for those that depend, by dependencies(key, needs), on a key that changed or went."""
    stale = diff.where("status IN ('changed', 'removed')").select(F.col(key).alias("needs"))
    affected = dependencies.join(stale, "needs", "left_semi").select(key).distinct()
    return rows.join(affected, key, "left_anti")


def checkpoints(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """old(key, digest, status), new(key, digest) -> (key, digest, status, kept): a validated scope stays if its input is the same; others begin anew, vanished ones go."""
    held = old.select(key, F.col(digest).alias("_was"), F.col("status").alias("_status"))
    joined = new.select(key, digest).join(held, key, "left")
    kept = F.coalesce(F.col("_was").eqNullSafe(F.col(digest)) & (F.col("_status") == "validated"), F.lit(False))
    return joined.select(key, digest, F.when(kept, "validated").otherwise("pending").alias("status"), kept.alias("kept"))


def transitions(events: DataFrame, key: str, order: str, status: str, start: str = "pending") -> DataFrame:
    """Each event with ``previous`` and whether ``TRANSITIONS`` allows the step; the first follows ``start``."""
    before = F.coalesce(F.lag(status).over(W.partitionBy(key).orderBy(order)), F.lit(start))
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return events.withColumn("previous", before).withColumn("allowed", F.coalesce(F.array_contains(F.element_at(allowed, F.col("previous")), F.col(status)), F.lit(False)))


def overlaid(base: DataFrame, edits: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``base`` with the latest edit of each key laid over it, edit by edit column; a null edit leaves the base's value."""
    latest = edits.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns])
    joined = base.join(latest, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def orphaned(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Edits whose target is gone."""
    return edits.join(base.select(key), key, "left_anti")


def applied_draft(current: DataFrame, candidate: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Pinned rows of ``current``, and the rows of ``candidate`` but for pinned keys, numbered anew by ``order``."""
    pinned = current.where("pinned")
    both = pinned.unionByName(candidate.join(pinned.select(key), key, "left_anti"))
    place = W.partitionBy("scope").orderBy(*order)
    return both.withColumn("position", F.row_number().over(place) - 1)


def published(versions: DataFrame, group: str, order: str) -> DataFrame:
    """The latest complete version of each group: what a reader sees while a newer one is being written."""
    ready = versions.where("complete")
    latest = ready.groupBy(group).agg(F.max(order).alias(order))
    return ready.join(latest, [group, order], "left_semi")


def reusable(previous: DataFrame, current: DataFrame, phase: str, digest: str) -> DataFrame:
    """(phase, reuse): a phase's result holds if its digest and those of all phases before it are what they were; phases are in order of name."""
    joined = current.select(phase, digest).join(previous.select(phase, F.col(digest).alias("_was")), phase, "left")
    same = F.coalesce(F.col(digest) == F.col("_was"), F.lit(False))
    return joined.select(phase, F.min(same.cast("int")).over(W.orderBy(phase).rowsBetween(W.unboundedPreceding, 0)).cast("boolean").alias("reuse"))  # a row a phase


def lease_outcomes(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs(.., status, expires, cancel_requested) -> expired ones with ``outcome``: indeterminate if something may have been sent, else cancelled or pending."""
    sent = F.col("status").isin("submitting", "transmitting")
    outcome = F.when(sent, "indeterminate").when(F.col("cancel_requested"), "cancelled").otherwise("pending")
    return jobs.where(F.col("expires") <= now).withColumn("outcome", outcome)


def claimable(jobs: DataFrame, group: str, priority: list[Column], slots: int) -> DataFrame:
    """Pending jobs of each group that free slots would take, by priority: ``slots`` less those running."""
    running = jobs.where("status = 'running'").groupBy(group).agg(F.count("*").alias("_running"))
    waiting = jobs.where("status = 'pending'").withColumn("claim", F.row_number().over(W.partitionBy(group).orderBy(*priority)))
    return waiting.join(running, group, "left").where(F.col("claim") + F.coalesce("_running", F.lit(0)) <= slots).drop("_running")


def usage(attempts: DataFrame, group: str, tokens: str, budget: int) -> DataFrame:
    """(group, n_attempts, tokens, left, over): what attempts used of a budget."""
    used = F.sum(F.coalesce(tokens, F.lit(0)))
    return attempts.groupBy(group).agg(F.count("*").alias("n_attempts"), used.cast("long").alias("tokens")).withColumn("left", F.greatest(F.lit(0), budget - F.col("tokens")).cast("long")).withColumn("over", F.col("tokens") > budget)


def ledger(attempts: DataFrame, group: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """Attempts in order with ``spent``, the running total, and whether it still is within the budget."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return attempts.withColumn("spent", F.sum(tokens).over(w)).withColumn("within", F.col("spent") <= budget)


def run_status(children: DataFrame, group: str, status: str) -> DataFrame:
    """(group, run_status) from the statuses of a run's children: failed before running before pending before done."""
    has = lambda s: F.bool_or(F.col(status) == s)
    derived = F.when(has("failed"), "failed").when(has("running"), "running").when(has("pending"), "pending").otherwise("done")
    return children.groupBy(group).agg(derived.alias("run_status"))
