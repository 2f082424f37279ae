"""Models over nodes, edges and facts: integrity, scenes, quotient edges, evidence, statuses and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.cuts import placed
from braidwork.operators.loops import written


def integrity_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node, n_evidence), edges(id, src, dst) -> (kind, ref): duplicate_node, unknown_source, unknown_target, without_evidence."""
    text = lambda c: F.col(c).cast("string").alias("ref")
    known = nodes.select("node").distinct()
    twice = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_node").alias("kind"), text("node"))
    lost = [edges.join(known.withColumnRenamed("node", end), end, "left_anti").select(F.lit(kind).alias("kind"), text("id")) for end, kind in (("src", "unknown_source"), ("dst", "unknown_target"))]
    bare = nodes.where("n_evidence = 0").select(F.lit("without_evidence").alias("kind"), text("node"))
    return twice.unionByName(lost[0]).unionByName(lost[1]).unionByName(bare)


def scenes(atoms: DataFrame, scope: str, order: list[str], accepted: str) -> DataFrame:
    """(scope, scene_no, first_at, last_at, n_atoms): atoms in order, a new scene at each accepted boundary."""
    w = W.partitionBy(scope).orderBy(*order)
    number = F.sum(F.col(accepted).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = atoms.withColumn("scene_no", number)
    return rows.groupBy(scope, "scene_no").agg(F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count("*").alias("n_atoms"))


def corrected(boundaries: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """boundaries(key, accepted), corrections(key, action: split or merge) -> (key, accepted, status): applied where it changes one, rejected where it does not, orphaned without a boundary."""
    joined = boundaries.select(key, "accepted", F.lit(True).alias("_known")).join(corrections.select(key, "action"), key, "full")
    wanted = F.when(F.col("action") == "split", True).when(F.col("action") == "merge", False)
    status = F.when(F.col("_known").isNull(), "orphaned").when(F.col("action").isNull(), "none").when(wanted == F.col("accepted"), "rejected").otherwise("applied")
    return joined.select(key, F.when(F.col("_known").isNotNull(), F.coalesce(wanted, "accepted")).alias("accepted"), status.alias("status"))


def capped_evidence(edges: DataFrame, keys: list[str], evidence: str, most: int = 60) -> DataFrame:
    """(keys.., n, evidence): the first ``most`` of the sorted distinct evidence of each group, and how much there is."""
    items = written(edges.select(*keys, evidence).distinct())
    first = placed(items.withColumn("_key", F.struct(*keys)), "_key", evidence).where(F.col("place") < most)
    shown = first.groupBy("grp").agg(F.array_sort(F.collect_list("ord")).alias("shown")).select(*[F.col(f"grp.g.{k}").alias(k) for k in keys], "shown")
    return items.groupBy(*keys).agg(F.count("*").alias("n")).join(shown, keys).select(*keys, "n", F.array_join(F.col("shown").cast("array<string>"), ",").alias("evidence"))


def claim_evidence(claims: DataFrame, roots: DataFrame, most_depth: int) -> DataFrame:
    """claims(claim, child, evidence), roots(claim) -> (root, evidence, depth): what the claims under a root rest on, ``most_depth`` steps down at most.

    A claim has rows for its children and rows for its evidence. A claim met twice
    from a root counts at its least depth, so rings end.
    """
    at = written(roots.select(F.col("claim").alias("root"), "claim", F.lit(0).alias("depth")).distinct())
    seen = at
    for depth in range(1, most_depth + 1):
        step = at.select("root", "claim").join(claims.where("child IS NOT NULL").select("claim", "child"), "claim").select("root", F.col("child").alias("claim")).distinct()
        at = written(step.join(seen.select("root", "claim"), ["root", "claim"], "left_anti").withColumn("depth", F.lit(depth)))
        if at.isEmpty():
            break
        seen = seen.unionByName(at)
    own = claims.where("evidence IS NOT NULL").select("claim", "evidence")
    return seen.join(own, "claim").groupBy("root", "evidence").agg(F.min("depth").alias("depth"))


def first_downstream(edges: DataFrame, starts: DataFrame, controls: DataFrame, most_steps: int) -> DataFrame:
    """(start, control): the controls first met on walks from a start, nothing past one being followed, ``most_steps`` steps at most."""
    stop = controls.select("node").distinct().withColumn("_stop", F.lit(True))
    at = written(edges.join(starts.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct().join(stop, "node", "left"))
    found, seen = at.where("_stop").select("start", "node"), at.select("start", "node")
    for _ in range(most_steps - 1):
        step = at.where("_stop IS NULL").select("start", F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select("start", F.col("dst").alias("node")).distinct()
        at = written(step.join(seen, ["start", "node"], "left_anti").join(stop, "node", "left"))
        if at.isEmpty():
            break
        found, seen = found.unionByName(at.where("_stop").select("start", "node")), seen.unionByName(at.select("start", "node"))
    return found.select("start", F.col("node").alias("control"))


def loop_repetitions(value: Column, threshold: Column, delta: Column) -> Column:
    """How often a counter that changes by ``delta`` has to go round to reach the threshold; 0 where it is reached, null where it never is."""
    reached = F.when(delta >= 0, value >= threshold).otherwise(value <= threshold)
    away = F.ceil((threshold - value) / F.nullif(delta, F.lit(0)))
    return F.when(reached, F.lit(0).cast("long")).when(away > 0, away.cast("long"))


def route_status(found: Column, limited: Column, uncertain: Column, preconditions: Column, open_world: Column, reachable: Column, contradicted: Column) -> Column:
    """The status of a route question from what its search met, the first that holds."""
    with_route = F.when(limited, "incomplete").when(uncertain, "best_known").when(preconditions > 0, "prerequisites").otherwise("confirmed")
    without = F.when(limited, "incomplete").when(open_world, "dynamic").when(reachable & contradicted, "state_infeasible").when(reachable, "dynamic").otherwise("no_static_route")
    return F.when(found, with_route).otherwise(without)


def selection_ids(selections: DataFrame, scope: str, order: str, label: str) -> DataFrame:
    """(scope, order, selection_id): ids from labels, made unique in a scope by a number for repeats."""
    at = F.row_number().over(W.partitionBy(scope, label).orderBy(order))
    base = F.concat(F.col(scope).cast("string"), F.lit("/"), F.col(label))
    return selections.select(scope, order, F.when(at == 1, base).otherwise(F.concat(base, F.lit("#"), at.cast("string"))).alias("selection_id"))


def single_targets(candidates: DataFrame, selection: str, target: str) -> DataFrame:
    """(selection, target, outcome): resolved where exactly one target is left, else unresolved."""
    found = candidates.groupBy(selection).agg(F.count_distinct(target).alias("_n"), F.min(target).alias("_t"))
    one = F.col("_n") == 1
    return found.select(selection, F.when(one, F.col("_t")).alias("target"), F.when(one, "resolved").otherwise("unresolved").alias("outcome"))


def assembled(plan: DataFrame, results: DataFrame, key: str, fallback: str) -> DataFrame:
    """plan(key, fallback), results(key, text, accepted) -> (key, text, origin): an accepted result, else the plan's own structural text."""
    good = results.where("accepted").select(key, F.col("text").alias("_text"))
    joined = plan.join(good, key, "left")
    return joined.select(key, F.coalesce("_text", fallback).alias("text"), F.when(F.col("_text").isNotNull(), "result").otherwise("structural").alias("origin"))


def packets(items: DataFrame, group: str, order: str, text: str, most: int) -> DataFrame:
    """(group, n_items, n_shown, text): the texts of a group in order, as many whole ones as ``most`` characters hold."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = items.select(group, order, text).withColumn("_sum", F.sum(F.length(text) + 1).over(w))
    fits = F.col("_sum") - 1 <= most
    shown = F.array_sort(F.collect_list(F.when(fits, F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return rows.groupBy(group).agg(F.count("*").alias("n_items"), F.count_if(fits).alias("n_shown"), F.array_join(F.transform(shown, lambda x: x.t), "\n").alias("text"))
