"""The read model over stored rows: overlays, lookups, search, interval and nearest joins, boundary windows, coverage."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions import text as T
from braidwork.operators.cuts import bins, first_at, placed
from braidwork.operators.loops import written


def filtered(df: DataFrame, *, equal: dict | None = None, within: dict | None = None, ranges: dict | None = None, null: tuple[str, ...] = ()) -> DataFrame:
    """Rows that meet every condition given; a value of None in ``equal`` leaves its column free."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.where(F.col(c) == F.lit(v))
    for c, v in (within or {}).items():
        df = df.where(F.col(c).isin(*v))
    for c, (low, high) in (ranges or {}).items():
        df = df if low is None else df.where(F.col(c) >= F.lit(low))
        df = df if high is None else df.where(F.col(c) <= F.lit(high))
    for c in null:
        df = df.where(F.col(c).isNull())
    return df


def containing(df: DataFrame, text: str, needle: str) -> DataFrame:
    """Rows whose text holds the needle in any case; the needle's own ``%`` and ``_`` are plain characters."""
    return df.where(F.contains(T.folded(F.col(text)), T.folded(F.lit(needle))))


def titled(nodes: DataFrame, overrides: DataFrame, key: str, label: str) -> DataFrame:
    """(key, title, hidden): every node, an override's name before its own, hidden where the override says so."""
    names = overrides.select(key, "display_name", F.col("hidden").alias("_hidden"))
    return nodes.join(names, key, "left").select(key, F.coalesce("display_name", label).alias("title"), F.coalesce("_hidden", F.lit(False)).alias("hidden"))


def best_hits(items: DataFrame, key: str, candidates: list[str], needle: str) -> DataFrame:
    """(key, score, field): the best of an item's fields that fits: equal to the first 0, second 2, others 3; a prefix 4; a part 5."""
    low = T.folded(F.lit(needle))
    hits = []
    for k, c in enumerate(candidates):
        own = T.folded(F.col(c).cast("string"))
        score = F.when(own == low, (0, 2)[k] if k < 2 else 3).when(own.startswith(low), 4).when(own.contains(low), 5)
        hits.append(F.when(score.isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.lit(c).alias("field"))))
    best = items.withColumn("_hit", F.array_min(F.array_compact(F.array(*hits))))
    return best.where("_hit IS NOT NULL").select(key, F.col("_hit.score").alias("score"), F.col("_hit.field").alias("field"))


def lineage(nodes: DataFrame, key: str, parent: str, levels: int = 3) -> DataFrame:
    """(key, root, depth, path): a node's ancestors from the root down, up to ``levels`` nodes."""
    up = nodes.select(key, parent)
    found = up.select(F.col(key).alias("leaf"), F.col(parent).alias("at"), F.array(F.col(key)).alias("path"))
    for _ in range(levels - 1):
        above = up.select(F.col(key).alias("at"), F.col(parent).alias("next"))
        found = found.join(above, "at", "left").select("leaf", F.when(F.col("next").isNotNull(), F.col("next")).alias("up"), F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), "path")).alias("path"))
        found = found.withColumnRenamed("up", "at")
    return found.select(F.col("leaf").alias(key), F.element_at("path", 1).alias("root"), F.size("path").alias("depth"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(node), edges(src, dst) -> (node, n_in, n_out, before, after): each node's neighbours, sorted."""
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("b"), F.lit(None).alias("a"))
    out = edges.select(F.col("src").alias("node"), F.lit(None).alias("b"), F.col("dst").alias("a"))
    near = into.unionByName(out).join(ids.select("node"), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("b")).alias("b"), F.array_sort(F.collect_set("a")).alias("a"))
    joined = ids.select("node").join(near, "node", "left")
    text = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))
    return joined.select("node", F.coalesce(F.size("b"), F.lit(0)).alias("n_in"), F.coalesce(F.size("a"), F.lit(0)).alias("n_out"), text("b").alias("before"), text("a").alias("after"))


def overlap_owner(rows: DataFrame, spans: DataFrame, group: str, row: tuple[str, str, str], span: tuple[str, str, str], bucket: int) -> DataFrame:
    """(group, row id, owner): of the spans of a group that a row's (start, end) overlaps, the narrowest, then the deepest start, then the smallest id.

    ``row`` and ``span`` are (id, start, end), whole numbers, ends inclusive. Both
    are dealt to the buckets of numbers that they touch, so only near ones meet.
    """
    (rid, ra, rb), (sid, sa, sb) = row, span
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    left = rows.select(group, F.col(rid).alias("r"), F.col(ra).alias("ra"), F.col(rb).alias("rb")).withColumn("bucket", touched("ra", "rb"))
    right = spans.select(group, F.col(sid).alias("s"), F.col(sa).alias("sa"), F.col(sb).alias("sb")).withColumn("bucket", touched("sa", "sb"))
    met = left.join(right, [group, "bucket"]).where("ra <= sb AND sa <= rb")
    best = F.min_by("s", F.struct((F.col("sb") - F.col("sa")).alias("width"), (-F.col("sa")).alias("deep"), "s"))
    return met.groupBy(group, F.col("r").alias(rid)).agg(best.alias("owner"))


def nearest_section(items: DataFrame, sections: DataFrame, group: str, item: str, at: str, section: str) -> DataFrame:
    """(group, item, section): the section of a group nearest to an item on an axis of ordinals; of two as near, the one before. A null group has no section.

    sections(group, section, at). One sorted pass over both carries the last section before and the next one after.
    """
    both = items.select(group, F.col(item).alias("i"), F.col(at).alias("at"), F.lit(None).cast(sections.schema[section].dataType).alias("s")).unionByName(
        sections.select(group, F.lit(None).cast(items.schema[item].dataType).alias("i"), F.col(at).alias("at"), F.col(section).alias("s"))
    )
    mark = F.when(F.col("s").isNotNull() & F.col(group).isNotNull(), F.struct("at", "s"))
    order = [F.col("at"), F.col("s").isNull(), F.col("s")]
    before = F.last(mark, ignorenulls=True).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(W.partitionBy(group).orderBy(*order).rowsBetween(0, W.unboundedFollowing))
    found = both.withColumn("b", before).withColumn("a", after).where("i IS NOT NULL")
    nearer = F.col("b").isNull() | F.coalesce((F.col("a.at") - F.col("at")) < (F.col("at") - F.col("b.at")), F.lit(False))
    return found.select(group, F.col("i").alias(item), F.when(nearer, F.col("a.s")).otherwise(F.col("b.s")).alias(section))


def contradicting_pairs(facts: DataFrame, scope: list[str], value: str, ident: str) -> DataFrame:
    """(scope.., value, n, first_id, scope_values): facts of a scope of any number of columns, nulls equal, where it holds several values; a row a value."""
    values = facts.groupBy(*scope, value).agg(F.count("*").alias("n"), F.min(ident).alias("first_id"))
    several = values.groupBy(*[F.col(c).alias(f"_{c}") for c in scope]).agg(F.count("*").alias("scope_values")).where("scope_values > 1")
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope])
    return values.join(several, same).select(*scope, value, "n", "first_id", "scope_values")


def unnested(df: DataFrame, key: str, json: str, path: str) -> DataFrame:
    """(key, ordinal, value): the elements of a JSON array under ``$.path``, numbered from 0; none where it is missing."""
    items = F.from_json(F.get_json_object(json, f"$.{path}"), "array<string>")
    return df.select(key, F.posexplode(items).alias("ordinal", "value"))


def by_location(points: DataFrame, nodes: DataFrame, on: list[str], node: str) -> DataFrame:
    """(on.., nodes): the nodes at each location asked for, sorted and joined; empty where there are none."""
    at = nodes.groupBy(*on).agg(F.array_join(F.array_sort(F.collect_set(F.col(node).cast("string"))), ",").alias("nodes"))
    return points.select(*on).distinct().join(at, on, "left").select(*on, F.coalesce("nodes", F.lit("")).alias("nodes"))


def recall(expected: DataFrame, found: DataFrame, group: str, item: str) -> DataFrame:
    """(group, n_expected, n_found, recall): the share of each group's expected items that were found."""
    hits = expected.select(group, item).distinct().join(found.select(group, item).distinct().withColumn("_hit", F.lit(1)), [group, item], "left")
    return hits.groupBy(group).agg(F.count("*").alias("n_expected"), F.count("_hit").alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_expected"), 6))


def carried(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the last value that is not null, of this row or one before it in its group."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def spaced_boundaries(df: DataFrame, group: str, order: str, candidate: str, least: int) -> DataFrame:
    """(group, order, accepted): of candidate boundaries in order, those at least ``least`` items after the last one accepted; the first item is one.

    Whether one is accepted depends on those before: the next one is looked up for all items at once.
    """
    rows = placed(df.withColumn("_candidate", F.col(candidate).cast("long")), group, order, "_candidate")
    at = lambda value: rows.select("grp", "place", value.alias("value"))
    following = first_at(at(F.col("place") + least), rows.where("_candidate = 1").select("grp", F.col("place").alias("at"), F.col("place").alias("value")), 1024)
    numbered = bins(written(following.select("grp", "place", F.col("found").alias("next"))))
    first = numbered.groupBy("grp", "bin_no").agg(F.min("place").alias("place")).select("grp", "place", F.lit(True).alias("accepted"))
    return rows.join(first, ["grp", "place"], "left").select(F.col("grp.g").alias(group), F.col("ord").alias(order), F.coalesce("accepted", F.lit(False)).alias("accepted"))


def supported_boundaries(df: DataFrame, group: str, order: str, boundary: str, support: str) -> DataFrame:
    """``df``(boundary, support) with ``supported``: whether a boundary has had support since the boundary before it."""
    w = W.partitionBy(group).orderBy(order)
    runs = df.withColumn("_run", F.coalesce(F.sum(F.col(boundary).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    seen = F.max(F.col(support).cast("int")).over(W.partitionBy(group, "_run").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return runs.withColumn("supported", F.col(boundary) & (seen == 1)).drop("_run")


def coalesced(transitions: DataFrame, keys: list[str], evidence: str) -> DataFrame:
    """(keys.., n, evidence): transitions alike in all keys, nulls equal, put together, with the sorted union of their evidence."""
    return transitions.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(evidence).cast("string"))), ",").alias("evidence"))


def citations(leaves: DataFrame, cited: DataFrame, group: str, leaf: str) -> DataFrame:
    """(group, leaf, outcome) of leaves that are not cited exactly once, and of citations of what is no leaf."""
    counts = cited.groupBy(group, leaf).agg(F.count("*").alias("n"))
    known = leaves.select(group, leaf).distinct().withColumn("known", F.lit(True))
    outcome = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return known.join(counts, [group, leaf], "full").select(group, leaf, outcome.alias("outcome")).where("outcome IS NOT NULL")


def ungrouped_runs(required: DataFrame, grouped: DataFrame, scope: str, order: str, item: str) -> DataFrame:
    """(scope, run_no, first_at, last_at, n): items in no group, each run between grouped ones as a group of its own."""
    marked = required.join(grouped.select(item).distinct().withColumn("_in", F.lit(True)), item, "left")
    w = W.partitionBy(scope).orderBy(order)
    number = F.row_number().over(w)
    rows = marked.withColumn("_at", number)
    loose = rows.where("_in IS NULL").withColumn("_island", F.col("_at") - F.row_number().over(w))
    runs = loose.groupBy(scope, "_island").agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count("*").alias("n"))
    return runs.select(scope, (F.row_number().over(W.partitionBy(scope).orderBy("first_at")) - 1).alias("run_no"), "first_at", "last_at", "n")


def disagreements(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key.., ours, theirs): where two stages say different things of a key, or only one says anything."""
    a = left.select(*key, F.col(value).alias("ours"), F.lit(True).alias("_a"))
    b = right.select(*key, F.col(value).alias("theirs"), F.lit(True).alias("_b"))
    joined = a.join(b, key, "full")
    return joined.where(~F.col("ours").eqNullSafe(F.col("theirs")) | F.col("_a").isNull() | F.col("_b").isNull()).select(*key, "ours", "theirs")
