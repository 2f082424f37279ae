"""Under which guards a node is reached: sets of conditions carried along edges, kept while the node lies in the guarded arm.

A state is a sorted set of guards. Rounds extend the states that are new; of each
node the best few stay, so loops end. Stretches of a graph on which no guard
begins or ends and nothing branches are crossed in one round. Graphs that fall into
small parts go through the same rounds part by part, each where it lies.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators import parts
from braidwork.operators.loops import chains, written

#: States a node keeps. Fixed value.
MOST_STATES = 8

#: How well a guard is known: a state is as good as its worst guard. Fixed values.
STATUS_RANK = {"proven": 1, "possible": 2}

_STATE = "array<struct<guard:string,scope:string,rank:int>>"


def _rank(state: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(state, lambda g: g.rank)), F.lit(0))


def _status(free: Column, rank: Column) -> Column:
    return F.when(free, "none").otherwise(F.coalesce(*[F.when(rank == v, s) for s, v in STATUS_RANK.items()], F.lit("unresolved")))


def guard_states(nodes: DataFrame, edges: DataFrame, guards: DataFrame, members: DataFrame, roots: DataFrame, *, most: int = MOST_STATES) -> DataFrame:
    """(node, guards, status) of every state in which a node is reached from roots(node); guards is an array of (guard, scope).

    nodes(node, label), edges(src, dst, guard, enters): ``guard`` is null where an edge needs
    none, ``enters`` marks calls and jumps into another label. guards(guard, status), members(guard,
    node). Along an edge its guard is added. Inside a label a guard stays while the target is its member. Where
    an edge enters a label, all guards get that label as scope and then stay inside it. Of a node's states the ``most`` best stay, by the
    rank of the worst guard (none, proven, possible, else unresolved), then fewest guards, then by name.
    Edges that can't be taken are left out by the caller. Where all tables have ``graph``, small parts are worked out each by itself (see ``parts``).
    """
    if "graph" in edges.columns:
        return _by_parts(nodes, edges, guards, members, roots, most)
    rank = F.coalesce(*[F.when(F.col("status") == s, v) for s, v in STATUS_RANK.items()], F.lit(3))
    known = guards.select("guard", rank.cast("int").alias("rank")).distinct()
    held = members.groupBy("node").agg(F.array_sort(F.collect_set("guard")).alias("held"))  # the arms around a node
    at = written(nodes.select("node", "label").join(held, "node", "left").select("node", "label", F.coalesce("held", F.array().cast("array<string>")).alias("held")))
    side = lambda a: at.select(F.col("node").alias(a), F.col("label").alias(f"{a}_label"), F.col("held").alias(f"{a}_held"))
    flow = edges.select("src", "dst", "guard", F.coalesce("enters", F.lit(False)).alias("enters")).distinct().join(known, "guard", "left").join(side("src"), "src").join(side("dst"), "dst")
    flow = written(flow)
    changes = F.col("guard").isNotNull() | F.col("enters") | ~F.col("src_label").eqNullSafe(F.col("dst_label")) | (F.col("src_held") != F.col("dst_held"))
    heads = flow.where(changes).select(F.col("dst").alias("node")).unionByName(roots.select("node")).distinct()
    places = chains(flow.select("src", "dst"), heads)
    places = written(places.select("node", F.when(F.col("cyclic"), F.col("node")).otherwise(F.col("head")).alias("head")))  # a ring is walked node by node
    lone = roots.select("node").distinct().join(places.select("node"), "node", "left_anti").select("node", F.col("node").alias("head"))
    places = written(places.unionByName(lone))
    lifted = flow.join(places.select(F.col("node").alias("src"), F.col("head").alias("from")), "src").join(places.where("node = head").select(F.col("node").alias("dst")), "dst", "left_semi")
    added = F.when(F.col("guard").isNotNull(), F.array(F.struct("guard", F.lit(None).cast("string").alias("scope"), "rank"))).otherwise(F.array().cast(_STATE))
    lifted = written(lifted.select("from", "dst", added.cast(_STATE).alias("added"), "enters", "dst_label", "dst_held").distinct())
    carried = F.array_distinct(F.concat("state", "added"))
    scoped = F.array_distinct(F.transform(carried, lambda g: F.struct(g.guard.alias("guard"), F.col("dst_label").alias("scope"), g["rank"].alias("rank"))))
    inside = F.filter(carried, lambda g: F.when(g.scope.isNull(), F.array_contains("dst_held", g.guard)).otherwise(g.scope == F.col("dst_label")))
    moved = F.array_sort(F.when(F.col("enters"), scoped).otherwise(inside)).cast(_STATE)
    best = W.partitionBy("node").orderBy(_rank(F.col("state")), F.size("state"), "state")
    found = written(roots.select("node").distinct().select("node", F.array().cast(_STATE).alias("state")))
    fresh = found
    while not fresh.isEmpty():
        step = fresh.select(F.col("node").alias("from"), "state").join(lifted, "from").select(F.col("dst").alias("node"), moved.alias("state")).distinct()
        step = step.join(found, ["node", "state"], "left_anti").withColumn("fresh", F.lit(True))
        ranked = written(found.withColumn("fresh", F.lit(False)).unionByName(step).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).drop("place"))
        found, fresh = ranked.drop("fresh"), ranked.where("fresh").drop("fresh")
    status = _status(F.size("state") == 0, _rank(F.col("state")))
    shown = F.transform("state", lambda g: F.struct(g.guard.alias("guard"), g.scope.alias("scope")))
    return places.join(found.withColumnRenamed("node", "head"), "head").select("node", shown.alias("guards"), status.alias("status"))


def _by_parts(nodes: DataFrame, edges: DataFrame, guards: DataFrame, members: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """``guard_states`` of tables with ``graph``."""
    node, name = F.col("node").alias("src"), F.col("guard").alias("name")
    near, far = parts.split(
        parts.tagged(
            edges.select("graph", "src", "dst", name, F.coalesce("enters", F.lit(False)).alias("enters")).where("src IS NOT NULL AND dst IS NOT NULL"),
            nodes.select("graph", node, F.col("label").alias("name")).where("src IS NOT NULL"),
            guards.select("graph", name, "status"),
            members.select("graph", node, name).where("src IS NOT NULL AND name IS NOT NULL"),
            roots.select("graph", node).where("src IS NOT NULL"),
        )
    )
    found = parts.each(near, partial(states_of, most=most), {"node": "node", "guard": "array<string>", "scope": "array<string>", "rank": "int"})
    found = found.select("node", F.arrays_zip("guard", "scope").alias("guards"), _status(F.size("guard") == 0, F.col("rank")).alias("status"))
    if far is None:
        return found
    of = lambda tag, **columns: far.where(F.col("tag") == tag).select(*[F.col(c).alias(a) for a, c in columns.items()])
    rest = guard_states(of(1, node="src", label="name"), of(0, src="src", dst="dst", guard="name", enters="enters"), of(2, guard="name", status="status"), of(3, guard="name", node="src"), of(4, node="src"), most=most)
    return found.unionByName(rest)


def _place(guard: tuple) -> tuple:
    """Where a (guard, scope, rank) stands in a state, as Spark orders structs: nulls first."""
    return guard[0], guard[1] is not None, guard[1] or "", guard[2] or 0


def _worst(state: tuple) -> int:
    return max((g[2] or 0 for g in state), default=0)


def states_of(rows: list[tuple], most: int) -> list[tuple]:
    """Edges (tag 0), nodes (1), guards (2), members (3), roots (4) as (tag, src, dst, name, enters, status) -> (node, guards, scopes, worst rank) of each state: the rounds of ``guard_states`` over one part."""
    labels, ranks, held = {}, {}, {}
    for tag, src, _, name, _, status in rows:
        if tag == 1:
            labels.setdefault(src, set()).add(name)
        elif tag == 2:
            ranks.setdefault(name, set()).add(STATUS_RANK.get(status, 3))
        elif tag == 3:
            held.setdefault(src, set()).add(name)
    roots = {src for tag, src, *_ in rows if tag == 4}
    flow = {(src, dst, name, enters) for tag, src, dst, name, enters, _ in rows if tag == 0 and src in labels and dst in labels}
    heads = roots | {b for a, b, name, enters in flow if name is not None or enters or len(labels[a] | labels[b]) > 1 or held.get(a) != held.get(b)}
    links = {(a, b) for a, b, *_ in flow}
    n_out, n_in = Counter(a for a, b in links if a != b), Counter(b for _, b in links)
    after = {a: b for a, b in links if a != b and n_out[a] == n_in[b] == 1 and b not in heads}
    first, inner = {}, set(after.values())  # nodes of a ring, which nothing leads to, get no first one
    for start in ({n for link in links for n in link} | roots) - inner:
        first[start] = node = start
        while node in after:
            node = after[node]
            first[node] = start
    steps = {}
    for a, b, name, enters in flow:
        if a in first and first.get(b) == b:
            added = [()] if name is None else [((name, None, rank),) for rank in ranks.get(name, (None,))]
            steps.setdefault(first[a], set()).update((b, guard, enters, label) for guard in added for label in labels[b])
    found = {root: {()} for root in roots}
    fresh = [(root, ()) for root in roots]
    while fresh:
        new = {}
        for node, state in fresh:
            for to, added, enters, label in steps.get(node, ()):
                if enters:
                    moved = {(guard, label, rank) for guard, _, rank in (*state, *added)}
                else:
                    moved = {g for g in (*state, *added) if (g[0] in held.get(to, ()) if g[1] is None else g[1] == label)}
                moved = tuple(sorted(moved, key=_place))
                if moved not in found.get(to, ()):
                    new.setdefault(to, set()).add(moved)
        fresh = []
        for node, states in new.items():
            best = sorted({*found.get(node, ()), *states}, key=lambda s: (_worst(s), len(s), [_place(g) for g in s]))[:most]
            found[node] = set(best)
            fresh += [(node, state) for state in best if state in states]
    return [(node, [g[0] for g in state], [g[1] for g in state], _worst(state)) for node, start in first.items() for state in found.get(start, ())]
