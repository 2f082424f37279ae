"""Graphs that fall into many small parts: Spark brings the rows of a part together, and a part is worked out where it lies, all of them side by side.

Edges with a column ``graph`` name the part that both their ends lie in. A part of
more than ``MOST_ROWS`` rows, one without a name, and one that shares a node with
another are no small parts: the operators take these by joins, in rounds, as they
take edges without the column. So no task holds more than a part of that size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.loops import written

#: Rows of a small part. Fixed value.
MOST_ROWS = 5_000

#: Rows of a batch that a task gives back. Fixed value.
_BATCH = 10_000


def tagged(*tables: DataFrame) -> DataFrame:
    """Tables with ``graph`` and ids ``src``, ``dst`` (and more) as one, ``tag`` being a table's place; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("tag", F.lit(i)) for i, t in enumerate(tables)])


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of small parts, and those of all others, None where there are none; written."""
    rows = written(rows)
    ends = rows.select("graph", "src").unionByName(rows.select("graph", F.col("dst").alias("src"))).where("src IS NOT NULL")
    shared = ends.groupBy("src").agg(F.min("graph").alias("a"), F.max("graph").alias("b")).where("a <> b").select("src")
    large = rows.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS).select("graph")
    large = written(large.unionByName(ends.join(shared, "src", "left_semi").select("graph")).where("graph IS NOT NULL").distinct())
    unnamed = rows.where("graph IS NULL")
    if large.isEmpty() and unnamed.isEmpty():
        return rows, None
    return rows.join(large, "graph", "left_anti").where("graph IS NOT NULL"), written(rows.join(large, "graph", "left_semi").unionByName(unnamed))


def each(rows: DataFrame, solve: Callable[[list[tuple]], list[tuple]], result: dict[str, str]) -> DataFrame:
    """What ``solve`` makes of each part's rows, tuples of tag, src, dst and what else there is; of ``result`` columns, ``node`` stands for the type of src."""
    columns = ["graph", "tag", "src", "dst", *[c for c in rows.columns if c not in ("graph", "tag", "src", "dst")]]
    node = rows.schema["src"].dataType.simpleString()
    arrow = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done = None, []
        for kind, part in _by_graph(batches):
            done += solve(part)
            if len(done) >= _BATCH:
                yield made(kind, done)
                done = []
        if done:
            yield made(kind, done)

    def made(kind: pa.DataType, found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, arrow.get(t, kind)) for c, t in zip(zip(*found, strict=True), result.values(), strict=True)], names=list(result))

    dealt = rows.select(*columns).repartition("graph").sortWithinPartitions("graph", "tag", "src", "dst")
    return dealt.mapInArrow(solved, ", ".join(f"{c} {node if t == 'node' else t}" for c, t in result.items()))


def values(column: pa.Array) -> list:
    """``to_pylist``, several times faster where numpy holds the same values."""
    plain = pa.types.is_string(column.type) or (not column.null_count and pa.types.is_integer(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _by_graph(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[tuple]]]:
    """Rows in order -> the type of their ids and the rows of each graph."""
    graph, held, kind = None, [], None
    for batch in batches:
        kind = batch.schema.field("src").type
        for name, *row in zip(*map(values, batch.columns), strict=True):
            if held and name != graph:
                yield kind, held
                held = []
            graph = name
            held.append(tuple(row))
    if held:
        yield kind, held


def ahead_of(edges: list[tuple]) -> dict:
    """(src, dst) -> the targets of each source."""
    ahead = {}
    for src, dst in edges:
        ahead.setdefault(src, []).append(dst)
    return ahead


def post_order(starts: list, ahead: dict) -> list:
    """Nodes that ``starts`` reach, each after what it leads to."""
    seen, order = set(), []
    for start in starts:
        if start in seen:
            continue
        seen.add(start)
        walk = [(start, iter(ahead.get(start, ())))]
        while walk:
            node, rest = walk[-1]
            for following in rest:
                if following not in seen:
                    seen.add(following)
                    walk.append((following, iter(ahead.get(following, ()))))
                    break
            else:
                order.append(node)
                walk.pop()
    return order


def led_to(rows: list[tuple]) -> list[tuple]:
    """Edges (tag 0) and roots (tag 1) -> (node): what a root leads to, roots included."""
    return [(node,) for node in post_order([src for tag, src, _ in rows if tag == 1], ahead_of([row[1:3] for row in rows if row[0] == 0]))]


def strong(rows: list[tuple]) -> list[tuple]:
    """Edges -> (node, component), the smallest node of each strong component: what reaches the nodes in reverse post-order, one after the other."""
    edges = [row[1:3] for row in rows]
    ahead, back = ahead_of(edges), ahead_of([(dst, src) for src, dst in edges])
    found = {}
    for start in reversed(post_order(list(dict.fromkeys(n for e in edges for n in e)), ahead)):
        if start in found:
            continue
        found[start], members = start, [start]
        for node in members:
            for before in back.get(node, ()):
                if before not in found:
                    found[before] = start
                    members.append(before)
        least = min(members)
        found.update(dict.fromkeys(members, least))
    return list(found.items())


def dominator_tree(rows: list[tuple]) -> list[tuple]:
    """Edges (tag 0) and roots (tag 1) -> (node, idom): nodes in reverse post-order climb to where their predecessors meet, until none moves."""
    ahead = ahead_of([(src, dst) for tag, src, dst in rows if tag == 0 and src != dst])
    roots = [src for tag, src, _ in rows if tag == 1]
    order = post_order(roots, ahead)[::-1]
    place = {node: i for i, node in enumerate(order, 1)}  # 0 is the unseen root
    before = [[] for _ in range(len(order) + 1)]
    for root in roots:
        before[place[root]].append(0)
    for node in order:
        for following in ahead.get(node, ()):
            before[place[following]].append(place[node])
    up, moved = [0] + [None] * len(order), True
    while moved:
        moved = False
        for at in range(1, len(order) + 1):
            new = None
            for other in before[at]:
                if up[other] is None:
                    continue
                new = other if new is None else new
                while other != new:
                    other, new = (up[other], new) if other > new else (other, up[new])
            if up[at] != new:
                up[at], moved = new, True
    return [(node, order[up[i] - 1] if up[i] else None) for i, node in enumerate(order, 1)]


def _chain(node, up: dict) -> list:
    """``node`` and its ancestors, the nearest first; empty where the tree lacks it."""
    found = []
    while node in up:
        found.append(node)
        node = up[node]
    return found


def above(rows: list[tuple]) -> list[tuple]:
    """A tree's (node, parent) (tag 0) and pairs (above, below) (tag 1) -> pairs with whether the one is the other or an ancestor of it."""
    up = {src: dst for tag, src, dst in rows if tag == 0}
    return [(src, dst, src in _chain(dst, up)) for tag, src, dst in rows if tag == 1]


def meeting(rows: list[tuple]) -> list[tuple]:
    """A tree's (node, parent) (tag 0) and members (group, node) (tag 1) -> (group, common): the nearest ancestor that all members share."""
    up = {src: dst for tag, src, dst in rows if tag == 0}
    found = {}
    for tag, group, node in rows:
        if tag == 1:
            chain = _chain(node, up)
            kept = set(chain)
            found[group] = [n for n in found[group] if n in kept] if group in found else chain
    return [(group, shared[0] if shared else None) for group, shared in found.items()]


def ends_ahead(rows: list[tuple]) -> list[tuple]:
    """Edges (tag 0), ends (tag 1) and open nodes (tag 2) -> (node, first, second, unresolved): the two smallest ends ahead, and whether an open node is."""
    back = ahead_of([(dst, src) for tag, src, dst in rows if tag == 0])
    nodes = dict.fromkeys(n for tag, *pair in rows if tag < 2 for n in pair[: 2 - tag])
    least, going = {}, []
    for tag, node, _ in rows:
        if tag == 1:
            least[node] = [node]
            going.append(node)
    while going:
        node = going.pop()
        for before in back.get(node, ()):
            new = sorted({*least.get(before, ()), *least[node]})[:2]
            if new != least.get(before):
                least[before] = new
                going.append(before)
    opened = set(post_order([node for tag, node, _ in rows if tag == 2], back))
    return [(node, *[*least.get(node, ()), None, None][:2], node in opened) for node in nodes]


def owned(rows: list[tuple]) -> list[tuple]:
    """Steps (tag 0) and arms (split, entry, merge, ordinal) (tag 1) -> (split, ordinal, node): what follows an arm's entry up to its merge."""
    ahead = ahead_of([row[1:3] for row in rows if row[0] == 0])
    found = []
    for tag, part, entry, merge, ordinal in rows:
        if tag == 1 and entry != merge:
            members = {entry: None}
            going = [entry]
            for node in going:
                for following in ahead.get(node, ()):
                    if following != merge and following not in members:
                        members[following] = None
                        going.append(following)
            found += [(part, ordinal, node) for node in members]
    return found


def past(rows: list[tuple]) -> list[tuple]:
    """Edges against their direction (tag 0), ends (tag 1) and nodes (tag 2) -> (node, ipdom, terminates) of the nodes; those that reach no end are ends, too."""
    reached = set(post_order([src for tag, src, _ in rows if tag == 1], ahead_of([(src, dst) for tag, src, dst in rows if tag == 0])))
    asked = [src for tag, src, _ in rows if tag == 2]
    tree = dict(dominator_tree([row for row in rows if row[0] < 2] + [(1, node, None) for node in asked if node not in reached]))
    return [(node, tree[node], node in reached) for node in asked]
