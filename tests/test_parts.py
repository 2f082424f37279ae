"""What is worked out inside a small part, against brute force; and which parts are small."""

import random

from braidwork.operators import dominance, parts


def _reached(starts, edges, without=None):
    seen = {s for s in starts if s != without}
    while more := {b for a, b in edges if a in seen and b != without} - seen:
        seen |= more
    return seen


def _graphs():
    for seed in range(40):
        pick = random.Random(seed)
        yield sorted({(pick.randrange(9), pick.randrange(9)) for _ in range(pick.choice((3, 9, 14, 22)))}), sorted({pick.randrange(9) for _ in range(pick.choice((1, 2)))})


def _nearest(node, roots, edges, nodes):
    over = [d for d in nodes if d != node and node not in _reached(roots, edges, d)]
    return max(over, key=lambda d: sum(d not in _reached(roots, edges, x) for x in over if x != d), default=None)


def test_components_and_trees_of_a_part():
    for edges, roots in _graphs():
        nodes = {n for e in edges for n in e}
        together = {n: min(m for m in nodes if m in _reached([n], edges) and n in _reached([m], edges)) for n in nodes}
        assert dict(parts.strong([(0, *e) for e in edges])) == together
        rows = [(0, *e) for e in edges] + [(1, r, None) for r in roots]
        reached = _reached(roots, edges)
        assert dict(parts.dominator_tree(rows)) == {n: _nearest(n, roots, edges, reached) for n in reached}


def test_what_lies_ahead_in_a_part():
    for edges, ends in _graphs():
        nodes = {n for e in edges for n in e} | set(ends)
        found = parts.ends_ahead([(0, *e) for e in edges] + [(1, e, None) for e in ends] + [(2, 3, None), (2, 77, None)])
        for node, *samples, open_ in found:
            ahead = _reached([node], edges)
            assert (samples, open_) == ([*sorted(ahead & set(ends)), None, None][:2], 3 in ahead)
        assert {row[0] for row in found} == nodes
        back = [(b, a) for a, b in edges]
        exits = set(ends) | {n for n in nodes if n not in _reached(ends, back)}
        past = parts.past([(0, *e) for e in back] + [(1, e, None) for e in ends] + [(2, n, None) for n in sorted(nodes)])
        assert sorted(past, key=str) == sorted(((n, _nearest(n, exits, back, nodes), n in _reached(ends, back)) for n in nodes), key=str)


def test_ancestors_and_arms_of_a_part():
    tree = [(0, 10, None), (0, 11, 10), (0, 12, 11), (0, 13, 10), (0, 20, None)]
    assert parts.above([*tree, (1, 10, 12), (1, 12, 10), (1, 12, 12), (1, 29, 29), (1, 20, 12)]) == [(10, 12, True), (12, 10, False), (12, 12, True), (29, 29, False), (20, 12, False)]
    assert parts.meeting([*tree, (1, 1, 12), (1, 1, 11), (1, 2, 12), (1, 2, 13), (1, 3, 12), (1, 3, 20), (1, 4, 29)]) == [(1, 11), (2, 10), (3, None), (4, None)]
    assert parts.owned([(0, 1, 2, None, None), (0, 2, 3, None, None), (0, 3, 1, None, None), (1, 9, 1, 3, 0), (1, 9, 3, 3, 1), (1, 8, 2, None, 0)]) == [(9, 0, 1), (9, 0, 2), (8, 0, 2), (8, 0, 3), (8, 0, 1)]


def test_small_parts_take_a_few_jobs_and_no_rounds(spark):
    """Rounds took hundreds of jobs, and each sent all edges through shuffles again."""
    edges = spark.createDataFrame([(g, g * 10 + a, g * 10 + b) for g in range(5) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 1))], "graph long, src long, dst long")
    roots = edges.where("src % 10 = 0").select("graph", "src").distinct().withColumnRenamed("src", "node")
    spark.sparkContext.setJobGroup("parts", "dominators")
    found = dict(dominance.dominators(edges, roots).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("parts"))
    spark.sparkContext.setJobGroup("rest", "")
    assert found == {g * 10 + n: up if up is None else g * 10 + up for g in range(5) for n, up in ((0, None), (1, 0), (2, 0), (3, 0), (4, 3))}
    assert jobs <= 20


def test_parts_that_are_not_small(spark, monkeypatch):
    monkeypatch.setattr(parts, "MOST_ROWS", 2)
    rows = [(1, 10, 11), (2, 20, 21), (2, 21, 22), (2, 22, 20), (3, 30, 31), (4, 31, 32), (None, 40, 41)]
    near, far = parts.split(parts.tagged(spark.createDataFrame(rows, "graph long, src long, dst long")))
    assert [row.graph for row in near.collect()] == [1]
    assert sorted(row.src for row in far.collect()) == [20, 21, 22, 30, 31, 40]
