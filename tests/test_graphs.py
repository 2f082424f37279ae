import random

from braidwork.operators import graphs, loops
from pyspark.sql import functions as F


def _closure(nodes, pairs):
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            out[a] |= out[b]
    return out


def _random(spark, seed, n, m):
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(90, 91), (91, 92), (92, 90), (93, 94), (94, 95), (95, 95)}
    nodes = {x for p in pairs for x in p}
    return nodes, pairs, spark.createDataFrame(sorted(pairs), "src long, dst long")


def test_strong_components_against_closure(spark):
    for seed in (1, 2):
        nodes, pairs, edges = _random(spark, seed, 30, 34)
        reach = _closure(nodes, pairs)
        expected = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
        assert {r.node: r.component for r in graphs.strong_components(edges).collect()} == expected


def test_long_chains_take_few_rounds(spark):
    n = 5000
    names = spark.range(n).select(F.format_string("n%05d", "id").alias("src"), F.format_string("n%05d", F.col("id") + 1).alias("dst"))
    found = loops.breadth_first(names, spark.createDataFrame([("n00000",)], "node string"))
    assert found.agg(F.count("*"), F.max("depth"), F.max("pred")).first() == (n + 1, n, "n04999")
    ring = names.unionByName(spark.createDataFrame([("n05000", "n00000")], "src string, dst string"))
    assert graphs.strong_components(ring).agg(F.count("*"), F.min("component"), F.max("component")).first() == (n + 1, "n00000", "n00000")


def test_terminal_samples_and_contraction(spark):
    edges = spark.createDataFrame([(1, 2, "fallthrough"), (2, 3, "choice"), (2, 4, "jump"), (4, 5, "fallthrough"), (5, 2, "jump"), (4, 6, "fallthrough")], "src long, dst long, kind string")
    ends = spark.createDataFrame([(3,), (6,)], "node long")
    found = {r.node: (r.samples, r.outcome) for r in graphs.terminal_summary(edges, ends).collect()}
    assert found == {1: ("3,6", "multiple"), 2: ("3,6", "multiple"), 3: ("3", "unique"), 4: ("3,6", "multiple"), 5: ("3,6", "multiple"), 6: ("6", "unique")}
    kept = spark.createDataFrame([(1,), (3,), (6,)], "node long")
    assert {tuple(r) for r in graphs.contracted(edges, kept).collect()} == {(1, 3, "choice", 2), (1, 6, "jump", 3)}


def test_strong_components_of_chains_between_loops(spark):
    """A chain from one loop to another has ways in and out, but each of its nodes is a component of its own."""
    edges = [(1, 2), (2, 1), (2, 9), (9, 8), (8, 7), (7, 3), (3, 4), (4, 3), (4, 20), (20, 21), (21, 22), (22, 20)]
    found = {r.node: r.component for r in graphs.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {1: 1, 2: 1, 9: 9, 8: 8, 7: 7, 3: 3, 4: 3, 20: 20, 21: 20, 22: 20}


def test_reach_goes_past_ways_that_part_and_meet_in_few_rounds(spark, monkeypatch):
    """Sixty diamonds in a row, a ring that nothing leads to, a way out of it into the row, and edges with nulls."""
    diamonds = [e for i in range(0, 180, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))]
    edges = spark.createDataFrame([*diamonds, (500, 501), (501, 500), (501, 90), (7, 7), (None, 600), (180, None)], "src long, dst long")
    rounds, written = [], loops.written
    monkeypatch.setattr(loops, "written", lambda df: rounds.append(1) or written(df))
    at = lambda *nodes: spark.createDataFrame([(n,) for n in nodes], "node long")
    inside = sorted(r.node for r in loops.window_between(edges, at(0, 900), at(90)).collect())
    assert inside == list(range(91))
    assert len(rounds) < 60
    assert sorted(r.node for r in loops.reached(edges, at(0, 900, None)).collect()) == [*range(181), 900]


def test_reach_equals_a_walk(spark):
    pick = random.Random(5)
    pairs = [(pick.randrange(40), pick.randrange(40)) for _ in range(44)]
    found, going = {3, 11}, [3, 11]
    for node in going:
        fresh = {b for a, b in pairs if a == node} - found
        found |= fresh
        going += fresh
    rows = loops.reached(spark.createDataFrame(pairs, "src int, dst int"), spark.createDataFrame([(3,), (11,)], "node int")).collect()
    assert sorted(r.node for r in rows) == sorted(found)


def test_what_returns_is_found_without_starting_over_for_each_nested_call(spark, monkeypatch):
    """Twelve labels that call the next one, the last of which returns; one that calls itself, two by way of each other, one that a plain way passes by, and a return without a label."""
    names = ["a", "b", "c", "d", "f", "g", "h", "i", "j", "k", "l", "m"]
    nodes = [(f"{n}{part}", n, kind) for n in [*names, "x", "y", "z", "w"] for part, kind in ((0, "entry"), (1, "other"), (2, "other"), (3, "return"))]
    edges = [(f"{n}{i}", f"{n}{i + 1}") for n in [*names, "x", "y", "z", "w"] for i in (0, 2)] + [("m1", "m2"), ("w1", "w2"), ("w1", "w1")]
    calls = [(f"{n}1", f"{n}2", after) for n, after in zip(names, names[1:], strict=False)] + [("x1", "x2", "x"), ("y1", "y2", "z"), ("z1", "z2", "y"), ("w1", "w2", "x")]
    rounds, written = [], loops.written
    monkeypatch.setattr(loops, "written", lambda df: rounds.append(1) or written(df))
    rows = graphs.procedure_summary(
        spark.createDataFrame([*nodes, ("m3", None, "return")], "node string, label string, kind string"), spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame(calls, "src string, dst string, callee string"),
    ).collect()
    found = {r.label: (r.may_return, r.recursive) for r in rows}
    assert found == {n: (True, False) for n in names} | {"x": (False, True), "y": (False, True), "z": (False, True), "w": (True, False)}
    assert len(rounds) < 40
