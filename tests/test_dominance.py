import random

import pytest

from braidwork.operators import dominance


def reached(edges, roots, without=None):
    seen, todo = set(), [r for r in roots if r != without]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b for a, b in edges if a == n and b != without]
    return seen


def plain_idoms(edges, roots):
    """Immediate dominators by taking each node out: what is no longer reached, it dominates."""
    every = reached(edges, roots)
    over = {n: set() for n in every}
    for d in every:
        for n in every - reached(edges, roots, d) - {d}:
            over[n].add(d)
    return {n: max(ds, key=lambda d: len(over[d])) if ds else None for n, ds in over.items()}


def graphs(seed):
    r = random.Random(seed)
    for base in range(0, 1200, 100):
        n = r.choice([1, 4, 9, 25])
        yield base, [(base + r.randrange(n), base + r.randrange(n)) for _ in range(int(n * r.choice([0.8, 1.3, 2.0])))]
    yield 1200, [(1200 + i, 1200 + i + 1) for i in range(60)] + [(1210, 1250), (1260, 1205)]  # a long chain, a short cut and a way back
    ladder = [(a, b) for i in range(1302, 1330, 2) for a in (i, i + 1) for b in (i + 2, i + 3)]
    yield 1300, [(1300, 1302), (1300, 1303), *ladder]


@pytest.mark.parametrize("seed", [1])
def test_dominators_against_removal(spark, seed):
    made = list(graphs(seed))
    edges = [e for _, es in made for e in es]
    expected = {n: d for base, es in made for n, d in plain_idoms(es, [base]).items()}
    found = dominance.dominators(spark.createDataFrame(edges, "src long, dst long").repartition(5), spark.createDataFrame([(b,) for b, _ in made], "node long"))
    assert {r.node: r.idom for r in found.collect()} == expected


def test_several_roots_and_text_ids(spark):
    edges = [("a", "x"), ("b", "x"), ("x", "y"), ("y", "a"), ("y", "z"), ("c", "z")]
    found = dominance.dominators(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a",), ("b",), (None,)], "node string"))
    assert {r.node: r.idom for r in found.collect()} == {"a": None, "b": None, "x": None, "y": "x", "z": "y"}
    none = spark.createDataFrame([], "src string, dst string")
    assert [(r.node, r.idom) for r in dominance.dominators(none, spark.createDataFrame([("a",)], "node string")).collect()] == [("a", None)]


def test_post_dominators_against_removal(spark):
    made = list(graphs(5))
    edges = sorted({e for _, es in made for e in es})
    nodes = sorted({n for e in edges for n in e} | {b for b, _ in made})
    ends = [n for n in nodes if not any(a == n for a, _ in edges) or n % 17 == 0]
    back = [(b, a) for a, b in edges]
    able = reached(back, ends)
    expected = plain_idoms(back, [*ends, *(n for n in nodes if n not in able)])
    found = dominance.post_dominators(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame([(n,) for n in ends], "node long")).collect()
    assert {r.node: r.ipdom for r in found} == expected and {r.node for r in found if not r.terminates} == set(nodes) - able
    tree = spark.createDataFrame([(r.node, r.ipdom) for r in found], "node long, idom long")

    def chain(n):
        return [n, *chain(expected[n])] if n is not None else []

    rng = random.Random(1)
    groups = {g: [rng.choice(nodes[:200]) for _ in range(3)] for g in range(80)}
    common = {g: next((n for n in chain(ns[0]) if all(n in chain(m) for m in ns)), None) for g, ns in groups.items()}
    rows = spark.createDataFrame([(g, n) for g, ns in groups.items() for n in ns], "grp long, node long")
    assert {r.grp: r.common for r in dominance.common_of_groups(rows, tree).collect()} == common


def test_loop_roles(spark):
    edges = [(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (5, 4), (1, 5), (5, 6), (6, 6), (6, 7), (8, 9), (9, 8), (2, 10), (10, 3)]
    found = {(r.src, r.dst): r.role for r in dominance.loop_roles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {
        (2, 3): "loop_body", (3, 2): "loop_back", (2, 10): "loop_body", (10, 3): "loop_body", (3, 4): "loop_exit",  # entered at 2 alone
        (4, 5): "loop_body", (5, 4): "loop_body", (5, 6): "loop_exit",  # entered at 4 and at 5
        (6, 6): "loop_back", (6, 7): "loop_exit", (8, 9): "loop_body", (9, 8): "loop_body",  # entered at itself; entered nowhere
    }
