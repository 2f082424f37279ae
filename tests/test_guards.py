import random

from pyspark.sql import functions as F

from braidwork.operators import guards, parts
from braidwork.plans import dominance_queries

RANK = {"proven": 1, "possible": 2, "unresolved": 3}


def plain_states(label, edges, status, members, root):
    """All states of each node, one at a time, without a bound."""
    states, todo = {root: {frozenset()}}, [(root, frozenset())]
    while todo:
        at, state = todo.pop()
        for src, dst, guard, enters in edges:
            if src != at:
                continue
            carried = state | ({(guard, None)} if guard else set())
            if enters:
                moved = frozenset((g, label[dst]) for g, _ in carried)
            else:
                moved = frozenset((g, s) for g, s in carried if (dst in members[g] if s is None else s == label[dst]))
            if moved not in states.setdefault(dst, set()):
                states[dst].add(moved)
                todo.append((dst, moved))
    return states


def test_guard_states_against_single_steps(spark):
    r = random.Random(3)
    nodes, edges, status, members, roots, expected = [], [], {}, [], [], set()
    for k in range(25):
        n = r.choice([4, 8, 14])
        label = {f"{k}.{i:02d}": f"{k}.{i * 2 // n}" for i in range(n)}
        names = sorted(label)
        own = [(a, b, None, label[a] != label[b] and r.random() < 0.7) for a, b in zip(names, names[1:])]
        mine, inside = {}, {}
        for g in range(r.randrange(5)):
            name, i = f"{k}:g{g}", r.randrange(n - 1)
            mine[name] = r.choice(list(RANK))
            j = r.randrange(i + 1, n)
            inside[name] = set(names[j : j + r.choice([1, 2, 5])])
            own.append((names[i], names[j], name, r.random() < 0.2))
        own += [(r.choice(names), r.choice(names), None, False) for _ in range(r.choice([0, 1, 2]))]  # some lead back
        nodes += label.items()
        edges += own
        status |= mine
        members += [(g, m) for g, ms in inside.items() for m in ms]
        roots.append((names[0],))
        for node, states in plain_states(label, own, mine, inside, names[0]).items():
            for s in states:
                worst = max((RANK[mine[g]] for g, _ in s), default=0)
                expected.add((node, s, {0: "none", 1: "proven", 2: "possible", 3: "unresolved"}[worst]))
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    args = (frame(nodes, "node string, label string"), frame(edges, "src string, dst string, guard string, enters boolean"), frame(list(status.items()), "guard string, status string"), frame(members, "guard string, node string"), frame(roots, "node string"))
    found = guards.guard_states(*args, most=1000).collect()
    assert {(x.node, frozenset(tuple(g) for g in x.guards), x.status) for x in found} == expected and len(found) == len(expected)
    few = {}
    for x in guards.guard_states(*args, most=1).collect():
        few.setdefault(x.node, []).append(x)
    assert few.keys() == {e[0] for e in expected} and all(len(v) == 1 for v in few.values())


def _some_parts(spark):
    r = random.Random(5)
    nodes, edges, status, members, roots = [], [], [], [], []
    for k in range(12):
        n = r.choice([5, 9, 12])
        nodes += [(k, k * 100 + i, r.choice(["a", "b", None]) if k % 2 else "a") for i in range(n)]
        edges += [(k, k * 100 + i, k * 100 + i + 1, None, r.random() < 0.2) for i in range(n - 1)]
        edges += [(k, k * 100 + r.randrange(n), k * 100 + r.randrange(n), r.choice([None, f"g{k}.{r.randrange(3)}"]), r.random() < 0.3) for _ in range(5)]
        status += [(k, f"g{k}.{g}", r.choice(["proven", "possible", "unresolved"])) for g in range(2)]  # the third is not known
        members += [(k, f"g{k}.{r.randrange(3)}", k * 100 + r.randrange(n)) for _ in range(2 * n)]
        roots += [(k, k * 100), (k, k * 100 + 50)]
    frame = spark.createDataFrame
    return [frame(nodes, "graph long, node long, label string"), frame(edges, "graph long, src long, dst long, guard string, enters boolean"), frame(status, "graph long, guard string, status string"), frame(members, "graph long, guard string, node long"), frame(roots, "graph long, node long")]


def test_small_parts_have_the_states_of_the_rounds_in_a_few_jobs(spark):
    """Each round ranked and wrote all states found, of all graphs."""
    tables = _some_parts(spark)
    shown = lambda found: sorted(((x.node, [tuple(g) for g in x.guards], x.status) for x in found.collect()), key=str)
    for most in (2, 1000):
        spark.sparkContext.setJobGroup(f"guards{most}", "parts")
        small = shown(guards.guard_states(*tables, most=most))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"guards{most}"))
        spark.sparkContext.setJobGroup("rest", "")
        assert small == shown(guards.guard_states(*[t.drop("graph") for t in tables], most=most))
        assert jobs <= 20


def test_parts_that_are_not_small_have_the_same_states(spark, monkeypatch):
    tables = _some_parts(spark)
    small = sorted(map(str, guards.guard_states(*tables).collect()))
    monkeypatch.setattr(parts, "MOST_ROWS", 55)
    assert sorted(map(str, guards.guard_states(*tables).collect())) == small


def test_guards_of_a_customer_of_a_thousand_orders(spark):
    keys = [3 * j for j in range(1001)] + [3004, 3007, 3010]
    orders = spark.createDataFrame([(k, 1, "O") for k in keys] + [(9001, None, "O"), (9004, None, "O")], "o_orderkey long, o_custkey long, o_orderstatus string")
    found = {(x.node, x.guards, x.status) for x in dominance_queries.guarded_orders(spark, lambda name: orders).where(F.col("node") > 2999).collect()}
    assert found == {(3000, "", "none"), (3004, "", "none"), (3007, "", "none"), (3010, "", "none"), (3010, "1001", "unresolved"), (9001, "", "none")}


def test_a_long_line_with_a_loop_ends(spark):
    n = 3000
    nodes = [(f"n{i:05d}", "a") for i in range(n)]
    edges = [(f"n{i:05d}", f"n{i + 1:05d}", "g" if i == 1000 else None, False) for i in range(n - 1)] + [("n02500", "n00500", None, False)]
    members = [("g", f"n{i:05d}") for i in range(1001, 2000)]
    found = guards.guard_states(
        spark.createDataFrame(nodes, "node string, label string"), spark.createDataFrame(edges, "src string, dst string, guard string, enters boolean"), spark.createDataFrame([("g", "proven")], "guard string, status string"), spark.createDataFrame(members, "guard string, node string"), spark.createDataFrame([("n00000",)], "node string")
    )
    assert sorted((x.node, [g.guard for g in x.guards]) for x in found.collect()) == [(f"n{i:05d}", ["g"] if 1001 <= i < 2000 else []) for i in range(n)]
