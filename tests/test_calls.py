import random

from braidwork.operators import calls


def program(r, base, n_labels):
    """Labels of a few lines; calls go to later labels or, now and then, back; some never return."""
    nodes, edges = [], []
    entry = {k: f"{base}.{k}.0" for k in range(n_labels)}
    for k in range(n_labels):
        lines = r.randrange(2, 6)
        name = lambda i, k=k: f"{base}.{k}.{i}"
        for i in range(lines):
            what = r.choice(["line", "line", "call", "split", "jump"]) if 0 < i < lines - 1 else "line"
            kind = "return" if i == lines - 1 and r.random() < 0.7 else "module_end" if i == lines - 1 and r.random() < 0.3 else what
            nodes.append((name(i), kind, f"{base}.{k}"))
            if i == lines - 1:
                continue
            if kind == "call":
                edges.append((name(i), name(i + 1), "call_continuation"))
                to = r.choice([*range(k + 1, n_labels), k + 1, r.randrange(n_labels)])
                edges.append((name(i), entry[to], "call") if to < n_labels else (name(i), f"{name(i)}:u", "missing_call"))
                if to >= n_labels:
                    nodes.append((f"{name(i)}:u", "unresolved", f"{base}.{k}"))
            elif kind == "jump":
                edges.append((name(i), entry[r.randrange(n_labels)], "jump"))
            else:
                edges.append((name(i), name(i + 1), "fallthrough"))
                if kind == "split":
                    edges.append((name(i), name(lines - 1), "condition"))
    return nodes, edges


def plain_summary(nodes, edges, goal):
    """What a frame can come to, to a fix-point, node by node."""
    kind, label = {n: k for n, k, _ in nodes}, {n: x for n, _, x in nodes}
    back, ends = set(), set()
    changed = True
    while changed:
        changed = False
        for n in kind:
            out = [e for e in edges if e[0] == n]
            callee = next((b for _, b, k in out if k == "call"), None)
            follow = [b for a, b, k in out if k not in ("call", "return", "call_continuation") and (label[a] == label[b] or k == "jump" or kind[b] in ("module_end", "unresolved"))]
            follow += [b for _, b, k in out if k == "call_continuation" and callee in back]
            if n not in back and (kind[n] == "return" or any(b in back for b in follow)):
                back.add(n)
                changed = True
            if n not in ends and (kind[n] == "module_end" or any(b in ends for b in follow) or callee in ends):
                ends.add(n)
                changed = True
    return back if goal == "return" else ends


def stacked_reach(nodes, edges, root):
    """Nodes met by walks that keep a stack of calls, no deeper than twelve."""
    kind = {n: k for n, k, _ in nodes}
    seen, todo, met = set(), [(root, ())], set()
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        n, stack = state
        met.add(n)
        out = [e for e in edges if e[0] == n]
        if kind[n] == "return":
            if stack:
                todo.append((stack[-1], stack[:-1]))
            continue
        follow = next((b for _, b, k in out if k == "call_continuation"), None)
        for _, b, k in out:
            if k == "call" and len(stack) < 12:
                todo.append((b, (*stack, follow)))
            elif k not in ("call", "call_continuation", "return"):
                todo.append((b, stack))
        if follow is not None and not any(k == "call" for _, _, k in out):
            todo.append((follow, stack))
    return met


def test_calls_against_stacks(spark):
    r = random.Random(4)
    made = [program(r, k, r.randrange(2, 6)) for k in range(30)]
    nodes, edges = [n for ns, _ in made for n in ns], [e for _, es in made for e in es]
    frame, table = spark.createDataFrame(nodes, "node string, kind string, label string"), spark.createDataFrame(edges, "src string, dst string, kind string").repartition(4)
    known = calls.written(calls.summaries(frame, table))
    found = known.collect()
    assert {x.node for x in found if x.may_return} == set().union(*(plain_summary(ns, es, "return") for ns, es in made))
    assert {x.node for x in found if x.may_terminate} == set().union(*(plain_summary(ns, es, "end") for ns, es in made))
    more, flow = calls.normalized(frame, table, known)
    roots = spark.createDataFrame([(f"{k}.0.0",) for k in range(30)], "node string")
    met = {x.node for x in calls.matched_reach(flow, roots).collect() if x.node in {n for n, *_ in nodes}}
    assert met == set().union(*(stacked_reach(ns, es, f"{k}.0.0") for k, (ns, es) in enumerate(made)))
    kinds = {x.kind for x in more.collect()}
    assert {"procedure_return_boundary", "call_return_site"} <= kinds


def test_a_callee_of_two_calls_returns_to_each_alone(spark):
    nodes = [(n, k, x) for n, k, x in [("a", "line", "A"), ("a1", "call", "A"), ("a2", "line", "A"), ("b", "line", "B"), ("b1", "call", "B"), ("b2", "line", "B"), ("s", "line", "S"), ("s1", "return", "S"), ("t", "line", "T"), ("t1", "call", "T"), ("t2", "return", "T")]]
    edges = [("a", "a1", "fallthrough"), ("a1", "s", "call"), ("a1", "a2", "call_continuation"), ("b", "b1", "fallthrough"), ("b1", "t", "call"), ("b1", "b2", "call_continuation"), ("s", "s1", "fallthrough"), ("s1", "a2", "return"), ("s1", "t2", "return"), ("t", "t1", "fallthrough"), ("t1", "s", "call"), ("t1", "t2", "call_continuation"), ("t2", "b2", "return")]
    _, flow = calls.normalized(spark.createDataFrame(nodes, "node string, kind string, label string"), spark.createDataFrame(edges, "src string, dst string, kind string"))
    one = lambda n: {x.node for x in calls.matched_reach(flow, spark.createDataFrame([(n,)], "node string")).collect()}
    assert "a2" in one("a") and not {"b2", "t2"} & one("a") and "a2" not in one("b") and "b2" in one("b")
    assert {tuple(x) for x in calls.resumes(flow).collect()} == {("return:a1", "exit:S"), ("return:t1", "exit:S"), ("return:b1", "exit:T")}
    assert calls.recursive_labels(spark.createDataFrame(nodes, "node string, kind string, label string"), spark.createDataFrame([*edges, ("s", "t", "call"), ("s", "s1", "call_continuation")], "src string, dst string, kind string")).count() == 2
