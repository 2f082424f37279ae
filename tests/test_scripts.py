import random

from braidwork.operators import control_flow, loops, semantics, state
from braidwork.operators import script_rows as S
from braidwork.operators.lexing import logical_lines

SCRIPT = '''# a comment
default x = 1
label start:
    "Hello, # not a comment" # a comment
    e "Hi"
    menu:
        "Pick one"
        "Go" if x > 1:
            jump .inner
        "Stay":
            $ x += 2
    label .inner:
    call far(1,
        2) from here
    if x == 1:
        pass
    else:
        return
    while x:
        stop music
    jump expression name
label far:
"flat line"
return
'''


def _lines(spark, text=SCRIPT, path="a"):
    return spark.createDataFrame([(path, i + 1, x) for i, x in enumerate(text.split("\n"))], "path string, line_no long, line string")


def test_statements(spark):
    rows = {r.stmt: r for r in S.statements(_lines(spark)).collect()}
    assert {k: r.kind for k, r in rows.items()} == {
        3: "label", 4: "statement", 5: "statement", 6: "menu", 7: "caption", 8: "choice", 9: "jump", 10: "choice", 11: "opaque", 12: "label", 13: "call", 15: "branch", 16: "pass", 17: "branch", 18: "return",
        19: "opaque", 21: "jump", 22: "label", 23: "statement", 24: "return",
    }
    assert rows[8].condition == "x > 1" and rows[9].target == "start.inner" and rows[12].name == "start.inner" and rows[13].target == "far" and rows[13].end_line == 14
    assert (rows[21].target, rows[21].expression) == (None, "name") and rows[19].reason == "unsupported_control_flow" and rows[23].parent == 22


def test_edges(spark):
    edges = {(r.src, r.dst, r.kind) for r in control_flow.edges(S.statements(_lines(spark))).collect()}
    assert {("3", "4", "label_entry"), ("5", "6", "fallthrough"), ("6", "8", "menu_choice"), ("6", "6:merge", "menu_no_choice"), ("8", "9", "choice_body"), ("9", "12", "jump"), ("11", "6:merge", "fallthrough")} <= edges
    assert {("6:merge", "12", "fallthrough"), ("12", "13", "label_entry"), ("13", "15:if", "call_continuation"), ("13", "22", "call"), ("24", "15:if", "return")} <= edges
    assert {("15:if", "15", "condition"), ("15", "16", "branch_body"), ("16", "15:merge", "fallthrough"), ("17", "18", "branch_body"), ("15:merge", "19", "fallthrough"), ("19", "19:unresolved", "unresolved_behavior"), ("21", "21:unresolved", "dynamic_jump")} <= edges
    assert not any(k == "condition_false" for _, _, k in edges) and ("22", "23", "label_entry") in edges


def test_spoken_and_classes(spark):
    rows = S.statements(_lines(spark))
    said = {r.stmt: (r.spoken_kind, r.speaker, r.spoken) for r in semantics.spoken(rows).collect()}
    assert said == {4: ("narration", None, "Hello, # not a comment"), 5: ("dialogue", "e", "Hi"), 23: ("narration", None, "flat line")}
    assert {r.label: r.scene_class for r in semantics.scene_classes(rows).collect()} == {"start": "narrative", "start.inner": "unknown", "far": "narrative"}
    assert {r.code for r in S.diagnostics(_lines(spark, "label a:\n\tpass\n    menu:\nif x\n")).collect()} == {"tab_indent", "empty_menu", "malformed_if"}


def test_requirements_and_effects():
    assert state.requirement_of("a == 1 and not b")["status"] == "proven" and state.requirement_of("a + 1 > 2")["reason"] == "computed_comparison_operand"
    assert state.requirement_of("a in b")["reason"] == "unsupported_comparison_operator" and state.requirement_of("f()")["reason"] == "unsupported_or_dynamic_condition" and state.requirement_of("a =")["reason"] == "invalid_expression"
    assert [t["op"] for t in state.requirement_of("3 < a and b != 'x'")["terms"]] == [">", "!="]
    assert state.effect_of("$ x -= 3")["op"] == "decrement" and state.effect_of("x = y")["reason"] == "computed_assignment_value" and state.effect_of("add_point('a')")["status"] == "possible"
    assert state.effect_of("x.y = 1")["reason"] == "dynamic_or_unsupported_assignment_target" and state.effect_of("print(1)")["op"] is None
    assert state.truth({"a": 1}, "a > 0 or b") is True and state.truth({"a": 0}, "a > 0 or b") is None and state.truth({"a": 0}, "a > 0 and b") is False


def plain_logical_lines(lines):
    """(start, end, indent, code, fault) by one look at each character."""
    out, quote, escaped, depth, parts, start, indent = [], "", False, 0, [], 0, 0
    for number, line in enumerate(lines, 1):
        text = line.lstrip() if parts else line.lstrip(" \t")
        if not parts:
            start, indent = number, len(line) - len(text)
        kept, i = "", 0
        while i < len(text):
            three, c = text[i : i + 3], text[i]
            if quote and len(quote) == 3 and three == quote and not escaped:
                kept, i, quote = kept + three, i + 3, ""
            elif quote:
                if c == quote and not escaped:
                    quote = ""
                escaped = c == "\\" and not escaped
                kept, i = kept + c, i + 1
            elif three in ("'''", '"""'):
                quote, escaped, kept, i = three, False, kept + three, i + 3
            elif c == "#":
                break
            else:
                if c in "'\"":
                    quote, escaped = c, False
                depth = depth + 1 if c in "([{" else max(depth - 1, 0) if c in ")]}" else depth
                kept, i = kept + c, i + 1
        if parts or kept.strip():
            parts.append(kept.rstrip())
        if parts and not quote and not depth and not kept.rstrip().endswith("\\"):
            if code := "\n".join(parts).rstrip():
                out.append((start, number, indent, code, None))
            parts = []
    if parts and (code := "\n".join(parts).rstrip()):
        out.append((start, len(lines), indent, code, "unterminated" if quote or depth else None))
    return out


def test_logical_lines_against_single_characters(spark):
    rng = random.Random(9)
    bits = ['"', "'", '"""', "'''", "\\", "\\\\", '\\"', "(", ")", "[", "]", "{", "}", "#", " ", "    ", "a", "label x:", "jump b", "\t", "é", ":"]
    files = {f"f{k}": ["".join(rng.choice(bits) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 14))] for k in range(400)}
    rows = [(p, n, x) for p, lines in files.items() for n, x in enumerate(lines, 1)]
    found = {}
    for r in logical_lines(spark.createDataFrame(rows, "path string, line_no long, line string").repartition(6)).collect():
        found.setdefault(r.path, []).append(r)
    for path, lines in files.items():
        own = sorted(found.get(path, []), key=lambda r: r.start_line)
        assert [(r.start_line, r.end_line, r.indent, r.code, r.fault) for r in own] == plain_logical_lines(lines), lines
        for k, r in enumerate(own):
            assert r.parent == max((b.start_line for b in own[:k] if b.indent < r.indent), default=None)


def test_quotes_stay_open(spark):
    text = 'label a:\n    """\n    Oh no :(\n    """\n    jump b\nlabel b:\n    e "one\n  two # not a comment"\n    menu:\n        "It\\"s" if x:\n            pass\n        \'\'\'three\'\'\':\n            return\n    "left open'
    rows = {r.stmt: r for r in S.statements(_lines(spark, text)).collect()}
    assert {k: r.kind for k, r in rows.items()} == {1: "label", 2: "statement", 5: "jump", 6: "label", 7: "statement", 9: "menu", 10: "choice", 11: "pass", 12: "choice", 13: "return"}
    assert rows[7].text == 'e "one\ntwo # not a comment"' and rows[7].end_line == 8 and (rows[10].caption, rows[10].condition, rows[12].caption) == ('It"s', "x", "three")
    assert [(r.code, r.start_line) for r in S.diagnostics(_lines(spark, text)).collect()] == [("unterminated", 14)]


def test_statements_and_edges_send_no_table_to_the_driver(spark):
    lines = spark.createDataFrame([("a", 1, "label x:"), ("a", 2, "    menu:"), ("a", 3, '        "go":'), ("a", 4, "            jump y"), ("b", 1, "label y:"), ("b", 2, "    call x"), ("b", 3, "    return")], "path string, line_no long, line string")
    rows = S.statements(lines)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.stmt, r.parent, r.kind) for r in rows.collect()} == {("a", 1, None, "label"), ("a", 2, 1, "menu"), ("a", 3, 2, "choice"), ("a", 4, 3, "jump"), ("b", 1, None, "label"), ("b", 2, 1, "call"), ("b", 3, 1, "return")}
    assert "Broadcast" not in control_flow.edges(loops.written(rows))._jdf.queryExecution().executedPlan().toString()


def test_lines_are_sorted_once_and_nodes_once(spark):
    """Statement rows took windows in six orders, and edges looked up what stands around a node by joins of whole tables."""
    rows = S.statements(_lines(spark))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1 and plan.count("Exchange") == 1
    plan = control_flow.laid(loops.written(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def test_blocks_of_labels(spark):
    text = "label a:\n    pass\n    label .in:\n        show x\n        label .deep:\n            hide x\nlabel empty:\nlabel b:\npass\nlabel .c:\nif x:\n    return\nelse:\n    jump .c\nmenu:\n    label odd:\n        pass\n    'x':\n        pass"
    rows = {r.stmt: r for r in S.statements(_lines(spark, text)).collect()}
    assert {k: (r.parent, r.label, r.ordinal) for k, r in rows.items()} == {
        1: (None, "a", 0), 2: (1, "a", 0), 3: (1, "a.in", 1), 4: (3, "a.in", 0), 5: (3, "a.deep", 1), 6: (5, "a.deep", 0), 7: (None, "empty", 1), 8: (None, "b", 2), 9: (8, "b", 0), 10: (None, "b.c", 3), 11: (10, "b.c", 0),
        12: (11, "b.c", 0), 13: (10, "b.c", 1), 14: (13, "b.c", 0), 15: (10, "b.c", 2), 16: (15, "odd", 0), 17: (16, "odd", 0), 18: (15, "odd", 1), 19: (18, "odd", 0),
    }
    assert rows[13].chain == 11 and rows[14].target == "b.c"
    edges = {(r.src, r.dst, r.kind) for r in control_flow.edges(S.statements(_lines(spark, text))).collect()}
    assert {("6", "7", "fallthrough"), ("7", "8", "label_entry"), ("8", "9", "label_entry"), ("9", "10", "fallthrough"), ("10", "11:if", "label_entry"), ("11:merge", "15", "fallthrough"), ("15:merge", "end", "fallthrough")} <= edges


def test_reached_by_file(spark, monkeypatch):
    """Files by themselves in a few jobs; those that edges join, and large ones, in rounds, with the same result."""
    rng = random.Random(4)
    flow = [(f, str(rng.randrange(9)), f, str(rng.randrange(9))) for f in "abcdefgh" for _ in range(12)]
    crossing = [("a", str(rng.randrange(9)), "b", str(rng.randrange(9))), ("b", str(rng.randrange(9)), "c", str(rng.randrange(9))), (None, "1", "d", "2"), (None, "1", None, "7")]
    roots = [(f, "1") for f in "acdeh"] + [(None, "1"), ("z", "1")]
    schema = "path string, src string, dst_path string, dst string"

    def expected(edges):
        seen = set(roots)
        while more := {(q, b) for p, a, q, b in edges if (p, a) in seen} - seen:
            seen |= more
        return sorted("/".join(x for x in node if x) for node in seen)

    def found(edges):
        df = control_flow.reached(spark.createDataFrame(edges, schema), spark.createDataFrame(roots, "path string, node string"))
        return sorted(r.node for r in df.collect())

    spark.sparkContext.setJobGroup("reached", "file by file")
    assert found(flow) == expected(flow)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("reached"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs <= 15
    assert found(flow + crossing) == expected(flow + crossing)
    monkeypatch.setattr(control_flow.parts, "MOST_ROWS", 12)  # files with a root have a row more
    assert found(flow) == expected(flow)


def test_transfers_and_returns_meet_by_name(spark):
    """Names are matched by digest and text; rows without a target are spread, not put into one task."""
    text = "label a:\n    call far\n    jump expression x\n    jump\n    call gone\nlabel far:\n    return\nlabel far:\n    return"
    rows = loops.written(S.statements(_lines(spark, text)))
    assert {tuple(r)[1:] for r in control_flow.transfers(rows).collect()} == {("2", "a", "6", "call"), ("3", "a", "3:unresolved", "dynamic_jump"), ("4", "a", "4:unresolved", "missing_jump"), ("5", "a", "5:unresolved", "missing_call")}
    assert {(r.src, r.dst) for r in control_flow.edges(rows).where("kind = 'return'").collect()} == {("7", "3"), ("9", "3")}
    assert "xxhash64" in control_flow.transfers(rows)._jdf.queryExecution().executedPlan().toString()
