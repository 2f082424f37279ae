"""Queries over scripts with every lexical turn: quotes and brackets over several lines, local labels, nested menus and ifs, comments, odd ends.

A label a customer, files of fifty. The SQL reads the same text character by character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions import text as T
from braidwork.operators import control_flow, semantics, state
from braidwork.operators import script_rows as S
from braidwork.operators.lexing import logical_lines
from braidwork.operators.loops import written
from braidwork.plans.registry import query

#: Scripts by the customer's number, mod 8. The last kind never ends its quote and is a file of its own.
SHAPES = (
    'label c_{k}:\n    """\n    Oh no :( # no comment\n    jump nowhere\n    """\n    e "said (" # a comment )\n    extend " and on"\n    return',
    'label c_{k}:\n    e "this goes\n  on \\"here\\"\n    and ends" with fade\n    $ money += 5\n    jump c_{k}',
    'label c_{k}:\n    call far(1, [2,  # inner ) comment\n  3], ")") from back_{k}\n    jump .inner\nlabel .inner:\n    $ flag = True\n    return',
    'label c_{k}:\n    menu:\n        "Pick: {k}"\n        "Left \\"quoted\\"" if money >= 10 and not flag:\n            if love > 3:\n                "deep"\n                $ love -= 1\n            elif not met:\n                jump .inner'
    '\n            else:\n                menu:\n                    "again":\n                        pass\n                    \'stop\' if name == "x":\n                        return\n        "Right":\n            $ met = compute(money)\n    scene bg room',
    'label c_{k}:\n\n# whole comment "with a quote\n    $ total = 1 + \\\n        2\n    show eileen happy\n    while x:\n        $ x = 0\n    python:\n        y = {"a": [1,\n            2]}\n    call expression target',
    'label c_{k}:\n"flat line"\n\n\ncall screen board\njump c_missing_{k}',
    "default money = 0\nlabel c_{k}:\n    'it\\'s \\\\'\n    n '''tri'ple'''\n    menu:\n        \"only\" if a + 1 > 2:\n            pass\n        \"other\" if f():\n            $ obj.attr = 3\n    if b in c:\n        $ add_point('a')\n    return",
    'label bad_{k}:\n    pass\n    e "never closed\n    jump c_{k}\n',
)

_K = len(SHAPES)


def script_lines(customer: DataFrame) -> DataFrame:
    """(path, line_no, line) of the customers' scripts."""
    table = [(shape, i, line) for shape, text in enumerate(SHAPES) for i, line in enumerate(text.split("\n"))]
    sizes = F.get(F.array(*[F.lit(text.count("\n") + 1) for text in SHAPES]), F.col("shape"))
    rows = customer.select(F.col("c_custkey").alias("k")).withColumn("shape", (F.col("k") % _K).cast("int"))
    rows = rows.withColumn("path", F.when(F.col("shape") == _K - 1, F.concat(F.lit("bad"), "k")).otherwise(F.concat(F.lit("f"), F.floor(F.col("k") / 50))))
    before = F.coalesce(F.sum(sizes).over(W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    templates = F.broadcast(customer.sparkSession.createDataFrame(table, "shape int, i int, template string"))
    return rows.withColumn("before", before).join(templates, "shape").select("path", (F.col("before") + F.col("i") + 1).cast("long").alias("line_no"), F.replace("template", F.lit("{k}"), F.col("k").cast("string")).alias("line"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The files as text, and their logical lines by a fold over characters: what is open, and the text without comments, newlines inside a logical line as chr(2).
_LEXED = f"""WITH shapes(shape, n, body) AS (VALUES {", ".join(f"({i}, {t.count(chr(10)) + 1}, {_quoted(t)})" for i, t in enumerate(SHAPES))}),
  files AS (
    SELECT CASE WHEN shape = {_K - 1} THEN 'bad' || c_custkey ELSE 'f' || (c_custkey // 50) END AS path, string_agg(replace(body, '{{k}}', c_custkey::VARCHAR), chr(10) ORDER BY c_custkey) AS content
    FROM customer JOIN shapes ON shape = c_custkey % {_K} GROUP BY 1),
  chars AS (SELECT path, list_transform(range(1, length(content) + 1), lambda i: {{'tri': substr(content, i, 3), 'q': '', 'e': false, 'd': 0, 'c': false, 'skip': 0, 'lead': false, 'cont': false, 'out': ''}}) AS cs FROM files),
  folded AS (
    SELECT path, list_reduce(list_prepend({{'tri': '', 'q': '', 'e': false, 'd': 0, 'c': false, 'skip': 0, 'lead': false, 'cont': false, 'out': ''}}, cs), lambda a, x:
      CASE WHEN a.skip > 0 THEN {{'tri': '', 'q': a.q, 'e': false, 'd': a.d, 'c': false, 'skip': a.skip - 1, 'lead': false, 'cont': false, 'out': a.out || x.tri[1]}}
      WHEN x.tri[1] = chr(10) AND (a.q <> '' OR a.d > 0 OR a.cont) THEN {{'tri': '', 'q': a.q, 'e': a.e, 'd': a.d, 'c': false, 'skip': 0, 'lead': true, 'cont': false, 'out': a.out || chr(2)}}
      WHEN x.tri[1] = chr(10) THEN {{'tri': '', 'q': '', 'e': false, 'd': 0, 'c': false, 'skip': 0, 'lead': false, 'cont': false, 'out': a.out || chr(10)}}
      WHEN a.c OR a.lead AND x.tri[1] IN (' ', chr(9)) THEN {{'tri': '', 'q': a.q, 'e': a.e, 'd': a.d, 'c': a.c, 'skip': 0, 'lead': a.lead, 'cont': a.cont, 'out': a.out}}
      WHEN a.q = '' THEN {{'tri': '', 'q': CASE WHEN x.tri IN ('''''''', '\"\"\"') THEN x.tri WHEN x.tri[1] IN ('''', '\"') THEN x.tri[1] ELSE '' END, 'e': false,
        'd': CASE WHEN x.tri[1] IN ('(', '[', '{{') THEN a.d + 1 WHEN x.tri[1] IN (')', ']', '}}') THEN greatest(a.d - 1, 0) ELSE a.d END, 'c': x.tri[1] = '#', 'skip': CASE WHEN x.tri IN ('''''''', '\"\"\"') THEN 2 ELSE 0 END,
        'lead': false, 'cont': CASE WHEN x.tri[1] IN (' ', chr(9), '#') THEN a.cont ELSE x.tri[1] = '\\' END, 'out': CASE WHEN x.tri[1] = '#' THEN a.out ELSE a.out || x.tri[1] END}}
      WHEN length(a.q) = 3 AND x.tri = a.q AND NOT a.e THEN {{'tri': '', 'q': '', 'e': false, 'd': a.d, 'c': false, 'skip': 2, 'lead': false, 'cont': false, 'out': a.out || x.tri[1]}}
      ELSE {{'tri': '', 'q': CASE WHEN x.tri[1] = a.q AND NOT a.e THEN '' ELSE a.q END, 'e': x.tri[1] = '\\' AND NOT a.e, 'd': a.d, 'c': false, 'skip': 0, 'lead': false, 'cont': false, 'out': a.out || x.tri[1]}} END) AS s
    FROM chars),
  pieces AS (SELECT path, s.q <> '' OR s.d > 0 AS left_open, unnest(string_split(s.out, chr(10))) AS piece, generate_subscripts(string_split(s.out, chr(10)), 1) AS i, len(string_split(s.out, chr(10))) AS n FROM folded),
  laid AS (SELECT *, 1 + coalesce(sum(1 + length(piece) - length(replace(piece, chr(2), ''))) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_line FROM pieces),
  flat AS (
    SELECT path, start_line, start_line + length(piece) - length(replace(piece, chr(2), '')) AS end_line, length(piece) - length(ltrim(piece, ' ' || chr(9))) AS indent,
           rtrim(ltrim(replace(regexp_replace(piece, '[ \\t]+' || chr(2), chr(2), 'g'), chr(2), chr(10)), ' ' || chr(9)), ' ' || chr(9) || chr(10)) AS code, CASE WHEN left_open AND i = n THEN 'unterminated' END AS fault
    FROM laid WHERE trim(replace(piece, chr(2), ' '), ' ' || chr(9)) <> ''),
  lexed AS (SELECT f.*, (SELECT max(b.start_line) FROM flat b WHERE b.path = f.path AND b.start_line < f.start_line AND b.indent < f.indent) AS parent FROM flat f)"""


def _statements(table) -> DataFrame:
    return written(S.statements(script_lines(table("customer"))))


@query(f"{_LEXED} SELECT path, start_line, end_line, indent, code, parent, fault FROM lexed")
def lexed_lines(spark, table):
    """Logical lines of scripts whose quotes, brackets and backslashes go over several lines."""
    return logical_lines(script_lines(table("customer"))).select("path", "start_line", "end_line", "indent", "code", "parent", "fault")


@query(f"{_LEXED} SELECT path, fault AS code, start_line FROM lexed WHERE fault IS NOT NULL")
def script_faults(spark, table):
    """Files that end inside a quote; nothing else is wrong with these scripts."""
    return S.diagnostics(script_lines(table("customer")))


#: Statement rows from the lexed lines: blocks by parent, labels carried on, kinds by the first word.
_ROWS = f"""{_LEXED},
  worded AS (SELECT *, CASE WHEN code LIKE '$%' THEN '$' ELSE regexp_extract(code, '^[\\p{{L}}\\p{{N}}_]*') END AS word, code LIKE '%:' AS opens FROM lexed WHERE fault IS NULL),
  tailed AS (SELECT *, trim(substr(code, length(word) + 1)) AS tail, word = 'label' AND opens AS is_label FROM worded),
  named AS (
    SELECT *, CASE WHEN is_label THEN regexp_extract(tail, '^[\\p{{L}}\\p{{N}}_.]+') END AS own, is_label AND lead(indent) OVER f = indent AND lead(word) OVER f <> 'label' AS flat FROM tailed WINDOW f AS (PARTITION BY path ORDER BY start_line)),
  owned AS (
    SELECT *, last_value(CASE WHEN is_label AND own NOT LIKE '.%' THEN own END IGNORE NULLS) OVER u AS current, last_value(CASE WHEN is_label THEN start_line END IGNORE NULLS) OVER u AS label_at
    FROM named WINDOW u AS (PARTITION BY path ORDER BY start_line ROWS UNBOUNDED PRECEDING)),
  placed AS (
    SELECT o.* EXCLUDE (parent), CASE WHEN o.is_label OR NOT coalesce(l.flat, false) OR o.parent IS NOT NULL THEN o.parent ELSE o.label_at END AS parent, CASE WHEN l.own LIKE '.%' THEN o.current || l.own ELSE l.own END AS label
    FROM owned o JOIN owned l ON l.path = o.path AND l.start_line = o.label_at),
  rows_ AS (
    SELECT p.*, a.word AS above, g.word AS grand, a.is_label AS under_label FROM placed p
    LEFT JOIN placed a ON a.path = p.path AND a.start_line = p.parent LEFT JOIN placed g ON g.path = p.path AND g.start_line = a.parent),
  kinds AS (
    SELECT *, CASE WHEN is_label THEN 'label' WHEN above = 'menu' THEN CASE WHEN opens THEN 'choice' ELSE 'caption' END WHEN word = 'call' AND tail LIKE 'screen%' THEN 'opaque' WHEN word IN ('jump', 'call', 'return', 'menu') THEN word
      WHEN word IN ('if', 'elif', 'else') THEN 'branch' WHEN word IN ('$', 'python', 'while') THEN 'opaque' WHEN word IN ('scene', 'show', 'pass') THEN word ELSE 'statement' END AS kind
    FROM rows_ WHERE is_label OR under_label OR above IN ('menu', 'if', 'elif', 'else') OR grand = 'menu'),
  statements AS (
    SELECT path, start_line AS stmt, parent, kind, label, end_line, code,
      CASE WHEN kind IN ('jump', 'call') AND tail NOT LIKE 'expression%' THEN CASE WHEN tail LIKE '.%' THEN current ELSE '' END || regexp_extract(tail, '^[\\p{{L}}\\p{{N}}_.]+') END AS target,
      CASE WHEN kind IN ('jump', 'call') AND tail LIKE 'expression%' THEN trim(substr(tail, 11)) END AS expression,
      CASE WHEN kind = 'choice' THEN nullif(regexp_extract(code, '^(?:"(?:[^"\\\\]|\\\\.)*"|''[^'']*'') if (.*):$', 1), '') WHEN kind = 'branch' AND word <> 'else' THEN rtrim(tail, ':') END AS condition,
      CASE WHEN kind = 'choice' THEN replace(regexp_extract(code, '^["''](.*?[^\\\\])["'']', 1), '\\"', '"') END AS caption
    FROM kinds)"""


@query(f"{_ROWS} SELECT path, stmt, parent, kind, label, target, expression, condition, caption, end_line FROM statements")
def tangled_statements(spark, table):
    """Statement rows of scripts with local labels, nested menus and ifs, flat labels and texts that look like code."""
    return _statements(table).select("path", "stmt", "parent", "kind", "label", "target", "expression", "condition", "caption", "end_line")


#: What is known of each condition and each assignment that stands in ``SHAPES``, by hand.
_CONDITIONS = """conditions(condition, status, reason, variables) AS (VALUES
    ('money >= 10 and not flag', 'proven', NULL, 'flag,money'), ('love > 3', 'proven', NULL, 'love'), ('not met', 'proven', NULL, 'met'), ('name == "x"', 'proven', NULL, 'name'),
    ('a + 1 > 2', 'unresolved', 'computed_comparison_operand', 'a'), ('f()', 'unresolved', 'unsupported_or_dynamic_condition', 'f'), ('b in c', 'unresolved', 'unsupported_comparison_operator', 'b,c'))"""

_EFFECTS = """known(code, op, variable, status, reason) AS (VALUES
    ('$ money += 5', 'increment', 'money', 'proven', NULL), ('$ flag = True', 'assignment', 'flag', 'proven', NULL), ('$ love -= 1', 'decrement', 'love', 'proven', NULL),
    ('$ met = compute(money)', 'assignment', 'met', 'unresolved', 'computed_assignment_value'), ('$ obj.attr = 3', 'assignment', NULL, 'unresolved', 'dynamic_or_unsupported_assignment_target'),
    ('$ add_point(''a'')', 'call', NULL, 'possible', NULL))"""


@query(f"{_ROWS}, {_CONDITIONS} SELECT path, stmt, kind, status, reason, variables FROM statements JOIN conditions USING (condition)")
def tangled_requirements(spark, table):
    """Requirements of every status: proven, and unresolved for each reason that occurs."""
    found = state.requirements(_statements(table).where("condition IS NOT NULL"), "condition")
    return found.select("path", "stmt", "kind", "requirement.status", "requirement.reason", F.array_join(F.array_sort("requirement.variables"), ",").alias("variables"))


@query(f"{_ROWS}, {_EFFECTS} SELECT path, stmt, op, variable, status, reason FROM statements JOIN known USING (code)")
def tangled_effects(spark, table):
    """Effects of every kind and status: assignments, increments and decrements, calls, and what can't be told."""
    found = state.effects(_statements(table).where("kind = 'opaque' AND text NOT LIKE '$ total = %'"), "text")
    return found.select("path", "stmt", "effect.op", "effect.variable", "effect.status", "effect.reason").where("op IS NOT NULL")


@query(f"""{_ROWS} SELECT m.path, m.stmt, count(*)::INT AS n_arms, count(c.condition)::INT AS n_conditions, CASE WHEN count(*) = count(c.condition) THEN 'conditional' ELSE 'impossible' END AS no_choice
           FROM statements m JOIN statements c ON c.path = m.path AND c.parent = m.stmt AND c.kind = 'choice' WHERE m.kind = 'menu' GROUP BY m.path, m.stmt""")
def tangled_menus(spark, table):
    """Whether a menu can be left without a choice, for menus with and without an arm that always shows."""
    return semantics.menu_feasibility(_statements(table))


@query(f"""{_LEXED}, raw AS (SELECT path, unnest(string_split(content, chr(10))) AS line FROM files)
           SELECT path, count(*) FILTER (trim(line) <> '' AND NOT starts_with(ltrim(line), '#')) AS n_source, count(*) FILTER (trim(line) = '') AS n_blank, count(*) FILTER (starts_with(ltrim(line), '#')) AS n_comment FROM raw GROUP BY path""")
def tangled_ledger(spark, table):
    """Lines by what they hold, with blank lines and comments among them."""
    kind = T.source_kind(F.col("line"))
    lines = script_lines(table("customer"))
    return lines.groupBy("path").agg(F.count_if(~kind.isin("blank", "comment")).alias("n_source"), F.count_if(kind == "blank").alias("n_blank"), F.count_if(kind == "comment").alias("n_comment"))


@query(f"""{_ROWS} SELECT path, stmt, CASE WHEN code LIKE '"%' OR code LIKE '''%' THEN 'narration' ELSE 'dialogue' END AS kind, CASE WHEN code LIKE '"%' OR code LIKE '''%' THEN NULL ELSE word END AS speaker
           FROM (SELECT *, regexp_extract(code, '^[a-z]+') AS word FROM statements) WHERE kind = 'statement' AND code NOT LIKE 'default%' AND code NOT LIKE '\"\"\"%' AND word <> 'extend' AND code NOT LIKE '%' || chr(10) || '%' AND code NOT LIKE '%''''''%'""")
def tangled_speech(spark, table):
    """Narration and dialogue on one line."""
    found = semantics.spoken(_statements(table)).where("instr(text, '\n') = 0 AND text NOT LIKE '%\\'\\'\\'%' AND text NOT LIKE 'extend%'")
    return found.select("path", "stmt", F.col("spoken_kind").alias("kind"), "speaker")


@query(
    f"""{_ROWS}, labels AS (SELECT label AS name, min(path) AS path FROM statements WHERE kind = 'label' GROUP BY label)
        SELECT s.path, s.stmt, s.kind || CASE WHEN s.expression IS NOT NULL THEN ':dynamic' WHEN l.name IS NULL THEN ':missing' WHEN l.path <> s.path THEN ':other_file' ELSE ':here' END AS outcome
        FROM statements s LEFT JOIN labels l ON l.name = s.target WHERE s.kind IN ('jump', 'call')"""
)
def tangled_transfers(spark, table):
    """Transfers by outcome: to a label of the file, to none, or by an expression."""
    rows = _statements(table)
    labels = rows.where("kind = 'label'").groupBy("name").agg(F.min("path").alias("label_path"))
    found = control_flow.transfers(rows).select("path", F.col("src").cast("long").alias("stmt"), "kind")
    outcome = F.when(F.col("kind").startswith("dynamic"), ":dynamic").when(F.col("kind").startswith("missing"), ":missing")
    joined = found.join(rows.select("path", "stmt", F.col("kind").alias("word"), F.col("target").alias("name")), ["path", "stmt"]).join(labels, "name", "left")
    return joined.select("path", "stmt", F.concat("word", F.coalesce(outcome, F.when(F.col("label_path") != F.col("path"), ":other_file").otherwise(":here"))).alias("outcome"))
