"""Queries over scripts made from the orders: statements, typed control flow, beats, state and what follows from them, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions import text as T
from braidwork.operators import control_flow, graphs, semantics, state
from braidwork.operators import script_rows as S
from braidwork.operators.loops import written
from braidwork.plans.registry import query

#: Lines of an order's label by its status; a file a customer.
_SHAPES = {
    "F": ("label order_{k}:", '    "Order {k}"  # "note', "    call missing_{k}", "    return"),
    "O": ("label order_{k}:", "    menu:", '        "left" if total > 1000:', "            jump {next}", '        "right":', "            pass", "    $ total += 1"),
    "P": ("label order_{k}:", "    if flag == 1:", '        "yes: # no"', "    elif flag == 2 and total >= 10:", "        call {first}", "    jump expression target"),
}

#: The same in SQL: each order with the number of lines before it in its file.
_LAID = """laid AS (
  SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS k, o_orderstatus AS s,
         coalesce(sum(CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 7 ELSE 6 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
         CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 7 ELSE 6 END AS size, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt,
         min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS first_f FROM orders)"""

_FIRST = "firsts AS (SELECT path, b AS fb FROM laid WHERE k = first_f)"

_EDGES = f"""WITH {_LAID}, {_FIRST},
  after AS (SELECT *, CASE WHEN nxt IS NULL THEN 'end' ELSE CAST(b + size + 1 AS VARCHAR) END AS follows FROM laid),
  local(path, src, dst, kind) AS (
    SELECT path, CAST(b + 1 AS VARCHAR), CASE s WHEN 'P' THEN (b + 2) || ':if' ELSE CAST(b + 2 AS VARCHAR) END, 'label_entry' FROM after
    UNION ALL SELECT path, CAST(b + 2 AS VARCHAR), CAST(b + 3 AS VARCHAR), 'fallthrough' FROM after WHERE s = 'F'
    UNION ALL SELECT path, CAST(b + 3 AS VARCHAR), CAST(b + 4 AS VARCHAR), 'call_continuation' FROM after WHERE s = 'F'
    UNION ALL SELECT path, CAST(b + 3 AS VARCHAR), (b + 3) || ':unresolved', 'missing_call' FROM after WHERE s = 'F'
    UNION ALL SELECT path, (b + 2) || ':merge', CAST(b + 7 AS VARCHAR), 'fallthrough' FROM after WHERE s = 'O'
    UNION ALL SELECT path, CAST(b + 2 AS VARCHAR), (b + 2) || ':merge', 'menu_no_choice' FROM after WHERE s = 'O'
    UNION ALL SELECT path, CAST(b + 2 AS VARCHAR), CAST(b + i AS VARCHAR), 'menu_choice' FROM after, (VALUES (3), (5)) c(i) WHERE s = 'O'
    UNION ALL SELECT path, CAST(b + i AS VARCHAR), CAST(b + i + 1 AS VARCHAR), 'choice_body' FROM after, (VALUES (3), (5)) c(i) WHERE s = 'O'
    UNION ALL SELECT path, CAST(b + 4 AS VARCHAR), CASE WHEN nxt IS NULL THEN (b + 4) || ':unresolved' ELSE follows END, CASE WHEN nxt IS NULL THEN 'missing_jump' ELSE 'jump' END FROM after WHERE s = 'O'
    UNION ALL SELECT path, CAST(b + 6 AS VARCHAR), (b + 2) || ':merge', 'fallthrough' FROM after WHERE s = 'O'
    UNION ALL SELECT path, CAST(b + 7 AS VARCHAR), follows, 'fallthrough' FROM after WHERE s = 'O'
    UNION ALL SELECT path, (b + 2) || ':merge', CAST(b + 6 AS VARCHAR), 'fallthrough' FROM after WHERE s = 'P'
    UNION ALL SELECT path, (b + 2) || ':if', CAST(b + i AS VARCHAR), 'condition' FROM after, (VALUES (2), (4)) c(i) WHERE s = 'P'
    UNION ALL SELECT path, CAST(b + i AS VARCHAR), CAST(b + i + 1 AS VARCHAR), 'branch_body' FROM after, (VALUES (2), (4)) c(i) WHERE s = 'P'
    UNION ALL SELECT path, (b + 2) || ':if', (b + 2) || ':merge', 'condition_false' FROM after WHERE s = 'P'
    UNION ALL SELECT path, CAST(b + 3 AS VARCHAR), (b + 2) || ':merge', 'fallthrough' FROM after WHERE s = 'P'
    UNION ALL SELECT path, CAST(b + 5 AS VARCHAR), (b + 2) || ':merge', 'call_continuation' FROM after WHERE s = 'P'
    UNION ALL SELECT path, CAST(b + 5 AS VARCHAR), coalesce(CAST(fb + 1 AS VARCHAR), (b + 5) || ':unresolved'), CASE WHEN fb IS NULL THEN 'missing_call' ELSE 'call' END FROM after LEFT JOIN firsts USING (path) WHERE s = 'P'
    UNION ALL SELECT path, CAST(b + 6 AS VARCHAR), (b + 6) || ':unresolved', 'dynamic_jump' FROM after WHERE s = 'P'
    UNION ALL SELECT path, CAST(fb + 4 AS VARCHAR), (b + 2) || ':merge', 'return' FROM after JOIN firsts USING (path) WHERE s = 'P')"""


def script_lines(orders: DataFrame) -> DataFrame:
    """(path, line_no, line): a script a customer, a label an order."""
    by = W.partitionBy("o_custkey").orderBy("o_orderkey")
    name = lambda c: F.coalesce(F.concat(F.lit("order_"), c.cast("string")), F.lit("nowhere"))
    rows = orders.select(
        F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), name(F.lead("o_orderkey").over(by)).alias("next"),
        name(F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).over(W.partitionBy("o_custkey"))).alias("first"),
    )

    def filled(line: str):
        for field in ("k", "next", "first"):
            if f"{{{field}}}" in line:
                before, after = line.split(f"{{{field}}}")
                return F.concat(F.lit(before), F.col(field).cast("string"), F.lit(after))
        return F.lit(line)

    lines = F.coalesce(*[F.when(F.col("s") == s, F.array(*map(filled, shape))) for s, shape in _SHAPES.items()])
    rows = rows.withColumn("lines", lines).withColumn("before", F.coalesce(F.sum(F.size("lines")).over(W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.select("path", "before", F.posexplode("lines").alias("i", "line")).select("path", (F.col("before") + F.col("i") + 1).cast("long").alias("line_no"), "line")


def _statements(table) -> DataFrame:
    return written(S.statements(script_lines(table("orders"))))


@query(
    f"""WITH {_LAID}, {_FIRST}
        SELECT path, CAST(b + 1 AS BIGINT) AS stmt, 'label' AS kind, 'order_' || k AS label, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS condition FROM laid
        UNION ALL SELECT path, b + 2, 'statement', 'order_' || k, NULL, NULL FROM laid WHERE s = 'F'
        UNION ALL SELECT path, b + 3, 'call', 'order_' || k, 'missing_' || k, NULL FROM laid WHERE s = 'F'
        UNION ALL SELECT path, b + 4, 'return', 'order_' || k, NULL, NULL FROM laid WHERE s = 'F'
        UNION ALL SELECT path, b + 2, 'menu', 'order_' || k, NULL, NULL FROM laid WHERE s = 'O'
        UNION ALL SELECT path, b + 3, 'choice', 'order_' || k, NULL, 'total > 1000' FROM laid WHERE s = 'O'
        UNION ALL SELECT path, b + 4, 'jump', 'order_' || k, coalesce('order_' || nxt, 'nowhere'), NULL FROM laid WHERE s = 'O'
        UNION ALL SELECT path, b + 5, 'choice', 'order_' || k, NULL, NULL FROM laid WHERE s = 'O'
        UNION ALL SELECT path, b + 6, 'pass', 'order_' || k, NULL, NULL FROM laid WHERE s = 'O'
        UNION ALL SELECT path, b + 7, 'opaque', 'order_' || k, NULL, NULL FROM laid WHERE s = 'O'
        UNION ALL SELECT path, b + 2, 'branch', 'order_' || k, NULL, 'flag == 1' FROM laid WHERE s = 'P'
        UNION ALL SELECT path, b + 3, 'statement', 'order_' || k, NULL, NULL FROM laid WHERE s = 'P'
        UNION ALL SELECT path, b + 4, 'branch', 'order_' || k, NULL, 'flag == 2 and total >= 10' FROM laid WHERE s = 'P'
        UNION ALL SELECT path, b + 5, 'call', 'order_' || k, CASE WHEN first_f IS NULL THEN 'nowhere' ELSE 'order_' || first_f END, NULL FROM laid WHERE s = 'P'
        UNION ALL SELECT path, b + 6, 'jump', 'order_' || k, NULL, NULL FROM laid WHERE s = 'P'"""
)
def script_statements(spark, table):
    return _statements(table).select("path", "stmt", "kind", "label", "target", "condition")


@query(f"{_EDGES} SELECT path, src, dst, kind FROM local")
def flow_edges(spark, table):
    return control_flow.edges(_statements(table)).select("path", "src", "dst", "kind")


@query(f"{_EDGES} SELECT kind, count(*) AS n, count(DISTINCT path) AS n_files FROM local GROUP BY kind")
def flow_edge_counts(spark, table):
    """The histogram of a graph's edges."""
    return control_flow.edges(_statements(table)).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files"))


@query(f"WITH {_LAID} SELECT 'order_' || k AS name, path, CAST(b + 1 AS VARCHAR) AS node FROM laid")
def label_index(spark, table):
    return control_flow.labels(_statements(table))


@query(
    f"""WITH {_LAID}, {_FIRST} SELECT path, CAST(b + 3 AS VARCHAR) AS src, 'missing_call' AS kind FROM laid WHERE s = 'F'
        UNION ALL SELECT path, CAST(b + 4 AS VARCHAR), CASE WHEN nxt IS NULL THEN 'missing_jump' ELSE 'jump' END FROM laid WHERE s = 'O'
        UNION ALL SELECT path, CAST(b + 5 AS VARCHAR), CASE WHEN first_f IS NULL THEN 'missing_call' ELSE 'call' END FROM laid WHERE s = 'P'
        UNION ALL SELECT path, CAST(b + 6 AS VARCHAR), 'dynamic_jump' FROM laid WHERE s = 'P'"""
)
def resolved_transfers(spark, table):
    return control_flow.transfers(_statements(table)).select("path", "src", "kind")


@query(
    f"""{_EDGES} SELECT path, src, dst, CASE WHEN kind = 'call_continuation' THEN kind WHEN kind LIKE 'missing%' OR kind LIKE 'dynamic%' THEN 'unresolved' WHEN kind = 'menu_choice' THEN 'choice'
        WHEN kind IN ('condition', 'condition_false') THEN 'condition' WHEN kind = 'menu_no_choice' THEN 'fallthrough' ELSE kind END AS transition
        FROM local WHERE kind NOT IN ('label_entry', 'choice_body', 'branch_body')"""
)
def transition_kinds(spark, table):
    edges = control_flow.edges(_statements(table)).withColumn("transition", control_flow.transition_kind(F.col("kind")))
    return edges.where("transition IS NOT NULL").select("path", "src", "dst", "transition")


@query(
    f"""{_EDGES} SELECT CASE WHEN kind = 'label_entry' THEN 'entry' WHEN kind LIKE 'missing%' OR kind LIKE 'dynamic%' THEN 'unresolved' WHEN kind LIKE '%choice%' THEN 'choice'
        WHEN kind LIKE 'condition%' OR kind LIKE 'branch%' THEN 'condition' WHEN kind = 'jump' THEN 'jump' ELSE 'flow' END AS role, count(*) AS n FROM local GROUP BY ALL"""
)
def edge_roles(spark, table):
    return control_flow.edges(_statements(table)).groupBy(control_flow.base_role(F.col("kind")).alias("role")).agg(F.count("*").alias("n"))


@query(f"WITH {_LAID} SELECT path, CAST(b + 2 AS BIGINT) AS stmt, 'narration' AS kind, 'Order ' || k AS spoken FROM laid WHERE s = 'F' UNION ALL SELECT path, b + 3, 'narration', 'yes: # no' FROM laid WHERE s = 'P'")
def spoken_lines(spark, table):
    return semantics.spoken(_statements(table)).select("path", "stmt", F.col("spoken_kind").alias("kind"), "spoken")


@query(f"WITH {_LAID} SELECT 'order_' || k AS label, CASE WHEN s = 'O' THEN 'unknown' ELSE 'narrative' END AS scene_class FROM laid")
def scene_classes(spark, table):
    return semantics.scene_classes(_statements(table))


@query(
    f"""WITH {_LAID}, c AS (
          SELECT path, b + 3 AS stmt, 0 AS arm, 'total > 1000' AS own, '' AS prior FROM laid WHERE s = 'O' UNION ALL SELECT path, b + 5, 1, '', 'total > 1000' FROM laid WHERE s = 'O'
          UNION ALL SELECT path, b + 2, 0, 'flag == 1', '' FROM laid WHERE s = 'P' UNION ALL SELECT path, b + 4, 1, 'flag == 2 and total >= 10', 'flag == 1' FROM laid WHERE s = 'P')
        SELECT path, CAST(stmt AS BIGINT) AS stmt, arm, CASE WHEN own LIKE 'flag%' THEN 'if_branch' ELSE 'choice' END AS predicate,
               CASE WHEN own LIKE 'flag%' AND prior <> '' THEN 'not (' || prior || ') and (' || own || ')' WHEN own <> '' THEN '(' || own || ')' ELSE 'true' END AS guard FROM c"""
)
def arm_guards(spark, table):
    return semantics.arm_guards(_statements(table)).select("path", "stmt", "arm", "predicate", "guard")


@query(
    f"""WITH {_LAID} SELECT path, CAST(b + i AS BIGINT) AS stmt, status, variables FROM laid JOIN (VALUES ('O', 3, 'proven', 'total'), ('P', 2, 'proven', 'flag'), ('P', 4, 'proven', 'flag,total')) r(t, i, status, variables) ON s = t"""
)
def requirements(spark, table):
    found = state.requirements(_statements(table).where("condition IS NOT NULL"), "condition")
    return found.select("path", "stmt", "requirement.status", F.array_join("requirement.variables", ",").alias("variables"))


@query(f"WITH {_LAID} SELECT path, CAST(b + 7 AS BIGINT) AS stmt, 'increment' AS op, 'total' AS variable, '1' AS value, 'proven' AS status FROM laid WHERE s = 'O'")
def effects(spark, table):
    found = state.effects(_statements(table).where("kind = 'opaque'"), "text")
    return found.select("path", "stmt", "effect.op", "effect.variable", "effect.value", "effect.status").where("op IS NOT NULL")


@query(
    f"""WITH {_LAID}, r AS (SELECT 'total' AS variable, path || ':' || (b + 3) AS id, 1 AS r FROM laid WHERE s = 'O' UNION ALL SELECT 'flag', path || ':' || (b + 2), 1 FROM laid WHERE s = 'P'
          UNION ALL SELECT v, path || ':' || (b + 4), 1 FROM laid, (VALUES ('flag'), ('total')) x(v) WHERE s = 'P' UNION ALL SELECT 'total', path || ':' || (b + 7), 0 FROM laid WHERE s = 'O')
        SELECT variable, CASE variable WHEN 'flag' THEN 'flag' ELSE 'unknown' END AS category, upper(substr(variable, 1, 1)) || substr(variable, 2) AS display_name, sum(r)::BIGINT AS n_reads, sum(1 - r)::BIGINT AS n_writes, min(id) AS first_id FROM r GROUP BY variable"""
)
def variable_registry(spark, table):
    statements = _statements(table)
    at = F.concat_ws(":", "path", F.col("stmt").cast("string")).alias("id")
    reads = state.requirements(statements.where("condition IS NOT NULL"), "condition").select(F.explode("requirement.variables").alias("variable"), at)
    writes = state.effects(statements.where("kind = 'opaque'"), "text").select("effect.variable", at)
    return state.variable_registry(reads, writes)


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def script_roots(spark, table):
    """The entries of all scripts: each file's first label."""
    firsts = _statements(table).where("kind = 'label'").groupBy("path").agg(F.min("stmt").alias("stmt"))
    return firsts.where("stmt = 1").agg(F.count("*").alias("n"))


def _flow(statements) -> DataFrame:
    edges = written(control_flow.edges(statements))
    return edges.select(F.concat_ws("/", "path", "src").alias("src"), F.concat_ws("/", "dst_path", "dst").alias("dst"), "kind")


@query(
    _EDGES.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT path || '/' || src AS src, path || '/' || dst AS dst FROM local),
        r(node) AS (SELECT path || '/1' FROM laid WHERE b = 0 UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r"""
)
def reached_statements(spark, table):
    """What is reached from the first label of its script; ids are texts."""
    statements = _statements(table)
    return control_flow.reached(control_flow.edges(statements), statements.where("stmt = 1").select("path", F.lit("1").alias("node")))


@query(
    f"""{_EDGES}, e AS (SELECT path || '/' || src AS src, path || '/' || dst AS dst, kind FROM local), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
        SELECT node, CASE WHEN node LIKE '%/end' THEN 'module_end' WHEN node LIKE '%:unresolved' THEN 'unresolved' ELSE 'dead_end' END AS terminal
        FROM n WHERE node NOT IN (SELECT src FROM e)"""
)
def flow_ends(spark, table):
    """Nodes without a way out, by what they are."""
    edges = _flow(_statements(table))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    kind = F.when(F.col("node").endswith("/end"), "module_end").when(F.col("node").endswith(":unresolved"), "unresolved").otherwise("other")
    rows = nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node", kind.alias("kind"), F.lit("").alias("label"))
    return graphs.terminals(rows, edges, rows.select("label").limit(0))


@query(f"WITH {_LAID} SELECT path, CAST(b + 2 AS BIGINT) AS stmt, 2 AS n_arms, 1 AS n_conditions, 'impossible' AS no_choice FROM laid WHERE s = 'O'")
def menu_feasibility(spark, table):
    """Whether a menu can be left without a choice: not if an arm has no condition."""
    return semantics.menu_feasibility(_statements(table))


@query(f"WITH {_LAID} SELECT path, 'order_' || k AS label, CAST(size AS BIGINT) AS n_lines, CAST(b + 1 AS BIGINT) AS start_line, CAST(b + size AS BIGINT) AS end_line FROM laid")
def label_spans(spark, table):
    return semantics.label_spans(_statements(table))


@query(f"WITH {_LAID} SELECT path, CAST(sum(size) AS BIGINT) AS n_source, CAST(0 AS BIGINT) AS n_blank, CAST(0 AS BIGINT) AS n_comment FROM laid GROUP BY path")
def line_ledger(spark, table):
    kind = T.source_kind(F.col("line"))
    return script_lines(table("orders")).groupBy("path").agg(F.count_if(~kind.isin("blank", "comment")).alias("n_source"), F.count_if(kind == "blank").alias("n_blank"), F.count_if(kind == "comment").alias("n_comment"))


@query(
    f"""WITH {_LAID} SELECT path, count(*) FILTER (s = 'O') AS menus, 2 * count(*) FILTER (s = 'O') AS arms, count(*) FILTER (s = 'O') + 2 * count(*) FILTER (s = 'P') AS conditions, count(*) FILTER (s <> 'P') + 2 * count(*) FILTER (s = 'P') AS transfers FROM laid GROUP BY path"""
)
def script_density(spark, table):
    rows = _statements(table)
    kind = F.col("kind")
    return rows.groupBy("path").agg(F.count_if(kind == "menu").alias("menus"), F.count_if(kind == "choice").alias("arms"), F.count_if(F.col("condition").isNotNull()).alias("conditions"), F.count_if(kind.isin("jump", "call")).alias("transfers"))
