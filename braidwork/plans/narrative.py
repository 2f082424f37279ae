"""Queries of beats, dispatch splits, dependencies between files and what may be reused, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions import text as T
from braidwork.operators import control_flow, loops, semantics, state
from braidwork.operators import versions as V
from braidwork.operators.loops import written
from braidwork.plans.read_models import _EDGES, _edges, places
from braidwork.plans.registry import query


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT o_orderkey AS node, o_custkey AS label, o_orderkey % 4 > 0 AS told FROM orders),
        links AS (SELECT src, dst FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE e.kind = 'fallthrough' AND src <> dst AND a.told AND b.told AND a.label = b.label
          AND (SELECT count(*) FROM e x WHERE x.src = e.src) = 1 AND (SELECT count(*) FROM e x WHERE x.dst = e.dst) = 1),
        r(node, beat, place) AS (SELECT node, node, 0 FROM n WHERE node NOT IN (SELECT dst FROM links) UNION ALL SELECT dst, beat, place + 1 FROM r JOIN links ON src = node)
        SELECT node, beat, place FROM r"""
)
def story_beats(spark, table):
    """Runs of narrative orders that follow each other alone."""
    nodes = places(table).select(F.col("k").alias("node"), F.col("c").alias("label"), F.when(F.col("k") % 4 > 0, "narrative").otherwise("structure").alias("claim"))
    return semantics.beats(nodes, _edges(table))


@query(
    """WITH arms AS (SELECT l_orderkey AS split, 'v' || (CASE WHEN l_orderkey % 6 = 0 THEN l_linenumber ELSE l_orderkey END % 5) AS variable, CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 2 THEN '>' ELSE '==' END AS op, l_linenumber % 3 AS value FROM lineitem),
       writes AS (SELECT DISTINCT 'v' || (p_partkey % 5) AS variable, CASE p_partkey % 5 WHEN 3 THEN p_size % 2 WHEN 4 THEN 1 ELSE p_size % 3 END AS value FROM part)
       SELECT split, min(variable) AS variable FROM arms GROUP BY split
       HAVING count(*) >= 2 AND count(DISTINCT variable) = 1 AND bool_and(op = '==') AND (SELECT count(*) FROM writes w WHERE w.variable = min(arms.variable)) >= 2
          AND NOT EXISTS (SELECT 1 FROM arms b WHERE b.split = arms.split AND NOT EXISTS (SELECT 1 FROM writes w WHERE w.variable = b.variable AND w.value = b.value))"""
)
def dispatching_splits(spark, table):
    """Splits whose arms tell values of one variable apart that are all written somewhere."""
    named = lambda c: F.concat(F.lit("v"), (c % 5).cast("string")).alias("variable")
    k, i, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("p_partkey")
    arms = table("lineitem").select(k.alias("split"), i.alias("arm"), named(F.when(k % 6 == 0, i).otherwise(k)), F.when((k % 7 == 0) & (i == 2), ">").otherwise("==").alias("op"), (i % 3).cast("int").alias("value"))
    writes = table("part").select(named(p), F.when(p % 5 == 3, F.col("p_size") % 2).when(p % 5 == 4, 1).otherwise(F.col("p_size") % 3).cast("int").alias("value"))
    return state.dispatch_splits(arms, writes)


#: Labels by customer, some names standing twice, and transfers by order; a file a nation.
_FILES = """l AS (SELECT 'f' || c_nationkey AS path, c_custkey AS stmt, 'c' || CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS name FROM customer),
  f AS (SELECT name, arg_min(path, {'p': path, 's': stmt}) AS path FROM l GROUP BY name), t AS (SELECT 'f' || (o_orderkey % 25) AS path, 'c' || o_custkey AS target FROM orders WHERE o_orderkey % 20 < 2)"""


def _files(table) -> DataFrame:
    none, k = F.lit(None).cast("string"), F.col("c_custkey")
    name = F.concat(F.lit("c"), F.when(k % 10 == 1, k - 1).otherwise(k).cast("string"))
    labels = table("customer").select(F.concat(F.lit("f"), "c_nationkey").alias("path"), k.alias("stmt"), F.lit("label").alias("kind"), name.alias("name"), none.alias("target"), none.alias("expression"))
    moves = table("orders").where("o_orderkey % 20 < 2").select(
        F.concat(F.lit("f"), F.col("o_orderkey") % 25).alias("path"), F.col("o_orderkey").alias("stmt"), F.when(F.col("o_orderkey") % 2 == 0, "jump").otherwise("call").alias("kind"), none.alias("name"), F.concat(F.lit("c"), "o_custkey").alias("target"), none.alias("expression")
    )
    return written(labels.unionByName(moves))


@query(f"WITH {_FILES} SELECT DISTINCT t.path, f.path AS needs FROM t JOIN f ON f.name = t.target WHERE t.path <> f.path")
def file_dependencies(spark, table):
    """Files that jump or call into other files."""
    return control_flow.dependencies(_files(table))


@query(f"WITH RECURSIVE {_FILES}, d AS (SELECT DISTINCT t.path, f.path AS needs FROM t JOIN f ON f.name = t.target WHERE t.path <> f.path), r(path) AS (SELECT 'f3' UNION SELECT d.path FROM r JOIN d ON d.needs = r.path) SELECT path FROM r")
def dependent_files(spark, table):
    """Files that a change of one file reaches, over any number of others."""
    needs = control_flow.dependencies(_files(table)).select(F.col("path").alias("src"), F.col("needs").alias("dst"))
    return loops.breadth_first(loops.reversed_edges(needs), spark.createDataFrame([("f3",)], "node string")).select(F.col("node").alias("path"))


@query(f"WITH {_FILES} SELECT name, count(*) AS n FROM l GROUP BY name HAVING count(*) > 1")
def duplicate_labels(spark, table):
    """Labels that stand more than once."""
    return control_flow.duplicate_labels(_files(table))


@query("SELECT n_nationkey AS phase, n_nationkey < (SELECT min(n_nationkey) FROM nation WHERE n_nationkey % 18 = 17) AS reuse FROM nation")
def reusable_phases(spark, table):
    """Phases whose input and that of all phases before is what it was."""
    before = table("nation").select(F.col("n_nationkey").alias("phase"), F.col("n_name").alias("digest"))
    now = before.withColumn("digest", F.when(F.col("phase") % 18 == 17, F.concat("digest", F.lit("*"))).otherwise(F.col("digest")))
    return V.reusable(before, now, "phase", "digest")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 50 < 2)")
def rows_without_dependants(spark, table):
    """Orders of which no part changed or went."""
    parts = table("part").select(F.col("p_partkey").alias("o_orderkey"), F.when(F.col("p_partkey") % 50 == 0, "changed").when(F.col("p_partkey") % 50 == 1, "removed").otherwise("unchanged").alias("status"))
    needs = table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("needs"))
    return V.without_dependants(table("orders").select("o_orderkey"), needs, parts, "o_orderkey")


@query("SELECT p_partkey, upper(x[1]) || substr(x, 2) AS label FROM (SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(replace(p_name, ' ', '_') || 'Part-No.' || p_partkey, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[._\\-]+', ' ', 'g'))) AS x FROM part)")
def readable_labels(spark, table):
    """Identifiers as labels: words apart, the first letter a capital."""
    return table("part").select("p_partkey", T.readable(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("Part-No."), "p_partkey")).alias("label"))
