"""Queries of models, evidence, routes and corrections over the star schema, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import models, packing, semantics
from braidwork.plans.registry import query


@query(
    """WITH n AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 1), e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 10 = 3)
       SELECT 'duplicate_node' AS kind, CAST(node AS VARCHAR) AS ref FROM n GROUP BY node HAVING count(*) > 1
       UNION ALL SELECT 'unknown_source', CAST(id AS VARCHAR) FROM e WHERE src NOT IN (SELECT node FROM n) UNION ALL SELECT 'unknown_target', CAST(id AS VARCHAR) FROM e WHERE dst NOT IN (SELECT node FROM n)
       UNION ALL SELECT 'without_evidence', CAST(node AS VARCHAR) FROM n WHERE node % 40 = 5"""
)
def integrity_faults(spark, table):
    orders = table("orders").select(F.col("o_orderkey").alias("node"))
    nodes = orders.where("node % 9 <> 0").unionAll(orders.where("node % 50 = 1")).withColumn("n_evidence", F.when(F.col("node") % 40 == 5, 0).otherwise(1))
    edges = table("lineitem").where("l_linenumber = 1 AND l_suppkey % 10 = 3").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_orderkey AS src", "l_partkey AS dst")
    return models.integrity_faults(nodes, edges)


@query(
    """WITH m AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS scene_no FROM events)
       SELECT user_id, CAST(scene_no AS BIGINT) AS scene_no, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n_atoms FROM m GROUP BY ALL"""
)
def scene_assembly(spark, table):
    atoms = table("events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("accepted"))
    return models.scenes(atoms, "user_id", ["event_id"], "accepted")


@query(
    """WITH b AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS accepted FROM orders WHERE o_orderkey % 6 <> 0), c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'split' ELSE 'merge' END AS action FROM orders WHERE o_orderkey % 5 = 0)
       SELECT k, CASE WHEN b.k IS NOT NULL THEN coalesce(CASE action WHEN 'split' THEN true WHEN 'merge' THEN false END, accepted) END AS accepted,
              CASE WHEN b.k IS NULL THEN 'orphaned' WHEN action IS NULL THEN 'none' WHEN (action = 'split') = accepted THEN 'rejected' ELSE 'applied' END AS status FROM b FULL JOIN c USING (k)"""
)
def boundary_corrections(spark, table):
    k = F.col("o_orderkey")
    boundaries = table("orders").where("o_orderkey % 6 <> 0").select(k.alias("k"), (F.col("o_orderstatus") == "F").alias("accepted"))
    fixes = table("orders").where("o_orderkey % 5 = 0").select(k.alias("k"), F.when(k % 2 == 0, "split").otherwise("merge").alias("action"))
    return models.corrected(boundaries, fixes, "k")


@query(
    """WITH d AS (SELECT DISTINCT l_returnflag, l_linestatus, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_partkey) AS i FROM d)
       SELECT l_returnflag, l_linestatus, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) FILTER (i <= 60) AS evidence FROM r GROUP BY ALL"""
)
def capped_evidence(spark, table):
    return models.capped_evidence(table("lineitem"), ["l_returnflag", "l_linestatus"], "l_partkey")


@query(
    """WITH RECURSIVE c AS (SELECT p_partkey AS claim, (p_partkey * 3 + 1) % (SELECT count(*) FROM part) AS child FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, (p_partkey * 5 + 2) % (SELECT count(*) FROM part) FROM part WHERE p_size > 35), v AS (SELECT p_partkey AS claim, p_brand AS evidence FROM part WHERE p_size % 2 = 0),
       r(root, claim, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 9 = 1 UNION SELECT root, child, depth + 1 FROM r JOIN c USING (claim) WHERE depth < 4)
       SELECT root, evidence, min(depth) AS depth FROM r JOIN v USING (claim) GROUP BY ALL"""
)
def dag_evidence(spark, table):
    part, k = table("part"), F.col("p_partkey")
    n = part.count()
    none = F.lit(None)
    children = part.where("p_size > 10").select(k.alias("claim"), ((k * 3 + 1) % n).alias("child")).unionAll(part.where("p_size > 35").select(k, (k * 5 + 2) % n))
    claims = children.withColumn("evidence", none.cast("string")).unionByName(part.where("p_size % 2 = 0").select(k.alias("claim"), none.cast("long").alias("child"), F.col("p_brand").alias("evidence")))
    return models.claim_evidence(claims, part.where("p_partkey % 9 = 1").select(k.alias("claim")), 4)


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * 3 + 1) % (SELECT count(*) FROM part) AS dst FROM part WHERE p_size > 10 UNION SELECT p_partkey, (p_partkey * 5 + 2) % (SELECT count(*) FROM part) FROM part WHERE p_size > 25), k AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 7 = 0),
       r(start, node, n) AS (SELECT src, dst, 1 FROM e WHERE src % 4 = 3 UNION SELECT start, dst, n + 1 FROM r JOIN e ON src = node WHERE node NOT IN (SELECT node FROM k) AND n < 6)
       SELECT DISTINCT start, node AS control FROM r WHERE node IN (SELECT node FROM k)"""
)
def downstream_controls(spark, table):
    part, k = table("part"), F.col("p_partkey")
    n = part.count()
    edges = part.where("p_size > 10").select(k.alias("src"), ((k * 3 + 1) % n).alias("dst")).union(part.where("p_size > 25").select(k, (k * 5 + 2) % n)).distinct()
    return models.first_downstream(edges, part.where("p_partkey % 4 = 3").select(k.alias("node")), part.where("p_partkey % 7 = 0").select(k.alias("node")), 6)


@query(
    """SELECT p_partkey, CAST(CASE WHEN d >= 0 AND p_size >= 30 OR d < 0 AND p_size <= 30 THEN 0 WHEN d <> 0 AND ceil((30 - p_size) / CAST(d AS DOUBLE)) > 0 THEN ceil((30 - p_size) / CAST(d AS DOUBLE)) END AS BIGINT) AS repetitions
       FROM (SELECT p_partkey, p_size, CAST(p_partkey % 7 AS INT) - 3 AS d FROM part)"""
)
def loop_repetitions(spark, table):
    return table("part").select("p_partkey", models.loop_repetitions(F.col("p_size"), F.lit(30), (F.col("p_partkey") % 7).cast("int") - 3).alias("repetitions"))


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 11 = 0 THEN 'incomplete' WHEN event_id % 7 = 0 THEN 'best_known' WHEN event_id % 3 > 0 THEN 'prerequisites' ELSE 'confirmed' END
         ELSE CASE WHEN event_id % 11 = 0 THEN 'incomplete' WHEN event_id % 13 = 0 THEN 'dynamic' WHEN event_id % 5 < 3 AND event_id % 9 = 0 THEN 'state_infeasible' WHEN event_id % 5 < 3 THEN 'dynamic' ELSE 'no_static_route' END END AS status FROM events"""
)
def route_statuses(spark, table):
    k = F.col("event_id")
    return table("events").select("event_id", models.route_status(k % 2 == 0, k % 11 == 0, k % 7 == 0, k % 3, k % 13 == 0, k % 5 < 3, k % 9 == 0).alias("status"))


@query(
    """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'unresolved_dynamic_behavior' WHEN event_id % 2 = 0 AND event_id % 7 = 0 THEN 'reachable_under_inferred_requirements' WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'conditionally_reachable'
         WHEN event_id % 2 = 0 THEN 'proven_reachable' WHEN event_id % 5 = 0 THEN 'possibly_dead' WHEN event_id % 11 = 0 THEN 'unreachable_in_resolved_static_graph' ELSE 'proven_unreachable' END AS status FROM events"""
)
def node_reachability(spark, table):
    k = F.col("event_id")
    return table("events").select("event_id", semantics.node_reachability(k % 2 == 0, k % 13 == 0, k % 3 == 0, k % 7 == 0, k % 5 == 0, k % 11 == 0).alias("status"))


@query("SELECT o_custkey, o_orderkey, o_custkey || '/' || o_orderpriority || CASE WHEN n = 1 THEN '' ELSE '#' || n END AS selection_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)")
def selection_ids(spark, table):
    return models.selection_ids(table("orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS target, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'resolved' ELSE 'unresolved' END AS outcome FROM lineitem GROUP BY 1")
def choice_targets(spark, table):
    return models.single_targets(table("lineitem"), "l_orderkey", "l_suppkey")


@query(
    """WITH r AS (SELECT l_orderkey AS k, max(l_linestatus) AS t FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 20 GROUP BY 1)
       SELECT o_orderkey AS k, coalesce(t, o_orderpriority) AS text, CASE WHEN t IS NULL THEN 'structural' ELSE 'result' END AS origin FROM orders LEFT JOIN r ON k = o_orderkey"""
)
def section_assembly(spark, table):
    results = table("lineitem").where("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(F.when(F.col("l_quantity") > 20, F.col("l_linestatus"))).alias("text")).withColumn("accepted", F.col("text").isNotNull())
    return models.assembled(table("orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority"), results, "k", "o_orderpriority")


@query(
    """WITH s AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS z FROM conversations)
       SELECT conv_id, count(*) AS n_items, count(*) FILTER (z <= 600) AS n_shown, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (z <= 600), '') AS text FROM s GROUP BY conv_id"""
)
def input_packets(spark, table):
    return models.packets(table("conversations"), "conv_id", "turn", "text", 600)


@query(
    """WITH RECURSIVE t AS (SELECT user_id, event_id, event_type = 'purchase' AS b, event_id % 50 + 1 AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
       r(user_id, event_id, n, size, chunk, cut) AS (
         SELECT user_id, event_id, n, z, 0, z >= 120 OR b AND 2 * z >= 120 FROM t WHERE n = 1
         UNION ALL SELECT t.user_id, t.event_id, t.n, CASE WHEN r.cut THEN t.z ELSE r.size + t.z END, CASE WHEN r.cut THEN r.chunk + 1 ELSE r.chunk END,
           CASE WHEN r.cut THEN t.z >= 120 OR t.b AND 2 * t.z >= 120 ELSE r.size + t.z >= 120 OR t.b AND 2 * (r.size + t.z) >= 120 END FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
       SELECT user_id, event_id, chunk AS chunk_no FROM r"""
)
def boundary_chunks(spark, table):
    rows = table("events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("b"), (F.col("event_id") % 50 + 1).alias("z"))
    return packing.boundary_split(rows, "user_id", "event_id", "z", "b", 120)


@query(
    """WITH RECURSIVE t AS (SELECT user_id, event_id, row_number() OVER w - 1 AS n, event_id % 50 + 1 AS z, sum(event_id % 50 + 1) OVER w AS s,
         CASE WHEN event_id % 13 = 0 THEN 4 WHEN event_id % 7 = 0 THEN 3 WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS strength FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
       over AS (SELECT a.user_id, a.n AS start, min(b.n) AS stop FROM t a JOIN t b ON b.user_id = a.user_id AND b.n > a.n AND (b.n - a.n >= 12 OR b.s - a.s + a.z > 250) GROUP BY ALL),
       nexts AS (SELECT o.user_id, start, coalesce(arg_max(n + 1, strength * 1000000 + n) FILTER (strength > 0), stop) AS following FROM over o JOIN t ON t.user_id = o.user_id AND n BETWEEN greatest(start, stop - 5) AND stop - 1 GROUP BY o.user_id, start, stop),
       r(user_id, start, chunk) AS (SELECT user_id, 0, 0 FROM t WHERE n = 0 UNION ALL SELECT r.user_id, following, chunk + 1 FROM r JOIN nexts x ON x.user_id = r.user_id AND x.start = r.start)
       SELECT t.user_id, event_id, max(chunk) AS chunk_no FROM t JOIN r ON r.user_id = t.user_id AND r.start <= n GROUP BY ALL"""
)
def strong_cuts(spark, table):
    """Chunks of twelve events or a budget, cut after the kind that invites it most."""
    k = F.col("event_id")
    kind = F.when(k % 13 == 0, "ending").when(k % 7 == 0, "jump").when(k % 5 == 0, "choice").when(k % 3 == 0, "condition").otherwise("line")
    rows = table("events").select("user_id", k, kind.alias("kind"), (k % 50 + 1).alias("z"))
    return packing.strong_cuts(rows, "user_id", "event_id", "kind", "z", most_items=12, most_size=250, reach=4)


@query(
    """WITH s AS (SELECT l_suppkey, CAST(sum(l_partkey) AS BIGINT) AS tokens FROM lineitem GROUP BY 1), c AS (SELECT *, CAST(ceil(tokens / 10000.0) AS BIGINT) AS n_calls FROM s)
       SELECT l_suppkey, n_calls, CAST((SELECT coalesce(sum(CAST(ceil(n_calls / power(24, k)) AS BIGINT)), 0) FROM range(1, 12) t(k) WHERE ceil(n_calls / power(24, k - 1)) > 1) AS BIGINT) AS n_reductions, tokens, (tokens * 3 + 500000) // 1000000 AS cost FROM c"""
)
def run_estimates(spark, table):
    return packing.run_estimate(table("lineitem"), "l_suppkey", "l_partkey", 10_000, 24, 3)


@query("SELECT c_custkey AS id, 'pinned' AS origin FROM customer WHERE c_custkey % 10 = 0 UNION SELECT o_custkey, 'member' FROM orders WHERE o_orderkey % 100 = 7")
def pinned_union(spark, table):
    pinned = table("customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"), F.lit("pinned").alias("origin"))
    return pinned.union(table("orders").where("o_orderkey % 100 = 7").select("o_custkey", F.lit("member"))).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice < 5000 OR o_orderkey <= 2000) AND contains(lower(o_orderpriority), 'high') ORDER BY o_orderkey LIMIT 25")
def resumed_search(spark, table):
    """The next page of a text search after a cursor."""
    rows = table("orders").where((F.col("o_orderkey") > 2000) & (F.col("o_totalprice") >= 5000) & F.lower("o_orderpriority").contains("high"))
    return rows.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(25)


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_size DESC, p_partkey) AS place FROM part ORDER BY place LIMIT 200")
def composite_order(spark, table):
    """The first two hundred in an order of several keys, without case."""
    rows = table("part").select("p_partkey", "p_name", "p_size").orderBy(F.lower("p_name"), F.desc("p_size"), "p_partkey").limit(200)
    from pyspark.sql import Window

    return rows.select("p_partkey", F.row_number().over(Window.orderBy(F.lower("p_name"), F.desc("p_size"), "p_partkey")).alias("place"))
