"""Queries of the read model, versions, packing and graph analysis over the star schema, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions import keys
from braidwork.functions import text as T
from braidwork.operators import graphs, packing, state
from braidwork.operators import read_model as M
from braidwork.operators import versions as V
from braidwork.operators.loops import written
from braidwork.plans.registry import query

_HASHED = "CAST('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8) AS BIGINT)"


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000 AND o_totalprice <= 200000")
def filtered_orders(spark, table):
    found = M.filtered(table("orders"), equal={"o_orderstatus": "F", "o_custkey": None}, within={"o_orderpriority": ("1-URGENT", "2-HIGH")}, ranges={"o_totalprice": (1000, 200000)})
    return found.select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e_') OR contains(lower(p_name), 'ar')")
def text_search(spark, table):
    part = table("part").select("p_partkey", "p_name")
    return M.containing(part, "p_name", "E_").union(M.containing(part, "p_name", "AR")).distinct()


@query(
    """WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'renamed ' || c_custkey END AS display_name, c_custkey % 9 = 0 AS hidden FROM customer WHERE c_custkey % 3 = 0)
       SELECT c_custkey, coalesce(display_name, c_name) AS title, coalesce(hidden, false) AS hidden FROM customer LEFT JOIN o USING (c_custkey)"""
)
def titled_nodes(spark, table):
    key = F.col("c_custkey")
    edits = table("customer").where("c_custkey % 3 = 0").select("c_custkey", F.when(key % 2 == 0, F.concat(F.lit("renamed "), key.cast("string"))).alias("display_name"), (key % 9 == 0).alias("hidden"))
    return M.titled(table("customer"), edits, "c_custkey", "c_name")


@query(
    """WITH n AS (SELECT lower(p_brand) AS needle FROM part ORDER BY p_partkey LIMIT 1),
       h AS (SELECT p_partkey, k, field, CASE WHEN v = needle THEN CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END WHEN starts_with(v, needle) THEN 4 WHEN contains(v, needle) THEN 5 END AS score
             FROM n, (SELECT p_partkey, 0 AS k, 'p_partkey' AS field, CAST(p_partkey AS VARCHAR) AS v FROM part UNION ALL SELECT p_partkey, 1, 'p_name', lower(p_name) FROM part UNION ALL SELECT p_partkey, 2, 'p_brand', lower(p_brand) FROM part))
       SELECT p_partkey, min(score) AS score, arg_min(field, score * 10 + k) AS field FROM h WHERE score IS NOT NULL GROUP BY p_partkey"""
)
def best_hits(spark, table):
    needle = table("part").orderBy("p_partkey").select("p_brand").first()[0]
    return M.best_hits(table("part"), "p_partkey", ["p_partkey", "p_name", "p_brand"], needle)


@query(
    """WITH n AS (SELECT p_partkey AS node, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent FROM part)
       SELECT a.node, coalesce(c.node, b.node, a.node) AS root, CASE WHEN c.node IS NOT NULL THEN 3 WHEN b.node IS NOT NULL THEN 2 ELSE 1 END AS depth,
              concat_ws('/', CAST(c.node AS VARCHAR), CAST(b.node AS VARCHAR), CAST(a.node AS VARCHAR)) AS path
       FROM n a LEFT JOIN n b ON b.node = a.parent LEFT JOIN n c ON c.node = b.parent WHERE a.node >= 1"""
)
def lineages(spark, table):
    nodes = table("part").where("p_partkey >= 1").select(F.col("p_partkey").alias("node"), F.expr("IF(p_partkey >= 10, p_partkey div 10, NULL)").alias("parent"))
    return M.lineage(nodes, "node", "parent")


#: Orders as nodes, an edge to the customer's next order and one to some order of the same customer: ids and graphs grow with the table.
_EDGES = """SELECT a.k AS src, b.k AS dst, CASE WHEN t.second THEN 'choice' WHEN a.s = 'O' THEN 'jump' ELSE 'fallthrough' END AS kind, a.k * 2 + CAST(t.second AS INT) AS id
    FROM (VALUES (false), (true)) t(second), (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) a
    JOIN (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) b
      ON b.c = a.c AND CASE WHEN t.second THEN a.k % 3 = 0 AND b.i = (a.i * 7 + a.k) % a.n ELSE a.k % 5 > 0 AND b.i = a.i + 1 END"""


def places(table) -> DataFrame:
    """(c, k, i, n, s): orders by customer, their place among the customer's and how many these are."""
    by = W.partitionBy("o_custkey")
    return table("orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), (F.row_number().over(by.orderBy("o_orderkey")) - 1).alias("i"), F.count("*").over(by).alias("n"), F.col("o_orderstatus").alias("s"))


def linked(at: DataFrame, when, to) -> DataFrame:
    """Rows of ``at`` where ``when`` holds, with ``dst``: the order at place ``to`` of the same customer."""
    return at.where(when).withColumn("to", to).join(at.select("c", F.col("i").alias("to"), F.col("k").alias("dst")), ["c", "to"])


def _edges(table) -> DataFrame:
    return graph_edges(table).drop("graph")


def graph_edges(table) -> DataFrame:
    """The edges with ``graph``, the customer that both ends belong to."""
    at = places(table)
    following = linked(at, F.col("k") % 5 > 0, F.col("i") + 1).select(F.col("k").alias("src"), "dst", F.when(F.col("s") == "O", "jump").otherwise("fallthrough").alias("kind"), (F.col("k") * 2).alias("id"), F.col("c").alias("graph"))
    some = linked(at, F.col("k") % 3 == 0, (F.col("i") * 7 + F.col("k")) % F.col("n")).select(F.col("k").alias("src"), "dst", F.lit("choice").alias("kind"), (F.col("k") * 2 + 1).alias("id"), F.col("c").alias("graph"))
    return following.unionByName(some)


@query(
    f"""WITH e AS ({_EDGES}), i AS (SELECT o_orderkey AS node FROM orders)
        SELECT node, (SELECT count(DISTINCT src) FROM e WHERE dst = node) AS n_in, (SELECT count(DISTINCT dst) FROM e WHERE src = node) AS n_out,
               coalesce((SELECT string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) FROM (SELECT DISTINCT src FROM e WHERE dst = node)), '') AS before,
               coalesce((SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) FROM (SELECT DISTINCT dst FROM e WHERE src = node)), '') AS after FROM i"""
)
def incident_edges(spark, table):
    return M.incident(_edges(table), table("orders").select(F.col("o_orderkey").alias("node")))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS a, CAST(epoch(o_orderdate) // 86400 AS BIGINT) + o_orderkey % 5 AS b FROM orders),
            s AS (SELECT o_custkey, -o_orderkey AS span, CAST(epoch(o_orderdate) // 86400 AS BIGINT) - 20 AS sa, CAST(epoch(o_orderdate) // 86400 AS BIGINT) + o_orderkey % 40 AS sb FROM orders)
       SELECT o_custkey, o_orderkey, span AS owner FROM (SELECT o_custkey, o_orderkey, span, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY sb - sa, -sa, span) AS n FROM r JOIN s USING (o_custkey) WHERE a <= sb AND sa <= b) WHERE n = 1"""
)
def overlap_owner(spark, table):
    day = F.expr("unix_date(CAST(o_orderdate AS DATE))").cast("long")
    orders = table("orders").select("o_custkey", "o_orderkey", day.alias("a"), (day + F.col("o_orderkey") % 5).alias("b"), (-F.col("o_orderkey")).alias("span"), (day - 20).alias("sa"), (day + F.col("o_orderkey") % 40).alias("sb"))
    return M.overlap_owner(orders, orders, "o_custkey", ("o_orderkey", "a", "b"), ("span", "sa", "sb"), 64)


@query(
    """WITH i AS (SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) AS at FROM events WHERE event_id % 4 <> 0), s AS (SELECT user_id, event_id AS section, CAST(epoch(ts) AS BIGINT) AS at FROM events WHERE event_id % 4 = 0)
       SELECT i.user_id, i.event_id, arg_min(section, (abs(s.at - i.at), s.at > i.at, CASE WHEN s.at > i.at THEN section ELSE -section END)) AS section FROM i LEFT JOIN s ON s.user_id = i.user_id GROUP BY ALL"""
)
def nearest_section(spark, table):
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at")  # whole seconds as the SQL rounds them
    rows = table("events").select("user_id", "event_id", at)
    return M.nearest_section(rows.where("event_id % 4 <> 0"), rows.where("event_id % 4 = 0").withColumnRenamed("event_id", "section"), "user_id", "event_id", "at", "section")


@query(
    """WITH f AS (SELECT CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS c1, l_partkey % 7 AS c2, l_suppkey % 5 AS c3, l_linestatus AS c4, l_quantity > 25 AS c5, l_discount > 0.05 AS c6, l_tax > 0.04 AS c7, l_partkey % 2 AS c8, l_suppkey % 2 AS c9, l_orderkey % 11 AS c10, l_returnflag AS value, l_orderkey AS id FROM lineitem),
            v AS (SELECT c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, value, count(*) AS n, min(id) AS first_id FROM f GROUP BY ALL)
       SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY c1, c2, c3, c4, c5, c6, c7, c8, c9, c10) AS scope_values FROM v) WHERE scope_values > 1"""
)
def scoped_contradictions(spark, table):
    """Facts that differ within a scope of ten columns, one of them null for some."""
    facts = table("lineitem").selectExpr(
        "IF(l_linenumber > 5, NULL, l_linenumber) AS c1", "l_partkey % 7 AS c2", "l_suppkey % 5 AS c3", "l_linestatus AS c4", "l_quantity > 25 AS c5", "l_discount > 0.05 AS c6", "l_tax > 0.04 AS c7",
        "l_partkey % 2 AS c8", "l_suppkey % 2 AS c9", "l_orderkey % 11 AS c10", "l_returnflag AS value", "l_orderkey AS id",
    )
    return M.contradicting_pairs(facts, [f"c{i}" for i in range(1, 11)], "value", "id")


@query("SELECT event_id, i AS ordinal, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + i AS VARCHAR) AS value FROM events, range(3) t(i)")
def unnested_arrays(spark, table):
    k = F.get_json_object("props", "$.k").cast("long")
    packed = table("events").select("event_id", F.to_json(F.struct(F.struct(F.array(k, k + 1, k + 2).alias("items")).alias("x"))).alias("json"))
    return M.unnested(packed, "event_id", "json", "x.items")


@query("SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS json FROM events")
def json_objects(spark, table):
    return table("events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("json"))


@query(
    """WITH n AS (SELECT l_suppkey, l_linenumber, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS nodes FROM lineitem WHERE l_quantity > 45 GROUP BY ALL)
       SELECT s_suppkey AS l_suppkey, i::INT AS l_linenumber, coalesce(nodes, '') AS nodes FROM supplier CROSS JOIN range(1, 4) t(i) LEFT JOIN n ON n.l_suppkey = s_suppkey AND n.l_linenumber = i"""
)
def nodes_by_location(spark, table):
    asked = table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("l_linenumber"))
    return M.by_location(asked, table("lineitem").where("l_quantity > 45"), ["l_suppkey", "l_linenumber"], "l_partkey")


@query(
    """WITH e AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders), f AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P')
       SELECT o_custkey, count(*) AS n_expected, count(f.o_orderkey) AS n_found, round(count(f.o_orderkey) / count(*), 6) AS recall FROM e LEFT JOIN f USING (o_custkey, o_orderkey) GROUP BY o_custkey"""
)
def set_recall(spark, table):
    return M.recall(table("orders"), table("orders").where("o_orderstatus <> 'P'"), "o_custkey", "o_orderkey")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chapter FROM events")
def carried_chapters(spark, table):
    rows = M.carried(table("events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("event_id")), "chapter")
    return rows.select("event_id", "chapter")


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, role = 'user' AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
       r(conv_id, turn, n, since, accepted) AS (SELECT conv_id, turn, n, 1, true FROM t WHERE n = 1
         UNION ALL SELECT t.conv_id, t.turn, t.n, CASE WHEN t.c AND r.since >= 3 THEN 1 ELSE r.since + 1 END, t.c AND r.since >= 3 FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
       SELECT conv_id, turn, accepted FROM r"""
)
def spaced_boundaries(spark, table):
    return M.spaced_boundaries(table("conversations").select("conv_id", "turn", (F.col("role") == "user").alias("c")), "conv_id", "turn", "c", 3)


@query(
    """WITH m AS (SELECT *, event_type = 'purchase' AS b, value > 50 AS s, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events)
       SELECT event_id, b AND max(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 AS supported FROM m"""
)
def supported_boundaries(spark, table):
    rows = table("events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("b"), (F.col("value") > 50).alias("s"))
    return M.supported_boundaries(rows, "user_id", "event_id", "b", "s").select("event_id", "supported")


@query(
    """SELECT CASE WHEN l_linenumber > 4 THEN NULL ELSE l_linenumber END AS k1, l_returnflag AS k2, l_linestatus AS k3, l_suppkey % 9 AS k4, count(*) AS n, string_agg(DISTINCT CAST(l_orderkey % 50 AS VARCHAR), ',' ORDER BY CAST(l_orderkey % 50 AS VARCHAR)) AS evidence FROM lineitem GROUP BY ALL"""
)
def coalesced_transitions(spark, table):
    rows = table("lineitem").selectExpr("IF(l_linenumber > 4, NULL, l_linenumber) AS k1", "l_returnflag AS k2", "l_linestatus AS k3", "l_suppkey % 9 AS k4", "l_orderkey % 50 AS e")
    return M.coalesced(rows, ["k1", "k2", "k3", "k4"], "e")


@query(
    """WITH l AS (SELECT conv_id, turn FROM conversations), c AS (SELECT conv_id, turn + 1 AS turn FROM conversations WHERE turn % 3 <> 0 UNION ALL SELECT conv_id, turn FROM conversations WHERE turn % 4 = 0),
            n AS (SELECT conv_id, turn, count(*) AS n FROM c GROUP BY ALL)
       SELECT conv_id, turn, CASE WHEN l.conv_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS outcome
       FROM (SELECT DISTINCT * FROM l) l FULL JOIN n USING (conv_id, turn) WHERE l.conv_id IS NULL OR n IS NULL OR n > 1"""
)
def leaf_citations(spark, table):
    turns = table("conversations").select("conv_id", "turn")
    cited = turns.where("turn % 3 <> 0").select("conv_id", (F.col("turn") + 1).alias("turn")).unionByName(turns.where("turn % 4 = 0"))
    return M.citations(turns, cited, "conv_id", "turn")


@query(
    """WITH m AS (SELECT conv_id, turn, turn % 3 = 1 AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations), l AS (SELECT *, a - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM m WHERE NOT g)
       SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS run_no, min(turn) AS first_at, max(turn) AS last_at, count(*) AS n FROM l GROUP BY conv_id, i"""
)
def fallback_runs(spark, table):
    rows = table("conversations").select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item"))
    return M.ungrouped_runs(rows, rows.where("turn % 3 = 1"), "conv_id", "turn", "item")


@query(
    """WITH a AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0)
       SELECT o_orderkey, a.v AS ours, b.v AS theirs FROM a FULL JOIN b USING (o_orderkey) WHERE a.v IS DISTINCT FROM b.v"""
)
def stage_disagreements(spark, table):
    rows = table("orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return M.disagreements(rows.where("o_orderkey % 7 <> 0"), rows.where("o_orderkey % 11 <> 0").withColumn("v", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("v"))), ["o_orderkey"], "v")


# Packing


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS z, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE length(text) <= 4000),
       r(conv_id, turn, n, items, size, bin) AS (SELECT conv_id, turn, n, 1, z, 0 FROM t WHERE n = 1
         UNION ALL SELECT t.conv_id, t.turn, t.n, CASE WHEN f THEN r.items + 1 ELSE 1 END, CASE WHEN f THEN r.size + t.z ELSE t.z END, CASE WHEN f THEN r.bin ELSE r.bin + 1 END
         FROM (SELECT r.*, t.turn AS tt FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1) q JOIN r ON r.conv_id = q.conv_id AND r.n = q.n JOIN t ON t.conv_id = q.conv_id AND t.n = q.n + 1, LATERAL (SELECT r.items + 1 <= 3 AND r.size + t.z <= 4000 AS f))
       SELECT conv_id, turn, bin AS bin_no FROM r"""
)
def packed_turns(spark, table):
    rows = table("conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size")).where("size <= 4000")
    return packing.next_fit(rows, "conv_id", "turn", {"size": 4000}, 3)


@query("SELECT o_custkey, o_orderkey, (row_number() OVER w - 1) * CAST(ceil(count(*) OVER (PARTITION BY o_custkey) / 4.0) AS BIGINT) // count(*) OVER (PARTITION BY o_custkey) AS slice_no FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def balanced_slices(spark, table):
    return packing.balanced_slices(table("orders"), "o_custkey", "o_orderkey", 4)


@query(
    """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT o_orderstatus, k, CAST(ceil(n / power(24, k)) AS BIGINT) AS n_nodes, lag(CAST(ceil(n / power(24, k)) AS BIGINT)) OVER (PARTITION BY o_orderstatus ORDER BY k) AS above FROM c, range(8) t(k))
       SELECT o_orderstatus, CAST(k AS INT) AS level, n_nodes FROM l WHERE k = 0 OR above > 1"""
)
def fan_in_levels(spark, table):
    return packing.fan_in_levels(table("orders"), "o_orderstatus")


@query("SELECT o_orderstatus, o_orderkey, (row_number() OVER w - 1) // 24 AS level_1, (row_number() OVER w - 1) // 576 AS level_2 FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)")
def fan_in_parents(spark, table):
    return packing.fan_in_parents(table("orders"), "o_orderstatus", "o_orderkey")


@query("SELECT c_nationkey, c_custkey, (row_number() OVER w - 1) // 30 AS page_no, (row_number() OVER w - 1) % 30 AS place FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def publication_pages(spark, table):
    return packing.pages(table("customer"), "c_nationkey", "c_custkey")


@query(
    """WITH e AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0), g AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
       SELECT o_orderkey, CASE WHEN e.o_orderkey IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM e FULL JOIN g USING (o_orderkey)"""
)
def batch_outcomes(spark, table):
    return packing.batch_outcome(table("orders").where("o_orderkey % 3 <> 0"), table("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


# Versions


_OLD = "SELECT doc_id, md5(text) AS digest, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'validated' END AS status FROM documents WHERE doc_id % 11 <> 0"
_NEW = "SELECT doc_id, md5(text || CASE WHEN doc_id % 13 = 0 THEN '!' ELSE '' END) AS digest FROM documents WHERE doc_id % 17 <> 0"


def _versions(table) -> tuple[DataFrame, DataFrame]:
    docs = table("documents").select("doc_id", "text")
    old = docs.where("doc_id % 11 <> 0").select("doc_id", F.md5("text").alias("digest"), F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("validated").alias("status"))
    return old, docs.where("doc_id % 17 <> 0").select("doc_id", F.md5(F.concat("text", F.when(F.col("doc_id") % 13 == 0, "!").otherwise(""))).alias("digest"))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT n.doc_id, n.digest, coalesce(o.digest = n.digest AND o.status = 'validated', false) AS kept, CASE WHEN o.digest = n.digest AND o.status = 'validated' THEN 'validated' ELSE 'pending' END AS status FROM n LEFT JOIN o USING (doc_id)")
def scope_checkpoints(spark, table):
    return V.checkpoints(*_versions(table), "doc_id", "digest")


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT doc_id, coalesce(n.digest, o.digest) AS digest FROM o FULL JOIN n USING (doc_id) WHERE n.doc_id IS NOT NULL")
def refreshed_rows(spark, table):
    from braidwork.operators import relational as R

    old, new = _versions(table)
    old = old.select("doc_id", "digest")
    return V.refreshed(old, new, R.inventory_diff(old, new, "doc_id", "digest"), "doc_id")


@query(
    """WITH m AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'in_flight' WHEN 'view' THEN 'cached' WHEN 'purchase' THEN 'validated' ELSE 'failed' END AS status FROM events),
            p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY event_id), 'pending') AS previous FROM m)
       SELECT event_id, status, previous, CASE previous WHEN 'pending' THEN status IN ('cached', 'in_flight', 'cancelled') WHEN 'cached' THEN status IN ('validated', 'fallback', 'failed')
         WHEN 'in_flight' THEN status IN ('validated', 'fallback', 'failed', 'cancelled') WHEN 'validated' THEN status = 'validated' ELSE status IN ('cached', 'in_flight', 'cancelled') END AS allowed FROM p"""
)
def status_transitions(spark, table):
    status = F.when(F.col("event_type") == "click", "in_flight").when(F.col("event_type") == "view", "cached").when(F.col("event_type") == "purchase", "validated").otherwise("failed")
    return V.transitions(table("events").select("user_id", "event_id", status.alias("status")), "user_id", "event_id", "status").select("event_id", "status", "previous", "allowed")


@query(
    """WITH e AS (SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 4 <> 0) AS seg FROM orders GROUP BY 1)
       SELECT c_custkey, c_name, coalesce(seg, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN e USING (c_custkey)"""
)
def overlaid_edits(spark, table):
    edits = table("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("c_mktsegment"))
    return V.overlaid(table("customer").select("c_custkey", "c_name", "c_mktsegment"), edits, "c_custkey", "o_orderkey", ["c_mktsegment"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 6 <> 0)")
def orphaned_edits(spark, table):
    return V.orphaned(table("customer").where("c_custkey % 6 <> 0").withColumnRenamed("c_custkey", "o_custkey"), table("orders"), "o_custkey").select("o_orderkey")


@query(
    """WITH c AS (SELECT o_custkey AS scope, o_orderkey AS id, o_orderkey % 4 = 0 AS pinned FROM orders), d AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0),
            b AS (SELECT scope, id, pinned FROM c WHERE pinned UNION ALL SELECT o_custkey, o_orderkey, false FROM d WHERE o_orderkey % 4 <> 0)
       SELECT scope, id, pinned, row_number() OVER (PARTITION BY scope ORDER BY id) - 1 AS position FROM b"""
)
def applied_draft(spark, table):
    rows = table("orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("id"))
    return V.applied_draft(rows.withColumn("pinned", F.col("id") % 4 == 0), rows.where("id % 3 <> 0").withColumn("pinned", F.lit(False)), "id", ["id"])


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) IN (SELECT o_custkey, max(o_orderkey) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)")
def published_versions(spark, table):
    rows = table("orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("complete"))
    return V.published(rows, "o_custkey", "o_orderkey").drop("complete")


@query(
    """WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'submitting' WHEN 1 THEN 'running' WHEN 2 THEN 'transmitting' ELSE 'reserved' END AS status, ts + INTERVAL 600 SECOND AS expires, event_id % 3 = 0 AS c FROM events)
       SELECT event_id, CASE WHEN status IN ('submitting', 'transmitting') THEN 'indeterminate' WHEN c THEN 'cancelled' ELSE 'pending' END AS outcome FROM j WHERE expires <= TIMESTAMP '2024-01-15 00:00:00'"""
)
def lease_outcomes(spark, table):
    status = F.element_at(F.array(*map(F.lit, ("submitting", "running", "transmitting", "reserved"))), (F.col("event_id") % 4 + 1).cast("int"))
    jobs = table("events").select("event_id", status.alias("status"), F.expr("ts + INTERVAL 600 SECOND").alias("expires"), (F.col("event_id") % 3 == 0).alias("cancel_requested"))
    return V.lease_outcomes(jobs, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("event_id", "outcome")


@query(
    """WITH j AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS status FROM orders), r AS (SELECT o_custkey, count(*) AS n FROM j WHERE status = 'running' GROUP BY 1),
            w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS claim FROM j WHERE status = 'pending')
       SELECT w.o_custkey, o_orderkey, CAST(claim AS INT) AS claim FROM w LEFT JOIN r USING (o_custkey) WHERE claim + coalesce(n, 0) <= 3"""
)
def claimable_jobs(spark, table):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    jobs = table("orders").select("o_custkey", "o_orderkey", "o_totalprice", status.alias("status"))
    return V.claimable(jobs, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "claim")


@query("SELECT l_suppkey, count(*) AS n_attempts, CAST(sum(l_partkey) AS BIGINT) AS tokens, CAST(greatest(0, 500000 - sum(l_partkey)) AS BIGINT) AS \"left\", sum(l_partkey) > 500000 AS over FROM lineitem GROUP BY l_suppkey")
def attempt_usage(spark, table):
    return V.usage(table("lineitem"), "l_suppkey", "l_partkey", 500_000)


@query("SELECT event_id, CAST(sum(event_id % 100) OVER w AS BIGINT) AS spent, sum(event_id % 100) OVER w <= 300 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def usage_ledger(spark, table):
    rows = table("events").select("user_id", "ts", "event_id", (F.col("event_id") % 100).alias("tokens"))
    return V.ledger(rows, "user_id", ["ts", "event_id"], "tokens", 300).select("event_id", "spent", "within")


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'failed' WHEN bool_or(o_orderstatus = 'O') THEN 'running' ELSE 'done' END AS run_status FROM orders GROUP BY 1")
def run_statuses(spark, table):
    status = F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    return V.run_status(table("orders").select("o_custkey", status.alias("status")), "o_custkey", "status")


# Graphs


_PLAIN = "SELECT DISTINCT src, dst FROM e"


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(a, b) AS (SELECT node, node FROM n UNION SELECT a, dst FROM r JOIN e ON src = b)
        SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a"""
)
def strong_components(spark, table):
    return graphs.strong_components(graph_edges(table))


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(a, b) AS (SELECT node, node FROM n UNION SELECT a, dst FROM r JOIN e ON src = b),
        p AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
        l AS (SELECT DISTINCT src, dst, s.component AS cs, d.component AS cd FROM e JOIN p s ON s.node = src JOIN p d ON d.node = dst)
        SELECT component, count(*) AS n_members, (SELECT count(DISTINCT dst) FROM l WHERE cd = component AND cs <> cd) AS n_entries, (SELECT count(DISTINCT src) FROM l WHERE cs = component AND cs <> cd) AS n_exits,
               (SELECT count(DISTINCT dst) FROM l WHERE cd = component AND cs <> cd) > 1 AS irreducible
        FROM p GROUP BY component HAVING count(*) > 1 OR (SELECT count(*) FROM l WHERE src = dst AND cs = component) > 0"""
)
def loop_summaries(spark, table):
    return graphs.loop_summary(graph_edges(table))


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), t AS (SELECT node FROM n WHERE node NOT IN (SELECT src FROM e)), u AS (SELECT node FROM n WHERE node % 50 = 7),
        r(a, b) AS (SELECT node, node FROM n UNION SELECT a, dst FROM r JOIN e ON src = b), k AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS i, count(*) OVER (PARTITION BY a) AS c FROM r WHERE b IN (SELECT node FROM t))
        SELECT node, coalesce(string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FILTER (i <= 2), '') AS samples, CASE WHEN max(c) IS NULL THEN 'none' WHEN max(c) = 1 THEN 'unique' ELSE 'multiple' END AS outcome,
               node IN (SELECT a FROM r WHERE b IN (SELECT node FROM u)) AS unresolved FROM n LEFT JOIN k ON a = node GROUP BY node"""
)
def terminal_summaries(spark, table):
    edges = written(graph_edges(table))
    nodes = edges.select("graph", F.col("src").alias("node")).union(edges.select("graph", "dst")).distinct()
    ends = nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    return graphs.terminal_summary(edges, ends, nodes.where("node % 50 = 7"))


@query(
    f"""WITH e AS ({_EDGES}), g AS (SELECT src, dst, id, CASE kind WHEN 'fallthrough' THEN 0 WHEN 'jump' THEN 4 ELSE 6 END AS rank FROM e)
        SELECT src // 100 AS src_group, dst // 100 AS dst_group, CASE max(rank) WHEN 0 THEN 'fallthrough' WHEN 4 THEN 'jump' ELSE 'choice' END AS kind, count(DISTINCT id) AS n FROM g WHERE src // 100 <> dst // 100 GROUP BY 1, 2"""
)
def group_edges(spark, table):
    edges = _edges(table)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graphs.group_edges(edges, nodes.select("node", F.expr("node div 100").alias("grp")))


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), k AS (SELECT DISTINCT src AS node FROM e WHERE src % 4 = 0 UNION SELECT dst FROM e WHERE dst % 4 = 0),
        g AS (SELECT src, dst, max(CASE kind WHEN 'fallthrough' THEN 0 WHEN 'jump' THEN 4 ELSE 6 END) AS rank FROM e GROUP BY src, dst),
        w(src, here, n, rank) AS (SELECT src, dst, 1, rank FROM g WHERE src IN (SELECT node FROM k) UNION SELECT w.src, g.dst, n + 1, greatest(w.rank, g.rank) FROM w JOIN g ON g.src = w.here WHERE w.here NOT IN (SELECT node FROM k) AND n < 40),
        least AS (SELECT *, min(n) OVER (PARTITION BY src, here) AS n_steps FROM w WHERE here IN (SELECT node FROM k))
        SELECT src, here AS dst, n_steps, CASE max(rank) WHEN 0 THEN 'fallthrough' WHEN 4 THEN 'jump' ELSE 'choice' END AS kind FROM least WHERE n = n_steps GROUP BY src, here, n_steps"""
)
def corridors(spark, table):
    """Kept nodes joined by walks over all others."""
    edges = _edges(table)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graphs.contracted(edges, nodes.where("node % 4 = 0")).select("src", "dst", "n_steps", "kind")


@query(
    """WITH p AS (SELECT DISTINCT p_partkey AS node, CASE WHEN p_partkey % 40 = 1 THEN -p_partkey WHEN p_partkey % 40 = 2 THEN p_partkey + 1 WHEN p_partkey % 40 = 3 THEN p_partkey - 1 WHEN p_partkey % 40 = 4 THEN NULL ELSE p_partkey - p_partkey % 40 + 4 END AS parent FROM part)
        SELECT node, 'unknown_parent' AS fault FROM p WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM p) UNION ALL SELECT p.node, 'cycle' FROM p JOIN p q ON q.node = p.parent AND q.parent = p.node"""
)
def hierarchy_faults(spark, table):
    k = F.col("p_partkey")
    parent = F.when(k % 40 == 1, -k).when(k % 40 == 2, k + 1).when(k % 40 == 3, k - 1).when(k % 40 != 4, k - k % 40 + 4)
    return graphs.hierarchy_faults(table("part").select(k.alias("node"), parent.alias("parent")))


@query(
    """WITH RECURSIVE c AS (SELECT DISTINCT p_partkey AS label, (p_partkey * 7 + 1) % (SELECT count(*) FROM part) AS callee FROM part WHERE p_size < 25), l AS (SELECT label FROM c UNION SELECT callee FROM c),
       b AS (SELECT label, (SELECT min(callee) FROM c WHERE c.label = l.label) AS callee FROM l), r(label) AS (SELECT label FROM b WHERE callee IS NULL UNION SELECT b.label FROM b JOIN r ON b.callee = r.label),
       t(a, x) AS (SELECT label, callee FROM b WHERE callee IS NOT NULL UNION SELECT a, callee FROM t JOIN b ON b.label = x WHERE callee IS NOT NULL)
       SELECT label, label IN (SELECT label FROM r) AS may_return, label IN (SELECT a FROM t WHERE a = x) AS recursive FROM l"""
)
def procedure_summaries(spark, table):
    """Labels that call one other before they return: which of them come back."""
    parts = table("part")
    calls = parts.where("p_size < 25").select(F.col("p_partkey").alias("label"), ((F.col("p_partkey") * 7 + 1) % parts.count()).alias("callee")).distinct()
    labels = calls.select("label").union(calls.select("callee")).distinct()
    body = labels.join(calls.groupBy("label").agg(F.min("callee").alias("callee")), "label", "left")
    at = lambda c: F.concat(F.lit(c), F.col("label").cast("string"))
    nodes = body.select(at("e").alias("node"), "label", F.lit("entry").alias("kind")).union(body.select(at("r"), "label", F.lit("return")))
    plain = body.where("callee IS NULL").select(at("e").alias("src"), at("r").alias("dst"))
    return graphs.procedure_summary(nodes, plain, body.where("callee IS NOT NULL").select(at("e").alias("src"), at("r").alias("dst"), "callee"))


# Functions


@query(
    """SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(p_type, '[._]+'), lambda w: w <> ''), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS display_name,
              CASE WHEN length(p_type) <= 10 THEN p_type ELSE rtrim(substr(p_type, 1, 9)) || '…' END AS short FROM part"""
)
def display_names(spark, table):
    return table("part").select("p_partkey", T.display_name(F.col("p_type")).alias("display_name"), T.cut(F.col("p_type"), 10).alias("short"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'relationship' WHEN event_id % 5 = 1 THEN 'resource' WHEN event_id % 5 = 2 THEN 'progression' WHEN event_id % 5 = 3 THEN 'flag' ELSE 'unknown' END AS category FROM events"""
)
def variable_categories(spark, table):
    names = F.array(*map(F.lit, ("Love_points", "GOLD", "day_no", "route_a", "xyz")))
    return table("events").select("event_id", T.category(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))).alias("category"))


@query("SELECT event_id, CAST(event_id % 90 AS INT) AS day, CAST(NULL AS INT) AS chapter, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS at FROM events")
def markers_and_instants(spark, table):
    title = F.concat(F.lit("The DAY "), (F.col("event_id") % 90).cast("string"), F.lit(" begins"))
    return table("events").select("event_id", T.story_marker(title, "day").alias("day"), T.story_marker(title, "chapter").alias("chapter"), T.instant(F.col("ts")).alias("at"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN '<10' WHEN p_size = 10 THEN '=10' WHEN p_size < 25 THEN '<25' WHEN p_size = 25 THEN '=25' ELSE '>25' END AS class FROM part")
def threshold_classes(spark, table):
    return table("part").select("p_partkey", T.threshold_class(F.col("p_size"), [25, 10]).alias("class"))


@query("SELECT event_id, '' AS secret_keys FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'Api-Key,user_token' FROM events WHERE event_id % 2 = 1")
def secret_keys(spark, table):
    extra = F.when(F.col("event_id") % 2 == 1, F.lit('{"a": {"user_token": 1, "Api-Key": "k"}, "other": "token"}')).otherwise(F.col("props"))
    return table("events").select("event_id", F.array_join(T.sensitive_keys(extra), ",").alias("secret_keys"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'bool' WHEN 2 THEN 'text' WHEN 3 THEN 'none' END AS kind, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'true' WHEN 2 THEN p_brand END AS value FROM part")
def literals(spark, table):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, "True").when(k == 2, F.concat(F.lit("'"), F.col("p_brand"), F.lit("'"))).when(k == 3, "None").otherwise("f(x)")
    return table("part").select("p_partkey", T.literal(text).alias("l")).select("p_partkey", "l.kind", "l.value")


@query("SELECT event_id, 'x_' || substr(sha256('[\"' || event_type || '\",' || user_id || ']'), 1, 20) AS id FROM events")
def list_ids(spark, table):
    """Ids over a canonical JSON list."""
    return table("events").select("event_id", keys.list_id("x", F.col("event_type"), F.col("user_id")).alias("id"))


@query("SELECT event_id, sha256('{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}') AS cache_key FROM events")
def cache_keys(spark, table):
    """Digests of canonical JSON: keys sorted, no blanks; routing ids left out."""
    return table("events").select("event_id", keys.canonical_digest({"user": F.col("user_id"), "kind": F.col("event_type")}).alias("cache_key"))


@query(
    """WITH t AS (SELECT l_suppkey AS scope, 'v' || l_linenumber % 3 AS variable, CASE l_orderkey % 4 WHEN 0 THEN '>=' WHEN 1 THEN '<' WHEN 2 THEN '!=' ELSE '>' END AS op, CAST(l_quantity AS DOUBLE) AS x FROM lineitem WHERE l_orderkey % 200 < 4),
            g AS (SELECT scope, variable, max(CASE WHEN op IN ('>', '>=') THEN x END) AS low, min(CASE WHEN op = '<' THEN x END) AS high, max(CASE WHEN op = '>' THEN x END) AS above, min(CASE WHEN op = '<' THEN x END) AS below, list(x) FILTER (op = '!=') AS but FROM t GROUP BY ALL)
       SELECT scope, variable, low, high, 0 AS n_equal, NOT coalesce(low > high OR (low = high AND (above = low OR below = low)), false) AS satisfiable FROM g"""
)
def constraint_intersections(spark, table):
    op = F.element_at(F.array(*map(F.lit, (">=", "<", "!=", ">"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    terms = table("lineitem").where("l_orderkey % 200 < 4").select(F.col("l_suppkey").alias("scope"), F.concat(F.lit("v"), (F.col("l_linenumber") % 3).cast("string")).alias("variable"), op.alias("op"), F.col("l_quantity").cast("double").alias("number"))
    return state.constraint_intersection(terms, "scope")


@query(
    """WITH w AS (SELECT user_id, event_id, event_type AS variable, event_id % 5 <> 0 AS proven FROM events WHERE event_id % 3 = 0), r AS (SELECT user_id, event_id, event_type AS variable FROM events WHERE event_id % 3 <> 0),
            m AS (SELECT r.user_id, r.event_id, r.variable, max(w.event_id) AS written_at FROM r LEFT JOIN w ON w.user_id = r.user_id AND w.variable = r.variable AND w.event_id < r.event_id GROUP BY ALL)
       SELECT user_id, event_id, variable, CASE WHEN written_at IS NULL THEN 'precondition' WHEN written_at % 5 <> 0 THEN 'effect' ELSE 'unknown' END AS source, written_at FROM m"""
)
def requirement_sources(spark, table):
    rows = table("events").select("user_id", "event_id", F.col("event_type").alias("variable"), F.when(F.col("event_id") % 5 != 0, "proven").otherwise("unresolved").alias("status"))
    return state.requirement_source(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), "user_id", "event_id")


@query(
    """WITH m AS (SELECT event_id, user_id, event_id % 7 = 0 AS a, event_id % 11 = 0 AS u, CASE WHEN event_id % 2 = 0 OR event_id % 7 = 0 THEN 1.0 ELSE -1.0 END * (event_id % 10) AS x, sum(CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
       SELECT event_id, CASE WHEN max(CASE WHEN u THEN 1 ELSE 0 END) OVER w = 0 THEN sum(x) OVER w END AS value_after FROM m WINDOW w AS (PARTITION BY user_id, run ORDER BY event_id)"""
)
def running_values(spark, table):
    k = F.col("event_id")
    op = F.when(k % 7 == 0, "assignment").when(k % 2 == 0, "increment").otherwise("decrement")
    rows = table("events").select("user_id", "event_id", F.lit("v").alias("variable"), op.alias("op"), (k % 10).cast("double").alias("number"), F.when(k % 11 == 0, "unresolved").otherwise("proven").alias("status"))
    return state.running_values(rows, "user_id", "event_id").select("event_id", "value_after")
