"""Calls and returns that belong together: what a call may come back from, one return site a call, and reach that never leaves a callee by another's call.

nodes(node, kind, label), edges(src, dst, kind) with text ids. Edges of kind ``call`` lead from
a call to its callee's first node, ``call_continuation`` to what follows the call,
``return`` from a return to what follows some call; calls that can't be resolved have an edge
of another kind that names them (dynamic_call, missing_call, call_out_of_scope).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.control_flow import base_role
from braidwork.operators.graphs import strong_components
from braidwork.operators.loops import chains, depths, reversed_edges, written

_CALLS = ("call", "call_continuation", "return")
_UNRESOLVED = ("dynamic_call", "missing_call", "call_out_of_scope")


def call_sites(edges: DataFrame) -> DataFrame:
    """(site, entry, continuation, lost): calls with what they enter and what follows them; entry is null where the callee is not known, ``lost`` what stands for it then."""
    first = lambda kinds, name: edges.where(F.col("kind").isin(*kinds)).groupBy(F.col("src").alias("site")).agg(F.min("dst").alias(name))
    return first(("call_continuation",), "continuation").join(first(("call",), "entry"), "site", "left").join(first(_UNRESOLVED, "lost"), "site", "left").select("site", "entry", "continuation", "lost")


def summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, may_return, may_terminate) of nodes from which control can come to a return of the same frame, or to the end of a file.

    Jumps into other labels go on in the frame; other edges count inside a label. A call is
    crossed once its callee's first node may return, so both are least fix-points: a round
    walks back from all ends at once, and rounds follow how deep calls are nested.
    """
    of = lambda a: nodes.select(F.col("node").alias(a), F.col("label").alias(f"{a}_label"), F.col("kind").alias(f"{a}_kind"))
    ends = F.col("dst_kind").isin("module_end", "unresolved", "scope_boundary")
    plain = edges.where(~F.col("kind").isin(*_CALLS)).join(of("src"), "src").join(of("dst"), "dst").where(F.col("src_label").eqNullSafe(F.col("dst_label")) | (F.col("kind") == "jump") | ends)
    plain = written(plain.select("src", "dst").distinct())
    sites = written(call_sites(edges).where("entry IS NOT NULL"))

    def walked(open_: DataFrame, goals: DataFrame) -> DataFrame:
        return written(depths(reversed_edges(open_), goals).select("node"))

    returns = nodes.where("kind = 'return'").select("node")
    known, crossed = walked(plain, returns), 0
    while True:
        open_ = sites.join(known.select(F.col("node").alias("entry")), "entry", "left_semi").select(F.col("site").alias("src"), F.col("continuation").alias("dst"))
        open_ = written(open_)
        n = open_.count()
        if n == crossed:
            break
        crossed, known = n, walked(plain.unionByName(open_), returns)
    steps = written(plain.unionByName(open_))
    ended, entered = walked(steps, nodes.where("kind = 'module_end'").select("node")), -1
    while True:  # a call into what may end the file ends it, whatever follows
        calling = written(sites.join(ended.select(F.col("node").alias("entry")), "entry", "left_semi").select(F.col("site").alias("node")))
        n = calling.count()
        if n == entered:
            break
        entered, ended = n, walked(steps, nodes.where("kind = 'module_end'").select("node").unionByName(calling))
    back, last = known.withColumn("r", F.lit(True)), ended.withColumn("t", F.lit(True))
    return back.join(last, "node", "full").select("node", F.coalesce("r", F.lit(False)).alias("may_return"), F.coalesce("t", F.lit(False)).alias("may_terminate"))


def normalized(nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes(node, kind, label) and edges(src, dst, role, kind, site) in which every call has a return site and every called label that returns an exit.

    A call enters its callee (call_enter). Where the callee may return, or is not known, a
    call_summary leads to the call's own ``return:`` site and a call_return from there to
    what follows; a label's returns lead to its ``exit:``, which leads nowhere. Other edges keep their
    kind and get the role of ``base_role``. ``known`` is what ``summaries`` found.
    """
    found = summaries(nodes, edges) if known is None else known
    labels = nodes.select("node", "label")
    sites = written(call_sites(edges).join(labels.select(F.col("node").alias("entry"), F.col("label").alias("callee")), "entry", "left"))
    returns = nodes.where("kind = 'return'").select("node", "label").join(sites.select(F.col("callee").alias("label")).distinct(), "label", "left_semi")
    exits = returns.select(F.concat(F.lit("exit:"), "label").alias("node"), F.lit("procedure_return_boundary").alias("kind"), "label").distinct()
    back = found.where("may_return").select(F.col("node").alias("entry"), F.lit(True).alias("back"))
    coming = written(sites.join(back, "entry", "left").where("back OR entry IS NULL"))
    own = F.concat(F.lit("return:"), "site")
    landings = coming.join(labels.select(F.col("node").alias("site"), "label"), "site", "left").select(own.alias("node"), F.lit("call_return_site").alias("kind"), "label")
    none = F.lit(None).cast("string")
    edge = lambda df, src, dst, role, kind, site: df.select(src.alias("src"), dst.alias("dst"), F.lit(role).alias("role"), F.lit(kind).alias("kind"), site.alias("site"))
    c = F.col
    rest = edges.where(~c("kind").isin(*_CALLS)).select("src", "dst", base_role(c("kind")).alias("role"), "kind", none.alias("site"))
    entered = sites.withColumn("to", F.coalesce("entry", "lost")).where("to IS NOT NULL")
    made = (
        rest.unionByName(edge(returns, c("node"), F.concat(F.lit("exit:"), "label"), "call_return", "procedure_return", none))
        .unionByName(edge(entered, c("site"), c("to"), "call_enter", "call_enter", c("site")))
        .unionByName(edge(coming, c("site"), own, "call_summary", "call_summary", c("site")))
        .unionByName(edge(coming, own, c("continuation"), "call_return", "call_return", c("site")))
    )
    return written(nodes.select("node", "kind", "label").unionByName(exits).unionByName(landings)), written(made)


def matched_reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) of normalized edges(src, dst, ..): what is reached from a root when every return goes to its own call."""
    return depths(edges, roots)


def reached_from(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node): what each of starts(start) reaches, itself included; linear stretches are crossed in one round."""
    firsts = starts.select(F.col("start").alias("node")).distinct()
    places = chains(edges.select("src", "dst"), firsts)
    places = written(places.select("node", F.when(F.col("cyclic"), F.col("node")).otherwise(F.col("head")).alias("head")))  # a ring is walked node by node
    places = written(places.unionByName(firsts.join(places.select("node"), "node", "left_anti").select("node", F.col("node").alias("head"))))
    of = lambda a, name: places.select(F.col("node").alias(a), F.col("head").alias(name))
    lifted = written(edges.select("src", "dst").join(of("src", "from"), "src").join(of("dst", "to"), "dst").where("from <> to").select("from", "to").distinct())
    seen = written(firsts.select(F.col("node").alias("start"), F.col("node").alias("head")))
    frontier = seen
    while not frontier.isEmpty():
        following = frontier.withColumnRenamed("head", "from").join(lifted, "from").select("start", F.col("to").alias("head")).distinct()
        frontier = written(following.join(seen, ["start", "head"], "left_anti"))
        seen = written(seen.unionByName(frontier))
    return seen.join(places, "head").select("start", "node")


def resumes(edges: DataFrame) -> DataFrame:
    """(landing, exit) of normalized edges: the exits that a call's callee reaches in its own frame, by the return site of the call.

    Nested calls are crossed by their summaries; an exit of a nested callee is none of the caller's.
    """
    sites = edges.where("role = 'call_enter'").select("site", F.col("dst").alias("start")).join(edges.where("role = 'call_summary'").select("site", F.col("dst").alias("landing")), "site")
    inside = edges.where("role <> 'call_enter'")
    exits = inside.where("kind = 'procedure_return'").select(F.col("dst").alias("node")).distinct()
    frames = written(reached_from(sites, inside).join(exits, "node", "left_semi"))
    return sites.join(frames, "start").select("landing", F.col("node").alias("exit")).distinct()


def recursive_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label): labels whose calls lead back to them."""
    labels = nodes.select("node", "label")
    called = call_sites(edges).where("entry IS NOT NULL").join(labels.select(F.col("node").alias("site"), F.col("label").alias("src")), "site").join(labels.select(F.col("node").alias("entry"), F.col("label").alias("dst")), "entry").select("src", "dst").distinct()
    called = written(called)
    parts = written(strong_components(called))
    several = parts.join(parts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component", "left_semi").select(F.col("node").alias("label"))
    return several.unionByName(called.where("src = dst").select(F.col("src").alias("label"))).distinct()
