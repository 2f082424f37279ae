"""Typed control flow over statement rows: nodes, edges, transfers, returns and what depends on what.

A node is named by its line and role: ``line``, ``line:merge`` for where the arms
of a menu or an ``if`` meet, ``line:if`` for the test before its branches,
``line:unresolved`` for what can't be known, ``end`` for the end of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators import loops, parts
from braidwork.operators.loops import written

#: Statements that are no node of their own. Fixed values.
NO_NODE = ("caption", "set")

#: Reasons for which a statement may do more than go on. Fixed values.
OPEN_REASONS = ("unsupported_control_flow", "creator_or_unsupported_block", "interactive_screen_call")


def _at(column, role: str):
    """The node of a line's role."""
    return F.concat(F.col(column).cast("string"), F.lit(f":{role}"))


def laid(statements: DataFrame) -> DataFrame:
    """Nodes in their blocks: (path, at, place, node, kind, meet, open, target, next).

    A row with a ``place`` is a node that control may enter, one a statement and one
    an ``if``, that stands there in the block of line ``at``; ``next`` follows it. One
    without heads the block of ``at``, a label, choice or branch; ``next`` is the
    block's first node, ``meet`` the line whose arms meet where the block ends.
    Both lie side by side, so one sort of slim rows tells all of it. The last node of a
    label's block goes on where the label does, see ``settled``.
    """
    rows = statements.where(~F.col("kind").isin(*NO_NODE))
    kind, none = F.col("kind"), F.lit(None)
    is_if = F.coalesce((kind == "branch") & (F.col("chain") == F.col("stmt")), F.lit(False))
    open_ = F.coalesce(F.col("reason").isin(*OPEN_REASONS), F.lit(False)).alias("open")
    target = F.when(kind == "call", F.col("target")).alias("target")
    node = F.when(is_if, _at("stmt", "if")).otherwise(F.col("stmt").cast("string"))
    inside = F.struct(F.col("parent").alias("at"), F.col("stmt").alias("place"), node.alias("node"), F.when(is_if, "if").otherwise(kind).alias("kind"), none.cast("long").alias("meet"), open_, target)
    meet = F.when(kind == "choice", F.col("parent")).when(kind == "branch", F.col("chain"))
    heads = F.struct(F.col("stmt").alias("at"), none.cast("long").alias("place"), none.cast("string").alias("node"), kind.alias("kind"), meet.alias("meet"), open_, none.cast("string").alias("target"))
    both = F.when((kind == "label") | is_if, F.array(heads, inside)).when(kind.isin("choice", "branch"), F.array(heads)).otherwise(F.array(inside))
    block = W.partitionBy("path", "at").orderBy("place")  # the head first
    shown = rows.select("path", F.explode(both).alias("e")).select("path", "e.*").withColumn("next", F.lead("node").over(block)).withColumn("over", F.first("meet").over(block.rowsBetween(W.unboundedPreceding, 0)))
    following = F.when(F.col("place").isNull(), F.col("next")).otherwise(F.coalesce("next", _at("over", "merge"), F.when(F.col("at").isNull(), "end")))
    return shown.withColumn("next", following).drop("over")


def settled(nodes: DataFrame) -> DataFrame:
    """``laid`` rows whose ends of labels' blocks, and labels without a block, go where the label goes on; labels in labels are followed up by doubling."""
    labels = nodes.where("place IS NOT NULL AND kind = 'label'").select("path", F.col("place").alias("at"), F.col("next").alias("then"), F.when(F.col("next").isNull(), F.col("at")).alias("up"))
    for _ in range(64):
        if labels.where("up IS NOT NULL").isEmpty():
            break
        ahead = labels.select("path", F.col("at").alias("up"), F.col("then").alias("t"), F.col("up").alias("u"))
        labels = written(labels.join(ahead.hint("merge"), ["path", "up"], "left").select("path", "at", F.coalesce("then", "t").alias("then"), F.when(F.col("then").isNull(), F.col("u")).alias("up")))
    ends = F.col("next").isNull() & (F.col("place").isNotNull() | (F.col("kind") == "label"))
    led = nodes.where(ends).join(labels.drop("up").hint("merge"), ["path", "at"], "left").withColumn("next", F.col("then")).drop("then")
    return nodes.where(~ends).unionByName(led)


def edges(statements: DataFrame) -> DataFrame:
    """(path, src, dst_path, dst, kind) of one script's or many scripts' statements, labels being known across files."""
    nodes = settled(written(laid(statements)))
    step = lambda src, dst, kind: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    kind, node, following, line = F.col("kind"), F.col("node"), F.col("next"), F.col("at").cast("string")
    owner = F.concat(F.coalesce("meet", "at").cast("string"), F.lit(":merge"))
    heads = (
        F.when(kind == "label", F.array(step(line, following, "label_entry")))
        .when(kind == "choice", F.array(step(F.col("meet").cast("string"), line, "menu_choice"), step(line, F.coalesce(following, _at("meet", "merge")), "choice_body")))
        .otherwise(F.array(step(_at("meet", "if"), line, "condition"), step(line, F.coalesce(following, owner), "branch_body")))
    )
    after = step(_at("place", "merge"), following, "fallthrough")
    inside = (
        F.when(kind == "call", F.array(step(node, following, "call_continuation")))
        .when(kind == "menu", F.array(after, step(node, _at("place", "merge"), "menu_no_choice")))
        .when(kind == "if", F.array(after))
        .when(~kind.isin("label", "jump", "return"), F.array(step(node, following, "fallthrough")))
    )
    found = F.when(F.col("place").isNull(), heads).otherwise(inside)
    named = F.coalesce(node, line)
    lost = F.when(F.col("open") & (F.col("place").isNotNull() | (kind != "label")), F.array(step(named, F.concat(named, F.lit(":unresolved")), "unresolved_behavior")))
    found = F.when(lost.isNull(), found).when(found.isNull(), lost).otherwise(F.concat(found, lost))
    local = nodes.select("path", F.explode(found).alias("e")).select("path", "e.src", F.col("path").alias("dst_path"), "e.dst", "e.kind")
    chains = statements.where("kind = 'branch'").groupBy("path", "chain").agg(F.bool_and(F.col("condition").isNotNull()).alias("tested"), F.bool_or(F.col("chain") == F.col("stmt")).alias("begun"))
    skipped = chains.where("tested AND begun").select("path", _at("chain", "if").alias("src"), F.col("path").alias("dst_path"), _at("chain", "merge").alias("dst"), F.lit("condition_false").alias("kind"))
    return local.unionByName(skipped).unionByName(transfers(statements)).unionByName(returns(statements, nodes))


def _first_labels(statements: DataFrame) -> DataFrame:
    """(digest, target, label_path, label_line): the first label of each name. Names often begin alike, so rows are dealt and sorted by digest first."""
    rows = statements.where("kind = 'label'").select(F.xxhash64("name").alias("digest"), F.col("name").alias("target"), F.struct("path", "stmt").alias("place"))
    return rows.groupBy("digest", "target").agg(F.min("place").alias("first")).select("digest", "target", F.col("first.path").alias("label_path"), F.col("first.stmt").alias("label_line"))


def labels(statements: DataFrame) -> DataFrame:
    """(name, path, node) of each label; of labels with one name, the first by path and line."""
    return _first_labels(statements).select(F.col("target").alias("name"), F.col("label_path").alias("path"), F.col("label_line").cast("string").alias("node"))


def duplicate_labels(statements: DataFrame) -> DataFrame:
    """(name, n) of labels that stand more than once."""
    return statements.where("kind = 'label'").groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def transfers(statements: DataFrame) -> DataFrame:
    """Edges of jumps and calls: to their label; ``dynamic_*`` where the target is an expression, ``missing_*`` where no label has the name."""
    src = F.col("stmt").cast("string")
    digest = F.when(F.col("target").isNotNull(), F.xxhash64("target")).otherwise(F.xxhash64("path", "stmt"))  # those without a target are spread
    moves = statements.where("kind IN ('jump', 'call')").select(digest.alias("digest"), "target", "path", src.alias("src"), "kind", F.col("expression").isNotNull().alias("dynamic"))
    joined = moves.join(_first_labels(statements).hint("merge"), ["digest", "target"], "left").withColumn("label_node", F.col("label_line").cast("string"))
    kind = F.when(F.col("dynamic"), F.concat(F.lit("dynamic_"), F.col("kind"))).when(F.col("label_node").isNull(), F.concat(F.lit("missing_"), F.col("kind"))).otherwise(F.col("kind"))
    lost = F.concat("src", F.lit(":unresolved"))
    return joined.select("path", "src", F.coalesce("label_path", "path").alias("dst_path"), F.coalesce("label_node", lost).alias("dst"), kind.alias("kind"))


def returns(statements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from each return under a called label to what follows each of its calls."""
    digest = lambda name: F.xxhash64(name).alias("digest")
    sites = nodes.where("target IS NOT NULL").select(digest("target"), F.col("target").alias("label"), F.col("path").alias("dst_path"), F.col("next").alias("dst")).distinct()
    rows = statements.where("kind = 'return'").select(digest("label"), "label", "path", F.col("stmt").cast("string").alias("src"))
    return rows.join(sites.hint("merge"), ["digest", "label"]).select("path", "src", "dst_path", "dst", F.lit("return").alias("kind")).distinct()


def reached(flow: DataFrame, roots: DataFrame) -> DataFrame:
    """flow(path, src, dst_path, dst), roots(path, node) -> (node): what a root leads to, roots included, by names ``path/node``.

    A file whose edges stay in it is worked out by itself, if it has no more than
    ``parts.MOST_ROWS`` of them; files that edges lead out of or into, and larger ones, in rounds.
    """
    name = lambda path, node: F.concat_ws("/", path, node)
    file = lambda path: F.coalesce(path, F.lit(""))
    steps = flow.where("src IS NOT NULL AND dst IS NOT NULL").select(file("path").alias("graph"), file("dst_path").alias("other"), name("path", "src").alias("src"), name("dst_path", "dst").alias("dst"))
    starts = roots.where("node IS NOT NULL").select(file("path").alias("graph"), name("path", "node").alias("src"))
    rows = written(parts.tagged(steps, starts))
    joined = rows.where("graph <> other").select(F.explode(F.array("graph", "other")).alias("graph"))
    large = rows.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > parts.MOST_ROWS).select("graph")
    far = written(joined.unionByName(large).distinct())
    alone = far.isEmpty()
    near = rows if alone else rows.join(far.hint("merge"), "graph", "left_anti")
    found = parts.each(near.drop("other"), parts.led_to, {"node": "node"})
    if alone:
        return found
    rest = written(rows.join(far.hint("merge"), "graph", "left_semi"))
    return found.unionByName(loops.reached(rest.where("tag = 0"), rest.where("tag = 1").select(F.col("src").alias("node"))))


def dependencies(statements: DataFrame) -> DataFrame:
    """(path, needs): files that jump or call into other files."""
    return transfers(statements).where("path <> dst_path AND kind IN ('jump', 'call')").select("path", F.col("dst_path").alias("needs")).distinct()


def base_role(kind):
    """What an edge is to a reader: entry, choice, condition, jump, unresolved or flow."""
    return (
        F.when(kind == "label_entry", "entry")
        .when(kind.rlike("unresolved|dynamic|missing|out_of_scope"), "unresolved")
        .when(kind.rlike("menu|choice"), "choice")
        .when(kind.rlike("condition|branch"), "condition")
        .when(kind == "jump", "jump")
        .otherwise("flow")
    )


def transition_kind(kind):
    """The kind of a transition between beats for the kind of an edge; null where an edge makes none."""
    return (
        F.when(kind == "call_continuation", kind)
        .when(kind.contains("unresolved") | kind.startswith("dynamic_") | kind.startswith("missing_"), "unresolved")
        .when(kind == "menu_choice", "choice")
        .when(kind.isin("condition", "condition_false"), "condition")
        .when(kind == "menu_no_choice", "fallthrough")
        .when(kind.contains("jump"), "jump")
        .when(kind.isin("call", "call_out_of_scope"), "call")
        .when(kind.isin("fallthrough", "return"), kind)
    )
