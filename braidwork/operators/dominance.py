"""Dominators by joins: a tree whose nodes move up to the nearest common ancestor of their predecessors, until none moves.

The tree starts as breadth-first predecessors. Ancestors are looked up in a table of
jumps of 1, 2, 4, .. steps, so a look-up takes joins with the logarithm of the
depth. A node only moves to one of its ancestors, and true dominators stay
ancestors; where every predecessor of a node lies under its parent, the parent is
its immediate dominator. All graphs of a table are worked on at once: an unseen
root, null in the results, stands over all roots. A round of moves looks at all
edges into nodes with several predecessors; rounds follow how often paths from
the roots cross before they meet, not their length. Where all tables have
``graph``, small parts are worked out each by itself instead (see ``parts``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators import parts
from braidwork.operators.graphs import strong_components
from braidwork.operators.loops import breadth_first, reversed_edges, written


def jumps(parents: DataFrame) -> DataFrame:
    """parents(node, parent) of a forest -> (node, level, ups): roots, whose parent is null, have level 1; ups[j] is the ancestor 2^j levels up.

    Null ancestors are left out: ups has as many entries as the level has jumps below it. Written.
    """
    known = written(parents.select("node", F.when(F.col("parent").isNull(), F.array().cast(f"array<{parents.schema['parent'].dataType.simpleString()}>")).otherwise(F.array("parent")).alias("ups"), F.when(F.col("parent").isNull(), 1).otherwise(2).cast("long").alias("level")))
    step = 0
    while True:
        # level is exact where the jumps made so far have reached a root, else it counts the steps below the last ancestor
        last = F.get("ups", F.lit(step))
        open_ = known.where(F.size("ups") == step + 1)
        if open_.isEmpty():
            return known.select("node", "level", "ups")
        above = known.select(F.col("node").alias("up"), F.col("ups").alias("more"), F.col("level").alias("up_level"))
        joined = known.withColumn("up", last).join(above, "up", "left")
        ups = F.when(F.size("more") == step + 1, F.concat("ups", F.array(F.get("more", F.lit(step))))).otherwise(F.col("ups"))
        known = written(joined.select("node", ups.alias("ups"), F.when(F.col("up").isNotNull(), F.col("level") - 1 + F.col("up_level")).otherwise(F.col("level")).alias("level")))
        step += 1


def nearest_common(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs(.., x, y) with the table of ``jumps`` -> pairs with ``common``, their nearest common ancestor (itself included), and its ``common_level``.

    Null where there is none; then, and for nodes the table lacks, the level is 0. The
    deeper node climbs first, by the largest jump that does not go too high; then both by
    the largest that does not meet. Only pairs that have not met go on.
    """
    columns = [c for c in pairs.columns if c not in ("x", "y")]
    kind = table.schema["node"].dataType.simpleString()
    side = lambda s: table.select(F.col("node").alias(s), F.col("level").alias(f"{s}_level"), F.col("ups").alias(f"{s}_ups"))
    going, met = pairs, None
    while True:
        rows = going.join(side("x"), "x", "left").join(side("y"), "y", "left")
        lost = F.col("x_level").isNull() | F.col("y_level").isNull()
        gap = F.col("x_level") - F.col("y_level")
        jump = lambda a, n: F.get(f"{a}_ups", F.length(F.bin(n)) - 1)
        sizes = F.least(F.size("x_ups"), F.size("y_ups"))
        differ = F.when(sizes > 0, F.array_max(F.filter(F.sequence(F.lit(0), sizes - 1), lambda j: ~F.get("x_ups", j).eqNullSafe(F.get("y_ups", j)))))
        same = F.col("x") == F.col("y")
        x = F.when(lost | same, F.col("x")).when(gap > 0, jump("x", gap)).when(gap < 0, F.col("x")).when(differ.isNull(), F.get("x_ups", F.lit(0))).otherwise(F.get("x_ups", differ))
        y = F.when(lost | same, F.col("y")).when(gap < 0, jump("y", -gap)).when(gap > 0, F.col("y")).when(differ.isNull(), F.get("y_ups", F.lit(0))).otherwise(F.get("y_ups", differ))
        at_root = ~lost & ~same & (gap == 0) & (F.size("x_ups") == 0)  # two roots
        moved = written(rows.select(*columns, x.alias("nx"), y.alias("ny"), (lost | at_root).alias("apart"), (~lost & same).alias("same"), F.col("x_level").alias("level")))
        done = moved.where("apart OR same").select(*columns, F.when(F.col("same"), F.col("nx")).cast(kind).alias("common"), F.when(F.col("same"), F.col("level")).otherwise(0).cast("long").alias("common_level"))
        met = done if met is None else met.unionByName(done)
        going = moved.where("NOT apart AND NOT same").select(*columns, F.col("nx").alias("x"), F.col("ny").alias("y"))
        if going.isEmpty():
            return met


def _alone(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(graph, node) as rows beside those of ``edges``, each once."""
    return nodes.select("graph", F.col("node").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst")).where("src IS NOT NULL").distinct()


def dominators(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges(src, dst), roots(node) -> (node, idom) of every node that a root reaches; idom is null where only the node itself is on all its paths."""
    if "graph" in edges.columns:
        near, far = parts.split(parts.tagged(edges.select("graph", "src", "dst").where("src <> dst").distinct(), _alone(roots, edges)))
        found = parts.each(near, parts.dominator_tree, {"node": "node", "idom": "node"})
        return found if far is None else found.unionByName(dominators(far.where("tag = 0").select("src", "dst"), far.where("tag = 1").select(F.col("src").alias("node"))))
    edges = written(edges.select("src", "dst").where("src <> dst").distinct())
    roots = roots.select("node").where("node IS NOT NULL").distinct()
    tree = written(breadth_first(edges, roots).select("node", F.col("pred").alias("parent")))
    inner = edges.join(tree.select(F.col("node").alias("src")), "src", "left_semi").join(roots.select(F.col("node").alias("dst")), "dst", "left_anti")
    several = inner.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    inner = written(inner.join(several, "dst", "left_semi"))
    while True:
        table = jumps(tree)
        pairs = inner.join(tree.select(F.col("node").alias("dst"), F.col("parent").alias("x")), "dst").where("x IS NOT NULL AND x <> src").select(F.col("dst").alias("node"), "x", F.col("src").alias("y"))
        found = nearest_common(pairs, table)
        highest = found.groupBy("node").agg(F.min_by("common", "common_level").alias("up"), F.min("common_level").alias("up_level"))
        levels = table.select("node", "level")
        moves = written(highest.join(levels, "node").where("up_level < level - 1").select("node", "up"))
        if moves.isEmpty():
            return tree.select("node", F.col("parent").alias("idom"))
        tree = written(tree.join(moves.withColumn("moves", F.lit(True)), "node", "left").select("node", F.when(F.col("moves"), F.col("up")).otherwise(F.col("parent")).alias("parent")))


def post_dominators(edges: DataFrame, nodes: DataFrame, terminals: DataFrame) -> DataFrame:
    """(node, ipdom, terminates) of every node of nodes(node): what all its ways to an end pass next; null where that is the unseen exit alone.

    terminals(node) lead to the exit, and so do nodes that reach none of them: these don't terminate.
    """
    if "graph" in edges.columns:
        back = edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst").distinct()
        near, far = parts.split(parts.tagged(back, _alone(terminals, edges), _alone(nodes, edges)))
        found = parts.each(near, parts.past, {"node": "node", "ipdom": "node", "terminates": "boolean"})
        of = lambda tag: far.where(F.col("tag") == tag).select(F.col("src").alias("node"))
        return found if far is None else found.unionByName(post_dominators(far.where("tag = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")), of(2), of(1)))
    ends = terminals.select("node").where("node IS NOT NULL").distinct()
    back = written(reversed_edges(edges.select("src", "dst").where("src <> dst").distinct()))
    reach = written(breadth_first(back, ends).select("node"))
    endless = written(nodes.select("node").distinct().join(reach, "node", "left_anti"))
    found = dominators(back, ends.unionByName(endless))
    return found.join(endless.withColumn("terminates", F.lit(False)), "node", "left").select("node", F.col("idom").alias("ipdom"), F.coalesce("terminates", F.lit(True)).alias("terminates")).join(nodes.select("node").distinct(), "node", "left_semi")


def dominates(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """pairs(.., above, below) with ``holds``: whether ``above`` is ``below`` or an ancestor of it in tree(node, idom)."""
    if "graph" in pairs.columns:
        near, far = parts.split(parts.tagged(tree.select("graph", F.col("node").alias("src"), F.col("idom").alias("dst")), pairs.select("graph", F.col("above").alias("src"), F.col("below").alias("dst")).distinct()))
        found = parts.each(near, parts.above, {"above": "node", "below": "node", "holds": "boolean"})
        if far is not None:
            asked = far.where("tag = 1").select(F.col("src").alias("above"), F.col("dst").alias("below"))
            found = found.unionByName(dominates(asked, far.where("tag = 0").select(F.col("src").alias("node"), F.col("dst").alias("idom"))))
        return pairs.join(found, ["above", "below"]) if set(pairs.columns) > {"graph", "above", "below"} else found
    table = jumps(tree.select("node", F.col("idom").alias("parent")))
    found = nearest_common(pairs.withColumn("x", F.col("above")).withColumn("y", F.col("below")), table)
    return found.withColumn("holds", F.coalesce(F.col("common") == F.col("above"), F.lit(False))).drop("common", "common_level")


def common_of_groups(groups: DataFrame, tree: DataFrame) -> DataFrame:
    """groups(grp, node), tree(node, idom) -> (grp, common): the nearest ancestor that all nodes of a group share, itself included; null where there is none."""
    if "graph" in groups.columns:  # then groups are named by ids of nodes
        near, far = parts.split(parts.tagged(tree.select("graph", F.col("node").alias("src"), F.col("idom").alias("dst")), groups.select("graph", F.col("grp").alias("src"), F.col("node").alias("dst"))))
        found = parts.each(near, parts.meeting, {"grp": "node", "common": "node"})
        if far is None:
            return found
        return found.unionByName(common_of_groups(far.where("tag = 1").select(F.col("src").alias("grp"), F.col("dst").alias("node")), far.where("tag = 0").select(F.col("src").alias("node"), F.col("dst").alias("idom"))))
    table = jumps(tree.select("node", F.col("idom").alias("parent")))
    first = groups.groupBy("grp").agg(F.min("node").alias("x"))
    found = nearest_common(groups.join(first, "grp").select("grp", "x", F.col("node").alias("y")), table)
    return found.groupBy("grp").agg(F.min_by("common", "common_level").alias("common"))


def loop_roles(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> (src, dst, component, role) of edges that touch a loop, a strong component of several nodes or with an edge to itself.

    role: ``loop_back`` where the loop is entered at one node and, from there, the target
    dominates the source inside it; ``loop_body`` for its other inner edges; ``loop_exit``
    for edges out of it, also those that lead into another loop. A loop entered at several
    nodes or at none has no edge that is proven to lead back.
    """
    named = ["graph"] if "graph" in edges.columns else []
    edges = written(edges.select(*named, "src", "dst").distinct())
    placed = written(strong_components(edges))
    of = lambda a, name: placed.select(F.col("node").alias(a), F.col("component").alias(name))
    lifted = written(edges.join(of("src", "cs"), "src").join(of("dst", "cd"), "dst"))
    inner = written(lifted.where("cs = cd").select("src", "dst", F.col("cs").alias("component"), F.col("cs").alias("graph")))  # a component is a part by itself
    loops = written(inner.select("component").distinct())
    entries = lifted.where("cs <> cd").groupBy(F.col("cd").alias("component")).agg(F.min("dst").alias("node"), F.count_distinct("dst").alias("n")).where("n = 1")
    entries = written(entries.join(loops, "component", "left_semi").withColumn("graph", F.col("component")))
    entered = written(inner.join(entries.select("component"), "component", "left_semi"))
    tree = written(dominators(entered, entries))
    tree = tree.join(placed.select("node", F.col("component").alias("graph")), "node")
    back = dominates(entered.select("graph", F.col("dst").alias("above"), F.col("src").alias("below")), tree).where("holds").select(F.col("below").alias("src"), F.col("above").alias("dst"), F.lit(True).alias("back"))
    inside = inner.join(back, ["src", "dst"], "left").select("src", "dst", "component", F.when(F.col("back"), "loop_back").otherwise("loop_body").alias("role"))
    out = lifted.where("cs <> cd").select("src", "dst", F.col("cs").alias("component")).join(loops, "component", "left_semi").select("src", "dst", "component", F.lit("loop_exit").alias("role"))
    return inside.unionByName(out)
