"""Graph analysis by fix-point loops over edge tables: chains, strong components, loops, summaries, contraction.

Edges are (src, dst, ..) with ids of any one type. Rounds follow the depth of
the graph with its linear chains put together, not its length: a chain of any
length takes a number of rounds that grows with the logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators import parts
from braidwork.operators.loops import chains, depths, led, reversed_edges, written

#: Which edge kind stands for a merged edge: the later one. Fixed values.
KIND_RANK = {"fallthrough": 0, "call_continuation": 1, "return": 2, "call": 3, "jump": 4, "condition": 5, "choice": 6, "ending": 7}


def strong_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> (node, component): the smallest node of each strongly connected component.

    Nodes without a way in or out are trimmed; then each node takes the largest
    node that reaches it as its colour, and what reaches that node within the
    colour is its component. Rounds repeat on what is left. Edges with ``graph``
    are worked out by small parts (see ``parts``).
    """
    if "graph" in edges.columns:
        near, far = parts.split(parts.tagged(edges.select("graph", "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()))
        found = parts.each(near, parts.strong, {"node": "node", "component": "node"})
        return found if far is None else found.unionByName(strong_components(far.select("src", "dst")))
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    places = written(chains(edges))
    rings = places.where("cyclic").select("node", F.col("head").alias("component"))
    names = places.where("NOT cyclic").select("node", "head")
    lifted = edges.join(names.select(F.col("node").alias("src"), F.col("head").alias("s")), "src").join(names.select(F.col("node").alias("dst"), F.col("head").alias("d")), "dst")
    inner = lifted.where("src = dst OR s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    tails = places.where("NOT cyclic").groupBy("head").agg(F.max_by("node", "at").alias("src")).select("src")
    back = lifted.where("s = d AND src <> dst").join(places.where("at = 0").select(F.col("node").alias("dst")), "dst", "left_semi").join(tails, "src", "left_semi")
    closed = written(back.select(F.col("s").alias("head")).distinct())  # chains whose end leads to their own head
    left, found = written(inner.where("src <> dst")), None
    while not left.isEmpty():
        while True:
            ends = left.select(F.col("src").alias("n")).intersect(left.select(F.col("dst").alias("n")))
            trimmed = written(left.join(ends.withColumnRenamed("n", "src"), "src", "left_semi").join(ends.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst"))
            shrunk, left = trimmed.count() < left.count(), trimmed
            if not shrunk:
                break
        if left.isEmpty():
            break
        colour = written(left.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("colour")))
        changed = colour
        while not changed.isEmpty():
            pushed = left.join(changed.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
            changed = written(colour.join(pushed, "node").where("new > colour").select("node", F.col("new").alias("colour")))
            colour = written(colour.join(changed.select("node"), "node", "left_anti").unionByName(changed))
        coloured = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
        same = written(coloured.where("cs = cd").select("src", "dst"))
        members = written(colour.where("node = colour"))
        frontier = members
        while not frontier.isEmpty():
            back = same.join(frontier.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = written(back.join(members.select("node"), "node", "left_anti"))
            members = written(members.unionByName(frontier))
        found = members if found is None else found.unionByName(members)
        left = written(left.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti"))
    labels = names.withColumnRenamed("head", "h")
    if found is not None:
        several = found.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")  # a chain that no other is strongly connected to is no component by itself
        labels = labels.join(found.join(several, "colour", "left_semi").select(F.col("node").alias("h"), "colour"), "h", "left").withColumn("key", F.coalesce("colour", F.when(F.col("h").isNull(), F.col("h"))))
    else:
        labels = labels.withColumn("key", F.lit(None).cast(names.schema["head"].dataType))
    labels = labels.join(closed.select(F.col("head").alias("h"), F.lit(True).alias("closed")), "h", "left")
    group = F.when(F.col("key").isNotNull(), F.col("key")).when(F.col("closed"), F.col("h"))
    labels = labels.withColumn("group", group)
    least = labels.where("group IS NOT NULL").groupBy("group").agg(F.min("node").alias("component"))
    return labels.join(least, "group", "left").select("node", F.coalesce("component", "node").alias("component")).unionByName(rings)


def loop_summary(edges: DataFrame) -> DataFrame:
    """(component, n_members, n_entries, n_exits, irreducible) of strong components of two nodes or more, or with an edge to itself.

    Entries are members with an edge from outside, exits members with one to the outside.
    """
    placed = written(strong_components(edges))
    lifted = edges.select("src", "dst").distinct().join(placed.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src").join(placed.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst")
    lifted = written(lifted)
    members = placed.groupBy("component").agg(F.count("*").alias("n_members"))
    own = lifted.where("src = dst").select(F.col("cs").alias("component")).distinct().withColumn("itself", F.lit(True))
    entries = lifted.where("cs <> cd").groupBy(F.col("cd").alias("component")).agg(F.count_distinct("dst").alias("n_entries"))
    exits = lifted.where("cs <> cd").groupBy(F.col("cs").alias("component")).agg(F.count_distinct("src").alias("n_exits"))
    loops_ = members.join(own, "component", "left").where("n_members > 1 OR itself").join(entries, "component", "left").join(exits, "component", "left")
    n = F.coalesce("n_entries", F.lit(0))
    return loops_.select("component", "n_members", n.alias("n_entries"), F.coalesce("n_exits", F.lit(0)).alias("n_exits"), (n > 1).alias("irreducible"))


def terminal_summary(edges: DataFrame, terminals: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """(node, samples, outcome, unresolved): the two smallest terminals that a node reaches, and none, unique or multiple.

    terminals(node), unresolved(node); a node reaches itself. Two samples a node are enough, so tables stay small.
    Where all have ``graph``, small parts are worked out each by itself (see ``parts``).
    """
    if "graph" in edges.columns:
        marks = [t.select("graph", F.col("node").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst")).where("src IS NOT NULL").distinct() for t in (terminals, unresolved) if t is not None]
        near, far = parts.split(parts.tagged(edges.select("graph", "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), *marks))
        found = parts.each(near, parts.ends_ahead, {"node": "node", "first": "node", "second": "node", "unresolved": "boolean"})
        samples = F.array_join(F.array_compact(F.array("first", "second")).cast("array<string>"), ",")
        found = found.select("node", samples.alias("samples"), F.when(F.col("first").isNull(), "none").when(F.col("second").isNull(), "unique").otherwise("multiple").alias("outcome"), "unresolved")
        of = lambda tag: far.where(F.col("tag") == tag).select(F.col("src").alias("node"))
        return found if far is None else found.unionByName(terminal_summary(far.where("tag = 0").select("src", "dst"), of(1), of(2)))
    edges = written(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).unionByName(terminals.select("node")).distinct()
    marked = terminals.select("node", F.col("node").alias("mark"), F.lit(False).alias("open"))
    if unresolved is not None:
        marked = marked.unionByName(unresolved.select("node", F.col("node").alias("mark"), F.lit(True).alias("open")))
    known = written(marked.groupBy("node", "open").agg(F.array_sort(F.collect_set("mark")).alias("marks")))
    fresh = known
    while not fresh.isEmpty():
        pushed = edges.join(fresh.select(F.col("node").alias("dst"), "open", "marks"), "dst").groupBy(F.col("src").alias("node"), "open").agg(F.flatten(F.collect_set("marks")).alias("more"))
        merged = pushed.join(known, ["node", "open"], "left").withColumn("new", F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce("marks", F.array().cast(known.schema["marks"].dataType)), "more"))), 1, 2))
        fresh = written(merged.where("marks IS NULL OR new <> marks").select("node", "open", F.col("new").alias("marks")))
        known = written(known.join(fresh.select("node", "open"), ["node", "open"], "left_anti").unionByName(fresh))
    closed = known.where("NOT open").select("node", "marks")
    opened = known.where("open").select("node", F.lit(True).alias("unresolved"))
    n = F.coalesce(F.size("marks"), F.lit(0))
    found = nodes.join(closed, "node", "left").join(opened, "node", "left")
    return found.select("node", F.coalesce(F.array_join(F.col("marks").cast("array<string>"), ","), F.lit("")).alias("samples"), F.when(F.col("marks").isNull() | (n == 0), "none").when(n == 1, "unique").otherwise("multiple").alias("outcome"), F.coalesce("unresolved", F.lit(False)).alias("unresolved"))


def procedure_summary(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(label, may_return, recursive): least fix-point over labels.

    nodes(node, label, kind): kind is entry, return or other; edges(src, dst)
    inside labels; calls(src, dst, callee): the edge from a call to what follows
    it, which can be crossed once its callee may return. A label may return if
    its entry reaches a return. It is recursive if its calls lead back to it.
    Stretches that hang on one node are crossed in one round; a round takes up
    what is newly reached and the calls to what newly returns, nothing else.
    """
    own = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    gated = calls.select("src", "dst", "callee").where("src IS NOT NULL AND dst IS NOT NULL AND callee IS NOT NULL").distinct()
    entry = nodes.where("kind = 'entry' AND node IS NOT NULL").select("node").distinct()
    none = F.lit(None).cast(edges.schema["src"].dataType).alias("src")
    ways = own.withColumn("fixed", F.lit(False)).unionByName(gated.select(none, "dst", F.lit(True).alias("fixed"))).unionByName(entry.select(none, F.col("node").alias("dst"), F.lit(False).alias("fixed")))
    places = led(ways)
    at = places.select(F.col("node").alias("src"), F.col("head").alias("from"), "reached")
    heads = places.where("node = head").select(F.col("node").alias("dst"))
    steps = own.join(heads, "dst", "left_semi").join(at, "src").select("from", F.col("dst").alias("to")).distinct()
    gates = written(gated.join(heads, "dst", "left_semi").join(at, "src").select("from", F.col("dst").alias("to"), "callee").distinct())
    ends = written(nodes.where("kind = 'return' AND label IS NOT NULL").select(F.col("node").alias("src"), "label").join(at, "src").select(F.col("from").alias("node"), "label", "reached").distinct())
    steps = written(steps)
    labels = written(ends.where("reached").select("label").distinct())  # those that are new
    fresh = written(steps.where("from IS NULL").select(F.col("to").alias("node")).distinct())
    seen, may = fresh, labels
    while not (fresh.isEmpty() and labels.isEmpty()):
        came, back = fresh.withColumnRenamed("node", "from"), may.withColumnRenamed("label", "callee")
        opened = gates.join(labels.withColumnRenamed("label", "callee"), "callee", "left_semi")  # by what has just been found to return
        moved = steps.join(came, "from", "left_semi").select("to").unionByName(gates.join(came, "from", "left_semi").join(back, "callee", "left_semi").select("to"))
        moved = moved.unionByName(opened.where("from IS NULL").select("to")).unionByName(opened.join(seen.withColumnRenamed("node", "from"), "from", "left_semi").select("to"))
        done = ends.join(fresh, "node", "left_semi").select("label").distinct().join(may, "label", "left_anti")
        fresh, labels = written(moved.select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")), written(done)
        seen, may = written(seen.unionByName(fresh)), written(may.unionByName(labels))
    called = calls.join(nodes.select(F.col("node").alias("src"), "label"), "src").select(F.col("label").alias("src"), F.col("callee").alias("dst")).distinct()
    loops_ = strong_components(called)
    self_ = called.where("src = dst").select(F.col("src").alias("label"))
    several = loops_.join(loops_.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component", "left_semi").select(F.col("node").alias("label"))
    names = nodes.where("kind = 'entry'").select("label").distinct()
    returning = may.select("label", F.lit(True).alias("r"))
    recursive = self_.unionByName(several).distinct().select("label", F.lit(True).alias("c"))
    return names.join(returning, "label", "left").join(recursive, "label", "left").select("label", F.coalesce("r", F.lit(False)).alias("may_return"), F.coalesce("c", F.lit(False)).alias("recursive"))


def terminals(nodes: DataFrame, edges: DataFrame, called: DataFrame) -> DataFrame:
    """(node, terminal) of nodes(node, kind, label) that end a walk; called(label) are the labels that some call leads to."""
    out = edges.select(F.col("src").alias("node")).distinct().withColumn("goes", F.lit(True))
    rows = nodes.join(out, "node", "left").join(called.select("label", F.lit(True).alias("used")).distinct(), "label", "left")
    stuck = F.col("goes").isNull()
    kind = (
        F.when(F.col("kind") == "module_end", "module_end")
        .when(F.col("kind").isin("unresolved", "scope_boundary"), "unresolved")
        .when((F.col("kind") == "return") & F.col("used").isNull(), "return")
        .when(F.col("kind") == "return", "procedure_return_boundary")
        .when(stuck & (F.col("kind") == "call"), "non_returning_call")
        .when(stuck, "dead_end")
    )
    return rows.select("node", kind.alias("terminal")).where("terminal IS NOT NULL")


def contracted(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """edges(src, dst, kind), kept(node) -> (src, dst, kind, n_steps): kept nodes joined by walks over all others.

    Of the walks from one kept node to another, the one of fewest steps counts,
    its kind being the highest ranking on it. A node is passed once from a source.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in KIND_RANK.items()], F.lit(1))
    ranked = written(edges.select("src", "dst", rank.alias("rank")).groupBy("src", "dst").agg(F.max("rank").alias("rank")))
    ends = kept.select("node").distinct().withColumn("stop", F.lit(True))
    ranked = written(ranked.join(ends.select(F.col("node").alias("dst"), "stop"), "dst", "left").select("src", "dst", "rank", F.coalesce("stop", F.lit(False)).alias("stop")))
    first = ranked.join(ends.select(F.col("node").alias("src")), "src", "left_semi")
    seen = written(first.select("src", F.col("dst").alias("at"), "rank", F.lit(1).alias("n_steps"), "stop"))
    frontier = seen
    while True:
        going = frontier.where("NOT stop").select("src", F.col("at").alias("via"), F.col("rank").alias("r"), "n_steps")
        step = going.join(ranked.withColumnRenamed("src", "via"), "via").groupBy("src", F.col("dst").alias("at"), "stop").agg(F.max(F.greatest("rank", "r")).alias("rank"), F.min(F.col("n_steps") + 1).cast("int").alias("n_steps"))
        frontier = written(step.join(seen.select("src", "at"), ["src", "at"], "left_anti").select("src", "at", "rank", "n_steps", "stop"))
        if frontier.isEmpty():
            break
        seen = written(seen.unionByName(frontier))
    kind = F.coalesce(*[F.when(F.col("rank") == v, k) for k, v in KIND_RANK.items()])
    return seen.where("stop").select("src", F.col("at").alias("dst"), kind.alias("kind"), "n_steps")


def group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """edges(src, dst, kind, id), groups(node, grp) -> (src_group, dst_group, kind, n): the highest ranking kind between two groups."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in KIND_RANK.items()], F.lit(1))
    lifted = edges.join(groups.select(F.col("node").alias("src"), F.col("grp").alias("src_group")), "src").join(groups.select(F.col("node").alias("dst"), F.col("grp").alias("dst_group")), "dst")
    merged = lifted.where("src_group <> dst_group").groupBy("src_group", "dst_group").agg(F.max(rank).alias("rank"), F.count_distinct("id").alias("n"))
    return merged.select("src_group", "dst_group", F.coalesce(*[F.when(F.col("rank") == v, k) for k, v in KIND_RANK.items()]).alias("kind"), "n")


def hierarchy_faults(parents: DataFrame) -> DataFrame:
    """parents(node, parent) -> (node, fault): ``unknown_parent`` where the parent is no node, ``cycle`` where a node is its own ancestor."""
    unknown = parents.where("parent IS NOT NULL").join(parents.select(F.col("node").alias("parent")), "parent", "left_anti").select("node", F.lit("unknown_parent").alias("fault"))
    up = parents.where("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    placed = written(strong_components(up))
    several = placed.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    looped = placed.join(several, "component", "left_semi").select("node").unionByName(up.where("src = dst").select(F.col("src").alias("node")))
    return unknown.unionByName(looped.distinct().select("node", F.lit("cycle").alias("fault")))


def backward(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, depth): what reaches a target, by fewest steps."""
    return depths(reversed_edges(edges), targets)
