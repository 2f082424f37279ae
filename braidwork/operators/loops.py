"""Fix-point loops over edge tables: every round is a written table, so a lost executor costs one round at most.

Ids may be of any one type. Linear chains are crossed in one round, whatever their length.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table under spark.checkpoint.dir, or under the warehouse where that is unset; gone when the driver ends."""
    spark = df.sparkSession
    folder, warehouse = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not folder:
        if (":" not in warehouse or warehouse.startswith("file:")) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset, and the warehouse is a local folder")
        folder = f"{warehouse}/_scratch"
    path = f"{folder.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def chains(edges: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """edges(src, dst) -> (node, head, at, cyclic): each node's linear chain by its first node, and its place in it from 0.

    A chain goes on over an edge that is the only one out of its source and the
    only one into its target; nodes of ``heads`` begin a chain of their own. In a
    ring of such edges, ``head`` is the smallest node and ``cyclic`` is true.
    Pointers to the node before are doubled until all have reached a head.
    """
    plain = edges.select("src", "dst").where("src <> dst").distinct()
    out_one = plain.groupBy("src").agg(F.count("*").alias("n")).where("n = 1").select("src")
    in_one = edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select("dst")
    links = plain.join(out_one, "src", "left_semi").join(in_one, "dst", "left_semi")
    if heads is not None:
        links = links.join(heads.select(F.col("node").alias("dst")), "dst", "left_anti")
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    table = nodes.join(links.select(F.col("dst").alias("node"), F.col("src").alias("before")), "node", "left")
    table = table.select("node", F.coalesce("before", "node").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("at"), F.col("node").alias("least"), F.col("before").isNull().alias("done"))
    table, steps = written(table), 0
    total = table.count()
    while (1 << steps) <= 2 * max(total, 1) and not table.where("NOT done").isEmpty():
        ahead = table.select(F.col("node").alias("head"), F.col("head").alias("h"), F.col("at").alias("a"), F.col("least").alias("l"), F.col("done").alias("d"))
        table = written(
            table.join(ahead, "head").select(
                "node", F.when(F.col("done"), F.col("head")).otherwise(F.col("h")).alias("head"), F.when(F.col("done"), F.col("at")).otherwise(F.col("at") + F.col("a")).alias("at"),
                F.least("least", "l").alias("least"), (F.col("done") | F.col("d")).alias("done"),
            )
        )
        steps += 1
    ring = ~F.col("done")
    return table.select("node", F.when(ring, F.col("least")).otherwise(F.col("head")).alias("head"), F.when(ring, F.lit(None)).otherwise(F.col("at")).alias("at"), ring.alias("cyclic"))


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges(src, dst), roots(node) -> (node, depth): fewest steps from a root, for every node reached; chains are crossed in one round."""
    edges = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    roots = written(roots.select("node").where("node IS NOT NULL").distinct())
    places = written(chains(edges, roots))
    line = places.where("NOT cyclic")
    tails = line.groupBy("head").agg(F.max("at").alias("length"), F.max_by("node", "at").alias("tail"))
    steps = edges.join(tails.select(F.col("tail").alias("src"), F.col("head").alias("from"), (F.col("length") + 1).alias("cost")), "src")
    steps = written(steps.join(line.where("at = 0").select(F.col("node").alias("dst")), "dst", "left_semi").select("from", F.col("dst").alias("to"), "cost"))
    known = written(roots.select(F.col("node").alias("head"), F.lit(0).cast("long").alias("depth")))
    frontier = known
    while not frontier.isEmpty():
        reached = frontier.join(steps, F.col("head") == F.col("from")).groupBy(F.col("to").alias("head")).agg(F.min(F.col("depth") + F.col("cost")).alias("depth"))
        frontier = written(reached.join(known.select("head", F.col("depth").alias("old")), "head", "left").where("old IS NULL OR depth < old").select("head", "depth"))
        known = written(known.join(frontier.select("head"), "head", "left_anti").unionByName(frontier))
    within = line.join(known, "head").select("node", (F.col("depth") + F.col("at")).alias("depth"))
    alone = known.select(F.col("head").alias("node"), "depth").join(within.select("node"), "node", "left_anti")
    return within.unionByName(alone)


def led(ways: DataFrame) -> DataFrame:
    """ways(src, dst, fixed) -> (node, head, reached): the node that decides for each target whether it is reached, itself or one that it hangs on.

    A way without ``src`` comes from what is reached. A target with one way in is
    reached if that way's source is, unless it is ``fixed``; pointers to such
    sources are doubled. Targets that hang on a node without a way in, or in a ring
    without one, are never reached and left out. ``head`` is null where ``reached``.
    """
    several = F.col("fixed") | (F.col("n") > 1)
    table = ways.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("one"), F.bool_or(F.col("src").isNull() & ~F.col("fixed")).alias("reached"), F.bool_or("fixed").alias("fixed"))
    table = written(table.select("node", F.when(F.col("reached"), None).when(several, F.col("node")).otherwise(F.col("one")).alias("head"), "reached", (F.col("reached") | several).alias("done")))
    before, open_ = None, table.where("NOT done").count()
    while open_ and open_ != before:  # where none is settled in a step, rings are left
        ahead = table.select(F.col("node").alias("head"), F.col("head").alias("h"), F.col("reached").alias("r"), F.col("done").alias("d"))
        moved = table.where("NOT done").join(ahead, "head").select("node", F.col("h").alias("head"), F.col("r").alias("reached"), F.col("d").alias("done"))
        table = written(table.where("done").unionByName(moved))
        before, open_ = open_, table.where("NOT done").count()
    return table.where("done").drop("done")


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges(src, dst), roots(node) -> (node): what a root leads to, roots included.

    What hangs on one node is put together with it, what nothing leads to goes, and
    what is left is put together again. Rounds follow how ways part and meet,
    not their length; two ways crossed at every step take a round a step.
    """
    roots = written(roots.select("node").where("node IS NOT NULL").distinct())
    mark = roots.select(F.col("node").alias("src"), F.lit(True).alias("root"))
    plain = edges.select("src", "dst").where("src <> dst").join(roots.select(F.col("node").alias("dst")), "dst", "left_anti").join(mark, "src", "left")
    left = written(plain.select(F.when(F.col("root").isNull(), F.col("src")).alias("src"), "dst").distinct())
    found, levels = [roots], []
    while not left.where("src IS NULL").isEmpty():
        places = led(left.withColumn("fixed", F.lit(False)))
        found.append(places.where("reached").select("node"))
        levels.append(places.where("node <> head").select("node", "head"))
        ahead = left.join(places.where("node = head").select(F.col("node").alias("dst")), "dst", "left_semi").join(places.withColumnRenamed("node", "src"), "src")
        left = written(ahead.select(F.col("head").alias("src"), "dst").where("src IS NULL OR src <> dst").distinct())
    known = written(reduce(DataFrame.unionByName, found))
    for level in reversed(levels):  # what hangs on a node that was settled later
        known = written(known.unionByName(level.join(known.withColumnRenamed("node", "head"), "head").select("node")))
    return known


def breadth_first(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """edges(src, dst), roots(node) -> (node, depth, pred) of every node reached; pred is the smallest predecessor one step nearer."""
    found = written(depths(edges, roots))
    near = edges.select("src", "dst").join(found.select(F.col("node").alias("src"), F.col("depth").alias("from")), "src")
    back = found.join(near, F.col("dst") == F.col("node"), "left").groupBy("node", "depth").agg(F.min(F.when(F.col("from") == F.col("depth") - 1, F.col("src"))).alias("pred"))
    return back.select("node", F.col("depth").cast("int").alias("depth"), "pred")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """edges(src, dst) -> (node, component): the smallest node of each weakly connected component.

    Alternating star contraction: hubs' edges move to ever smaller nodes, in a
    number of rounds that grows with the logarithm of the size.
    """
    pairs = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        after = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
            loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
            return found.unionByName(loops.select("node", F.col("node").alias("component")))
        before = after
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def window_between(edges: DataFrame, entry: DataFrame, exit_: DataFrame) -> DataFrame:
    """(node): nodes on some walk from an entry to an exit: forward reach and backward reach."""
    return reached(edges, entry).join(reached(reversed_edges(edges), exit_), "node", "left_semi")


def linear_chains(edges: DataFrame) -> DataFrame:
    """(node, chain): maximal runs joined by edges whose source has one way out and whose target one way in; chain is its smallest node."""
    plain = edges.where("src <> dst").distinct()
    out_one = plain.groupBy("src").agg(F.count("*").alias("n")).where("n = 1").select("src")
    in_one = plain.groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select("dst")
    return components(plain.join(out_one, "src", "left_semi").join(in_one, "dst", "left_semi")).withColumnRenamed("component", "chain")


def quotient(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """edges(src, dst, role), groups(node, grp) -> (src_group, dst_group, n_edges, roles): no edges inside a group, roles sorted and joined."""
    lifted = edges.join(groups.select(F.col("node").alias("src"), F.col("grp").alias("src_group")), "src").join(
        groups.select(F.col("node").alias("dst"), F.col("grp").alias("dst_group")), "dst"
    )
    return lifted.where("src_group <> dst_group").groupBy("src_group", "dst_group").agg(
        F.count("*").alias("n_edges"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles")
    )
