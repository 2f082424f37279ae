"""From shared keys to components: hub links, cross-component pairs, union-find.

Near-duplicate operators need the connected components of "similar" pairs, not
the pairs themselves. A key shared by m items gives m - 1 hub pairs; only items
that these leave in different components meet again, and then only those pass
the join whose sizes and sketches leave room for the threshold. So a large
group of copies costs a number of rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.scratch import drop, written

#: Rows of a key that one task compares against another's rows; larger keys are dealt to several tasks.
SALT_ROWS = 4096

#: Rows from which a key is joined by broadcast, and how many such keys may be.
HOT, MOST_BROADCAST = 1000, 1_000_000


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id) in order, those of keys with two ids or more, each once. What is kept between batches is one row."""
    last_key, last_id, shown = None, None, False  # the row before, and whether it has been handed on
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        if last_key is not None:
            keys, ids = np.append(last_key, keys), np.append(last_id, ids)
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
        first = np.append(shown and last_key is not None, np.zeros(len(keys) - 1, dtype=bool))  # handed on before
        keys, ids, first = keys[fresh], ids[fresh], first[fresh]
        same = keys[1:] == keys[:-1]
        shared = np.append(False, same) | np.append(same, False)
        shared[-1] |= bool(first[-1])
        give = shared & ~first
        last_key, last_id, shown = keys[-1], ids[-1], bool(shared[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[give]), pa.array(ids[give])], names=["key", "id"])


def shared_postings(postings: DataFrame) -> DataFrame:
    """postings(key, id) -> (key, id) of keys with two ids or more. Written.

    Rows are dealt and sorted by key; a pass over them in order tells which keys
    repeat, so a key of any size takes no more memory than one of two. The key
    stands last while rows are dealt: the empty bytes of a short one and those
    that begin the next row are compressed together.
    """
    rows = postings.select("id", "key").repartition("key").sortWithinPartitions("key", "id")
    return written(rows.select("key", "id").mapInArrow(_repeated, "key long, id long"), name="postings", release=True)


def with_hubs(held: DataFrame, weights: DataFrame) -> DataFrame:
    """held(key, id), weights(id, w) -> (key, id, hub): the id of most weight among those of a key, ties by the larger id.

    A common original makes a better hub than one of its variants: more is linked at once.
    """
    rows = held.join(weights, "id")
    hubs = rows.groupBy("key").agg(F.max(F.struct("w", "id")).alias("top")).select("key", F.col("top.id").alias("hub"))
    return written(held.join(hubs, "key").select("key", "id", "hub"), name="hubs")


def hub_pairs(held: DataFrame) -> DataFrame:
    """(a, b, n_common): each item with the hub of its keys, and the number of keys that tie them."""
    return held.where("id <> hub").groupBy(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).agg(F.count("*").alias("n_common"))


def labelled(held: DataFrame, components: DataFrame) -> DataFrame:
    """``held`` with component; items that no link reaches are their own."""
    return held.join(components.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def split_keys(held: DataFrame) -> DataFrame:
    """Keys whose items lie in several components: (key, n, n_cross, major), n_cross being the pairs across components, major the largest one."""
    groups = held.groupBy("key", "component").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    return (
        groups.groupBy("key")
        .agg(F.count("*").alias("n_components"), F.sum("n").alias("n"), F.sum(n * n).alias("squares"), F.max(F.struct("n", "component")).alias("top"))
        .where("n_components > 1")
        .select("key", "n", ((n * n - F.col("squares")) / 2).alias("n_cross"), F.col("top.component").alias("major"))
    )


def cross_pairs(held: DataFrame, keys: DataFrame, possible, *, once: bool = False) -> DataFrame:
    """(a, b) of items in different components that share one of ``keys`` (of ``split_keys``), where ``possible`` holds.

    held(key, id, component, ..); possible(x, y) is a condition over functions
    that name a column of either side. Rows of the largest component of a key
    meet only rows of others, and the condition is part of the join. ``once`` is
    for items of few keys: each row carries all of its item's, and a pair leaves
    the join at the smallest key it shares alone.
    """
    marked = held.join(keys.select("key", "major", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")), "key")
    if once:
        marked = marked.join(marked.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    marked = written(marked, name="marked")
    columns = [c for c in marked.columns if c not in ("salts", "major")]
    minor = marked.where("component <> major").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    every = marked.withColumn("lead", F.col("component") == F.col("major")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    left = minor.select("salt", *[F.col(c).alias(f"x_{c}") for c in columns])
    right = every.select("lead", F.col("salt").alias("y_salt"), *[F.col(c).alias(f"y_{c}") for c in columns])
    meets = (F.col("x_key") == F.col("y_key")) & (F.col("salt") == F.col("y_salt")) & (F.col("x_component") != F.col("y_component")) & (F.col("lead") | (F.col("x_id") < F.col("y_id")))
    meets = meets & possible(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))
    if once:
        meets = meets & (F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("x_key"))
    found = left.join(right, meets)
    return found.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def left_join(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of ``table``(key, .., size) but for ``size``, which is how many rows a key has, about.

    Keys of ``HOT`` rows or more are joined by broadcast: there is at most one in
    so many rows of them. The others are dealt by key, none of them large.
    """
    common = table.where(F.col(size) >= HOT)
    if common.count() > MOST_BROADCAST:
        return rows.join(table.drop(size), key, "left")
    marked = rows.join(F.broadcast(common.drop(size).withColumn("often", F.lit(True))), key, "left")
    rest = marked.where("often IS NULL").select(*rows.columns).join(table.where(F.col(size) < HOT).drop(size), key, "left")
    return marked.where("often").drop("often").unionByName(rest)


def least_difference(x, y, names: list[str]) -> Column:
    """At least so many elements stand in one of two sets alone, by their sketches in the columns ``names``."""
    return sum((F.bit_count(x(s).bitwiseXOR(y(s))) for s in names[1:]), F.bit_count(x(names[0]).bitwiseXOR(y(names[0]))))


def connected_components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (id, component) of every id in a link; component is the smallest id it reaches.

    Alternating large-star and small-star rounds: each moves edges onto smaller
    ids, until every id points at its component. Each round is a written table;
    only whether it has settled reaches the driver.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name="edges")
    for _ in range(most_rounds):
        if _settled(edges):
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), name="edges")
        drop(edges)
        edges = following
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: one way down from each id, and none from a star's centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()
