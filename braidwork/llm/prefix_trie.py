"""Prefix trie of conversations by preorder intervals.

A conversation is a sequence of turns (role, text). Each distinct prefix is a
node. Nodes are ranked lexicographically by their paths; each is sorted twice, as
its path (where its subtree opens) and as its path with a symbol above all others
(where it closes). Running totals over that order, taken at both places, differ by
what the subtree holds: its nodes, leaves and savings. So depth costs no rounds
but those of ``_ranked_events``, one for each power of ``BLOCK`` in the longest path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.llm.linking import left_join
from braidwork.llm.ordered import ordered
from braidwork.llm.scratch import step, written

#: Turns compared at once; a longer path is compared by the ranks of its blocks of so many turns.
BLOCK = 64

#: Conversation ids joined into one string before the digest of a node's list is taken.
IDS = 1 << 16

_NODE, _PARENT = ["na", "nb"], ["pa", "pb"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, n_bytes): the turns of each conversation from 0, as two hashes of role and text, and the text's UTF-8 bytes. Written.

    Turns stand in the order of ``turn``, null first; rows of one turn by role (null last, as in
    the SQL), then by hash. Rows without conv_id belong to no conversation. Null role or text is empty.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    placed = ordered(rows, "conv_id", F.asc_nulls_first("turn"), F.asc_nulls_last("role"), "a", "b", segment="conv_id", without=("turn", "role"), name="turns")
    return placed.select("conv_id", "place", "a", "b", "n_bytes")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, n): turns a conversation."""
    return turns.groupBy("conv_id").agg((F.max("place") + 1).alias("n"))


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: rows(conv_id, depth, a, b, n_bytes, length) and convs(conv_id, length), as ``trie`` takes them."""
    convs = written(lengths(turns).select("conv_id", F.col("n").alias("length")), name="convs")
    rows = left_join(turns, convs.withColumn("n", F.col("length")), "conv_id", "n")
    return rows.select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "n_bytes", "length"), convs


def spliced(turns: DataFrame, *, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: c takes the first h turns of conversation c - c % group, then its own after its first h; h = crc32(c) % most.

    Rows and convs as from ``whole``. Where that conversation is absent, nothing is taken.
    """
    known = written(lengths(turns), name="convs")
    lent = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    asked = known.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), lent.alias("h"))
    asked = asked.join(known.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(asked.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "n", "h", "taken", "length"), name="convs")
    opening = turns.where(F.col("place") < most - 1).withColumnRenamed("conv_id", "base")
    heads = opening.join(convs, "base").where("place < taken").select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "n_bytes", "length")
    tails = left_join(turns, convs.select("conv_id", "n", "h", "taken", "length"), "conv_id", "n").where("place >= h")
    tails = tails.select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "a", "b", "n_bytes", "length")
    return heads.unionByName(tails), convs.select("conv_id", "length")


def _running(values: str, *partition) -> F.Column:
    return F.collect_list(values).over(W.partitionBy(*partition).orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow))


def _ranked_events(nodes: DataFrame, paths: DataFrame, deepest: int, block: int) -> DataFrame:
    """Two rows a node, where its subtree opens and closes, with totals over all rows up to each in lexicographic order of paths.

    nodes(na, nb, .., word) holds the turns of a node's last block. While paths are
    longer than the blocks compared, events are named by the rank of their block, and
    the names take the place of turns: a subtree stays an interval, as a block that
    lies between a block and what extends it extends it too.
    """
    close = F.array(F.struct(F.lit((1 << 63) - 1).alias("a"), F.lit((1 << 63) - 1).alias("b")))
    events = nodes.withColumn("opens", F.lit(1).cast("long")).unionByName(nodes.withColumn("opens", F.lit(0).cast("long")).withColumn("word", F.concat("word", close)))
    span = block
    while span < deepest:
        named = ordered(events.withColumn("mark", F.xxhash64("word")), "word", "na", "nb", "opens", segment="mark", without=("word",), name="named")
        named = named.withColumn("name", F.col("rank") - F.col("place"))  # equal blocks lie side by side and share a name
        full = paths.where(F.col("depth") % span == 0).select("conv_id", "depth", *_NODE)
        full = left_join(full, named.where("opens = 1").select(*_NODE, "name", "n_convs"), _NODE, "n_convs")
        element = (F.col("depth") / span).cast("long") - 1
        before = full.select("conv_id", element.alias("element"), _running("name", "conv_id", F.floor(element / block)).alias("names"))
        element = F.floor((F.greatest("depth", F.lit(1)) - 1) / span)
        events = named.withColumn("element", F.when(element % block > 0, element - 1)).join(before, ["conv_id", "element"], "left")
        events = events.withColumn("word", F.concat(F.coalesce("names", F.array().cast("array<bigint>")), F.array("name"))).select(*nodes.columns, "opens")
        span *= block
    counted = events.withColumn("leaf", F.when(F.col("n_children") == 0, F.col("opens")).otherwise(0)).withColumn("saved", F.col("opens") * (F.col("n_convs") - 1) * F.col("n_bytes"))
    return ordered(counted, "word", "na", "nb", "opens", sums=("opens", "leaf", "saved"), without=("word",), name="events")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (na, nb, conv_id) in order -> (na, nb, first, ids): up to ``IDS`` ids of a node as one string."""
    for batch in batches:
        na, nb, ids = (c.to_numpy() for c in batch.columns)
        if not len(ids):
            continue
        cuts = np.flatnonzero((na[1:] != na[:-1]) | (nb[1:] != nb[:-1])) + 1
        cuts = np.unique(np.concatenate([[0], cuts, np.arange(0, len(ids), IDS), [len(ids)]]))
        texts = ids.tolist()
        at = cuts[:-1]
        joined = [",".join(map(str, texts[x:y])) for x, y in pairwise(cuts.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(na[at]), pa.array(nb[at]), pa.array(ids[at]), pa.array(joined)], names=["na", "nb", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (na, nb, first, ids) in order -> (na, nb, ends_sha256). What is kept between rows is one digest."""
    last, digest = None, None
    for batch in batches:
        out = []
        for na, nb, ids in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ids")), strict=True):
            if (na, nb) == last:
                digest.update(b",")
            else:
                if last is not None:
                    out.append((*last, digest.hexdigest()))
                last, digest = (na, nb), hashlib.sha256()
            digest.update(ids.encode())
        yield _digest_rows(out)
    if last is not None:
        yield _digest_rows([(*last, digest.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    na, nb, texts = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(texts, pa.string())], names=["na", "nb", "ends_sha256"])


def trie(rows: DataFrame, convs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Nodes of the prefix trie of rows(conv_id, depth from 1, a, b, n_bytes, length), convs(conv_id, length) naming all conversations, empty ones too.

    Returns conv_id (smallest member), depth, parent_conv_id (of the root null), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 and the preorder interval first_node
    to last_node. Members are conversations that begin with the node's turns; the root has
    all. Without conversations there is no node. A node is told by 128 bits that
    its turns and their places are hashed to; turns alike in both hashes are one.

    The ids of conversations that end at one node are hashed in a row, which no one can do
    in parts; they are sorted by ranges and joined to long strings first, so the task
    that hashes a large group reads few rows.
    """
    with step() as keep:
        keyed = rows.withColumns({"xa": F.xxhash64("a", "depth"), "xb": F.xxhash64(F.lit(1), "depth", "b")})
        paths = ordered(keyed, "conv_id", "depth", segment="conv_id", xors=("xa", "xb"), name="paths")
        paths = paths.select("conv_id", "depth", "length", "n_bytes", F.struct("a", "b").alias("turn"), F.col("xor_xa").alias("na"), F.col("xor_xb").alias("nb"), F.col("xor_xa").bitwiseXOR(F.col("xa")).alias("pa"), F.col("xor_xb").bitwiseXOR(F.col("xb")).alias("pb"))
        worded = paths.withColumn("word", _running("turn", "conv_id", F.floor((F.col("depth") - 1) / block)))
        nodes = worded.groupBy(*_NODE, *_PARENT, "depth", "n_bytes", "word").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        zero = F.lit(0).cast("long")
        root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select("conv_id", "n_convs", zero.alias("depth"), zero.alias("n_bytes"), *[zero.alias(c) for c in _NODE], *[F.lit(None).cast("long").alias(c) for c in _PARENT], F.array().cast(nodes.schema["word"].dataType).alias("word"))
        nodes = written(nodes.withColumn("depth", F.col("depth").cast("long")).unionByName(root), name="nodes", release=True)
        children = nodes.where("depth > 0").groupBy(*_PARENT).agg(F.count("*").alias("n_children")).select(F.col("pa").alias("na"), F.col("pb").alias("nb"), "n_children")
        nodes = written(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), name="nodes")
        deepest = nodes.agg(F.max("depth")).first()[0] or 0
        events = _ranked_events(nodes, paths, deepest, block)
        opens = F.col("opens") == 1
        differs = lambda c, own: F.sum(F.when(opens, F.col(own) - F.col(f"sum_{c}")).otherwise(F.col(f"sum_{c}")))
        sized = events.groupBy(*_NODE, *_PARENT, "conv_id", "depth", "n_convs", "n_children").agg(
            differs("leaf", "leaf").alias("n_leaves"), differs("saved", "saved").alias("saved_tokens"), (F.min("sum_opens") - 1).alias("first_node"), (F.max("sum_opens") - 1).alias("last_node")
        )
        ends = paths.where("depth = length").select(*_NODE, "conv_id").unionByName(convs.where("length = 0").select(zero.alias("na"), zero.alias("nb"), "conv_id"))
        packed = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInArrow(_packed, "na long, nb long, first long, ids string")
        digests = packed.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digests, "na long, nb long, ends_sha256 string")
        sized = written(sized.join(digests, _NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))), name="sized", release=True)
        parents = sized.where("n_children > 0").select(F.col("na").alias("pa"), F.col("nb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
        children = left_join(sized.withColumnRenamed("n_children", "children"), parents, _PARENT, "n_children")
        found = written(children.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256", "first_node", "last_node"), name="trie")
        keep(found)
    return found
