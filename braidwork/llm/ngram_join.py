"""Near-duplicate documents by Jaccard similarity of word shingles, exactly.

Token-combination prefixes. A document's tokens are its distinct shingles in
hash order, which is the same order everywhere. Two documents of at least the
threshold share a token among their first n - ceil(t n) + 1; with both prefixes
extended by K tokens they share K + 1. A token is frequent where its items lie
in so many components that pairing them would cost more than ``RARE`` pairs an
item; all others are rare. A document is crowded if its prefix holds more
frequent tokens than K of the smallest partner it may have: any pair with one
that is not crowded shares a rare token, and rare tokens are indexed singly.

Crowded documents are indexed once more among themselves, in an order of rare
tokens first. Either a rare token of their prefixes is shared, or both hold fewer
rare tokens than a prefix has, and share none of them. Then all that they share
are frequent tokens, and these differ in at most H - r - r' places: H is what
the threshold allows for their sizes, r and r' are their numbers of rare tokens.
Dealt by hash into more classes than that, the frequent tokens of some classes
are the same in both: each class's tokens together are one combination, indexed
as one key. There are as many classes to spare as lets one such class hold
tokens, but for documents with more empty classes, which index those too.
Candidates are verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import textops
from braidwork.llm.linking import connected_components, cross_pairs, hub_pairs, labelled, least_difference, left_join, shared_postings, split_keys, with_hubs
from braidwork.llm.scratch import drop, step, written

#: Cross-component pairs per item up to which a token is indexed singly.
RARE = 5

#: Candidate documents up to which their ids are broadcast to the scan of the texts (8 bytes each).
MOST_BROADCAST = 1_000_000

#: Steps in which the numbers of rare tokens of a pair are told apart.
STEPS = 8

#: Words of 64 bits of a document's sketch.
_WORDS = 16
_SKETCH = [f"s{i}" for i in range(_WORDS)]


def extension(n: np.ndarray) -> np.ndarray:
    """How many tokens the prefix of n shingles is extended by."""
    return 2 + n * 3 // 100


def _nodes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's set."""
    n = np.diff(at)
    node = np.zeros(len(n), textops.U)
    np.add.at(node, np.repeat(np.arange(len(n)), n), textops.mix(values ^ textops.U(0x5851F42D4C957F2D)))
    return textops.mix(node + n.astype(textops.U)).view(np.int64)


def _sketch(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for start, part in textops.pieces(texts):
                hashes, _, _, first = textops.words(part)
                values, at = textops.distinct_by_row(*textops.shingles(hashes, first, width))
                n = np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                length = np.minimum(n, n - -(-percent * n // 100) + 1 + extension(n))
                keep = (np.arange(len(values)) - at[:-1][row]) < length[row]
                cut = np.zeros(len(at), np.int64)
                np.cumsum(length, out=cut[1:])
                sketch = textops.sketches(values, at, _WORDS).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(start, len(part)), batch.column(0).slice(start, len(part)), pa.array(n), pa.array(_nodes(values, at)), textops.list_column(values[keep], cut), *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(_WORDS)]],
                    names=["row_key", "doc_id", "n_shingles", "node", "prefix", *_SKETCH],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in textops.pieces(batch.column(0)):
                hashes, _, _, first = textops.words(part)
                values, at = textops.distinct_by_row(*textops.shingles(hashes, first, width))
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(values, at)), textops.list_column(values, at)], names=["id", "shingles"])

    return run


def _combinations(percent: int):
    """(id, n, r, heavy) -> (key, id, r): each class of a document's frequent tokens as one key.

    Sizes are told apart in levels a factor of 1 / threshold wide, so a pair
    has a level in common: its larger one's. Numbers of rare tokens are told
    apart in ``STEPS``; a document has keys for each step its partner may be in.
    """
    ratio = 100 / percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, r, lists = (batch.column(k) for k in range(4))
            sizes, rare = n.to_numpy(), r.to_numpy()
            values, at = lists.flatten().to_numpy().view(textops.U), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
            classed, spread = textops.mix(values + textops.U(77)) >> textops.U(32), textops.mix(values ^ textops.U(0x2545F4914F6CDD1D))
            keys, rows = [], []
            for k in range(len(sizes)):
                level = math.floor(math.log(sizes[k]) / math.log(ratio) + 1e-9)
                of, own = classed[at[k] : at[k + 1]], spread[at[k] : at[k + 1]]
                for lv in (level, level + 1):
                    most = math.ceil(ratio ** (lv + 1) + 1e-6)  # no document of the level is larger
                    allowed = 2 * most * (100 - percent) // (100 + percent)
                    mine = int(rare[k]) * STEPS // (allowed + 1)
                    for theirs in range(STEPS):
                        left = allowed - -(-mine * (allowed + 1) // STEPS) - -(-theirs * (allowed + 1) // STEPS)
                        if left < 0:
                            break
                        spare = 1 + left // 8
                        n_classes = left + 1 + spare  # of which one more than ``spare`` are the same in both
                        classes = (of * textops.U(n_classes) >> textops.U(32)).astype(np.int64)
                        sums = np.zeros(n_classes, textops.U)
                        np.add.at(sums, classes, own)
                        some = np.flatnonzero(np.bincount(classes, minlength=n_classes))
                        if n_classes - len(some) > spare:
                            some = np.arange(n_classes)
                        tag = textops.U(((lv * STEPS + min(mine, theirs)) * STEPS + max(mine, theirs)) << 32)
                        keys.append(textops.mix(textops.mix(sums[some]) + tag + some.astype(textops.U)))
                        rows.append(np.full(len(some), k))
            row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            key = pa.array((np.concatenate(keys) if keys else np.zeros(0, textops.U)).view(np.int64))
            yield pa.RecordBatch.from_arrays([key, ids.take(row), r.take(row)], names=["key", "id", "r"])

    return run


class _Join:
    """The tables that the steps of one join share."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("row_key"))
        self.width, self.percent = width, percent
        self.base = written(
            self.docs.mapInArrow(_sketch(width, percent), "row_key long, doc_id long, n_shingles long, node long, prefix array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)), name="sketch"
        )
        self.nodes = written(
            self.base.where("n_shingles > 0")
            .groupBy(F.col("node").alias("id"))
            .agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"), F.first(F.size("prefix").cast("long")).alias("n_prefix"), F.count("*").alias("n_copies"), *[F.first(s).alias(s) for s in _SKETCH]),
            name="nodes",
        )

    def whole_sets(self, nodes: DataFrame) -> DataFrame:
        """nodes(id) -> (id, shingles), read from the texts again. Written."""
        ids = written(nodes.join(self.nodes.select("id", "doc_id"), "id").select("doc_id").where("doc_id IS NOT NULL").distinct(), name="ids")
        texts = self.docs.join(_small(ids, MOST_BROADCAST), "doc_id", "left_semi").unionByName(self.docs.where("doc_id IS NULL"))
        sets = texts.select("text").mapInArrow(_sets(self.width), "id long, shingles array<long>")
        return written(sets.join(nodes, "id", "left_semi").dropDuplicates(["id"]), name="sets", release=True)

    def possible(self, names: list[str], *, rare: bool = False):
        """Whether sizes and sketches (and numbers of rare tokens, where none is shared) leave room for the threshold."""
        p = self.percent

        def condition(x, y):
            n = x("n") + y("n")
            allowed = n * (100 - p)  # times 100 + p: how many elements may stand in one set alone
            near = (100 * x("n") >= p * y("n")) & (100 * y("n") >= p * x("n")) & ((100 + p) * least_difference(x, y, names) <= allowed)
            return near & ((100 + p) * (x("r") + y("r")) <= allowed) if rare else near

        return condition

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs(a, b) whose whole shingle sets reach the threshold. Written."""
        slim = self.nodes.select("id", "n", *_SKETCH)
        side = lambda k: slim.select(*[F.col(c).alias(f"{k}_{c}") for c in slim.columns])
        near = self.possible(_SKETCH)(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
        near = written(pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), (F.col("b") == F.col("b_id")) & near).select("a", "b"), name="candidates")
        sets = self.whole_sets(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        found = (
            near.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))
        )
        linked = written(found.where(100 * F.col("common") >= self.percent * (F.col("n") - F.col("common"))).select("a", "b"), name="verified", release=True)
        drop(sets, near)
        return linked

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Hub pairs whose sizes and common prefix tokens leave room for the threshold. Others may still meet by further keys."""
        p = self.percent
        side = lambda k: self.nodes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), (F.col("n") - F.col("n_prefix")).alias(f"r{k}"))
        return (
            pairs.join(side("a"), "a")
            .join(side("b"), "b")
            .where(100 * F.least("na", "nb") >= p * F.greatest("na", "nb"))
            .where((100 + p) * (F.col("n_common") + F.greatest("ra", "rb")) >= p * (F.col("na") + F.col("nb")))
            .select("a", "b")
        )

    def crowded(self, held: DataFrame, frequent: DataFrame) -> DataFrame:
        """Ids whose prefix holds more frequent tokens than that of their smallest possible partner is extended by."""
        sizes = self.nodes.select("id", "n")
        n_held = held.join(frequent, "key", "left_semi").groupBy("id").agg(F.count("*").alias("n_held"))
        certain = f"least(2 + (n * {self.percent} div 100) * 3 div 100, (n * {self.percent} + 99) div 100 - 1)"  # a whole set of few tokens has no extension
        return n_held.join(sizes, "id").where(f"n_held > {certain}").select("id")

    def components(self) -> DataFrame:
        held = shared_postings(self.base.select(F.explode("prefix").alias("key"), F.col("node").alias("id")))
        links = self.verified(self.plausible(hub_pairs(with_hubs(held, held.groupBy("id").agg(F.count("*").alias("w"))))))
        components = written(connected_components(links), name="components")
        postings, held = held, written(labelled(held.select("key", "id"), components), name="labelled")
        drop(postings)
        keys = written(split_keys(held), name="keys")
        many = F.col("n_cross") > RARE * F.col("n")
        crowded = written(self.crowded(held, keys.where(many)), name="crowded")
        by_rare = held.join(keys.where(~many).select("key"), "key", "left_semi").join(self.nodes.select("id", "n", *_SKETCH), "id")
        pairs = [cross_pairs(by_rare, keys.where(~many), self.possible(_SKETCH))]
        if crowded.isEmpty():
            return connected_components(links.unionByName(self.verified(pairs[0])))
        indexed = self.indexed(crowded, components)
        few = written(indexed.select("id", "n", *_SKETCH, F.explode(F.expr("slice(rare, 1, m + 1)")).alias("key")), name="singles")
        few = labelled(few, components)
        pairs.append(cross_pairs(few, written(split_keys(few), name="keys"), self.possible(_SKETCH)))
        full = indexed.where("r <= m")
        hubs = full.select(F.explode("heavy").alias("key"), "id", "r")
        hubs = hubs.join(hubs.groupBy("key").agg(F.min(F.struct("r", "id")).alias("first")).select("key", F.col("first.id").alias("hub")), "key")
        pairs.append(hub_pairs(hubs).select("a", "b"))
        links = links.unionByName(self.verified(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()))
        components = written(connected_components(links), name="components")
        combined = full.select("id", "n", F.col("r").cast("long").alias("r"), "heavy").mapInArrow(_combinations(self.percent), "key long, id long, r long")
        combined = written(labelled(combined, components), name="combined", release=True)
        keys = written(split_keys(combined), name="keys")
        met = combined.join(keys.select("key"), "key", "left_semi").join(self.nodes.select("id", "n", *_SKETCH), "id")
        more = self.verified(cross_pairs(met, keys, self.possible(_SKETCH, rare=True)))
        drop(combined, indexed)
        return connected_components(links.unionByName(more))

    def indexed(self, crowded: DataFrame, components: DataFrame) -> DataFrame:
        """Crowded ids with their tokens, rare and frequent apart: (id, n, m, r, rare, heavy, sketch..). Written.

        Frequent is what is so among the crowded; m is how many tokens a document may hold that a partner lacks.
        """
        sets = self.whole_sets(crowded)
        tokens = written(labelled(sets.select(F.explode("shingles").alias("key"), "id"), components), name="tokens")
        heavy = split_keys(tokens).where(F.col("n_cross") > RARE * F.col("n")).select("key", F.lit(True).alias("frequent"))
        apart = tokens.select("key", "id").join(_small(written(heavy, name="heavy"), MOST_BROADCAST), "key", "left")
        apart = apart.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("frequent").isNull(), F.col("key")))).alias("rare"), F.collect_list(F.when(F.col("frequent"), F.col("key"))).alias("heavy"))
        m = F.expr(f"CAST(n - (n * {self.percent} + 99) div 100 AS INT)")
        found = written(apart.join(self.nodes.select("id", "n", *_SKETCH), "id").withColumn("m", m).withColumn("r", F.size("rare")), name="indexed", release=True)
        drop(tokens, sets)
        return found


def _small(keys: DataFrame, most: int) -> DataFrame:
    """``keys`` marked for broadcast if it has ``most`` rows or fewer; else joined by shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(row_key, doc_id, n_shingles, node) a row of ``docs``, and (node, component, component_id, n_copies) a set that has shingles."""
    with step() as keep:
        join = _Join(docs, width, percent)
        by_node = _named(join)
        keep(by_node)
        keep(join.base)
    return join.base.select("row_key", "doc_id", "n_shingles", "node"), by_node


def _named(join: _Join) -> DataFrame:
    components = join.components().select("id", F.col("component").alias("c"))
    named = join.nodes.select("id", "doc_id", "n_copies").join(components, "id", "left").select(F.col("id").alias("node"), "doc_id", "n_copies", F.coalesce("c", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return written(named.join(least, "component").select("node", "component", "component_id", "n_copies"), name="classes")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ..) -> (doc_id, n_shingles, component_id), one row per row of ``docs``.

    Words are runs of non-space bytes, A-Z folded; a document's set is its
    distinct ``width``-word shingles, or its whole sequence where it has fewer
    words. Documents link at Jaccard >= ``percent`` / 100. component_id is the
    smallest doc_id reachable by links. Null or wordless text: no shingles,
    linked with nothing. A null doc_id takes the component of its text's other
    copies, else null. Repeated rows repeat in the result. Other columns of
    ``docs`` are not read; an empty table gives none.
    """
    full, by_node = _classes(docs, width, percent)
    found = left_join(full, by_node.select("node", "component_id", "n_copies"), "node", "n_copies")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_copies(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, that of the smallest doc_id, null last, then of the smallest text hash.

    Rows without shingles stay. Rows that repeat doc_id and text are copies too:
    one stays. Rows of one doc_id whose texts are not alike are told apart. All
    columns stay as they are, whatever their names; an empty table gives none.
    """
    with step() as keep:
        full, by_node = _classes(docs.select("doc_id", "text"), width, percent)
        rows = left_join(full.where("n_shingles > 0"), by_node.select("node", "component", "n_copies"), "node", "n_copies")
        rows = written(rows.select("row_key", "doc_id", "component"), name="rows")
        place = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("row_key").alias("row_key"))
        groups = rows.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1")
        groups = written(groups.select("component", F.col("first.row_key").alias("stays"), "size"), name="groups")
        gone = written(left_join(rows, groups, "component", "size").where("row_key <> stays").select(F.col("row_key").alias("key")).distinct(), name="gone")
        repeated = rows.groupBy(F.col("row_key").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
        repeated = written(repeated.join(gone, "key", "left_anti"), name="repeated")
        keep(gone)
        keep(repeated)
    kept = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.struct("*").alias("row")).join(_small(gone, MOST_BROADCAST), "key", "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    again = _small(repeated, MOST_BROADCAST)
    once = kept.join(again, "key", "left_semi").dropDuplicates(["key"])
    return kept.join(again, "key", "left_anti").unionByName(once).select("row.*")
