"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Token labels come from labelled documents: in a toxic one, a token is tagged
where its word or a prefix of it is far more frequent in toxic documents than in
clean ones. A two-tag chain is fitted to sentences of such tokens. Over a whole
text, forward-backward gives each token's probability; the largest and the sum
of those above one half give the document's score by a logistic curve fitted to
held-back labelled documents, and runs of such tokens are the offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import textops
from braidwork.llm.scratch import written

#: Labelled documents of each class, about, that everything is fitted to: those of the lowest hashes.
SAMPLE = 3000

#: Sentences that the chain is fitted to, at most.
SENTENCES = 20_000

#: Log odds, and toxic documents of the sample, from which a word or prefix counts as a sign.
SIGN_ODDS, SIGN_DOCS = 2.5, 3

PREFIXES = (4, 5, 6)
_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, dtype=np.int64)
_STOP[[10, 33, 46, 63]] = 1
_U = np.uint64


@dataclass
class Tokens:
    """Of a batch: start and end bytes, feature hashes (tokens x 4), row starts and sentence starts (n + 1)."""

    starts: np.ndarray
    ends: np.ndarray
    features: np.ndarray
    at: np.ndarray
    sentences: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    raw, offsets = textops.buffers(column)
    words, starts, ends, at = textops.words(column, space=_BREAK)
    sums = textops.prefix_sums(textops._LOWER[raw])
    features = np.empty((len(words), 1 + len(PREFIXES)), dtype=_U)
    features[:, 0] = words
    for k, size in enumerate(PREFIXES):
        part = textops.span_hashes(sums, starts, np.minimum(starts + size, ends))
        features[:, k + 1] = np.where(ends - starts >= size, textops.mix(part + _U(size)), _U(0))
    stops = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_STOP[raw], out=stops[1:])
    fresh = np.zeros(len(words), dtype=bool)
    if len(words):
        fresh[1:] = stops[starts[1:]] > stops[starts[:-1]]
        fresh[at[:-1][at[:-1] < len(words)]] = True
    return Tokens(starts, ends, features, at, np.append(np.flatnonzero(fresh), len(words)))


@dataclass
class Chain:
    """Signs (sorted feature hashes) and their weights; weights of the tag itself, of signs beside a token, and of tag pairs."""

    signs: np.ndarray
    weights: np.ndarray
    bias: float = -2.0
    beside: float = 0.0
    pairs: np.ndarray | None = None
    curve: tuple[float, float, float] = (-3.0, 3.0, 1.0)

    def ids(self, features: np.ndarray) -> np.ndarray:
        """Positions among the signs, len(signs) where a feature is none."""
        if not len(self.signs):
            return np.zeros(features.shape, np.int64)
        where = np.minimum(np.searchsorted(self.signs, features), len(self.signs) - 1)
        return np.where(self.signs[where] == features, where, len(self.signs))

    def emissions(self, ids: np.ndarray, sentences: np.ndarray) -> np.ndarray:
        own = np.append(self.weights, 0.0)[ids].sum(axis=1)
        return self.bias + own + self.beside * near(ids, sentences, len(self.signs))


def near(ids: np.ndarray, sentences: np.ndarray, none: int) -> np.ndarray:
    """How many direct neighbours in the sentence carry a sign."""
    sign = (ids < none).any(axis=1).astype(float)
    out = np.zeros(len(sign))
    if len(sign):
        out[1:] += sign[:-1]
        firsts = sentences[:-1]
        out[firsts] -= np.where(firsts > 0, sign[firsts - 1], 0)
        out[:-1] += sign[1:]
        lasts = sentences[1:] - 1
        after = np.where(lasts + 1 < len(sign), sign[np.minimum(lasts + 1, len(sign) - 1)], 0)
        out[lasts] -= after
    return out


def marginals(emissions: np.ndarray, sentences: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Tag-one probability of each token, expected tag pairs (2 x 2), and the log partition sum.

    All sentences advance together, longest first, so a step costs one array
    operation however many sentences reach that far.
    """
    length = np.diff(sentences)
    order = np.argsort(-length, kind="stable")
    first, length = sentences[:-1][order], length[order]
    alpha = np.zeros((len(emissions), 2))
    beta = np.zeros((len(emissions), 2))
    score = np.stack([np.zeros(len(emissions)), emissions], axis=1)
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), side="left")  # sentences longer than t
    if longest:
        alpha[first] = score[first]
    for t in range(1, longest):
        here = first[: alive[t]] + t
        alpha[here] = np.logaddexp(alpha[here - 1, 0:1] + pairs[0], alpha[here - 1, 1:2] + pairs[1]) + score[here]
    for t in range(longest - 2, -1, -1):
        here = first[: alive[t + 1]] + t
        ahead = beta[here + 1] + score[here + 1]
        beta[here] = np.logaddexp(ahead[:, 0:1] + pairs[:, 0], ahead[:, 1:2] + pairs[:, 1])
    total = np.logaddexp(*(alpha + beta).T)
    p = np.exp(alpha[:, 1] + beta[:, 1] - total)
    linked = np.ones(len(emissions), dtype=bool)
    linked[sentences[:-1][sentences[:-1] < len(emissions)]] = False
    there = np.flatnonzero(linked)
    joint = alpha[there - 1][:, :, None] + pairs[None] + (score[there] + beta[there])[:, None, :] - total[there][:, None, None]
    return p, np.exp(joint).sum(axis=0), float(total[first].sum()) if longest else 0.0


def fit_chain(signs: np.ndarray, ids: np.ndarray, tags: np.ndarray, sentences: np.ndarray, *, steps: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Chain:
    """Maximum likelihood by gradient steps with per-weight scaling."""
    chain = Chain(signs, np.zeros(len(signs)), pairs=np.zeros((2, 2)))
    if not len(tags):
        return chain
    n, none = max(1, len(sentences) - 1), len(signs)
    beside = near(ids, sentences, none)
    linked = np.ones(len(tags), dtype=bool)
    linked[sentences[:-1]] = False
    there = np.flatnonzero(linked)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (tags[there - 1], tags[there]), 1)
    theta = np.concatenate([chain.weights, [chain.bias, 0.0], np.zeros(4)])
    scale = np.full(len(theta), 1e-8)
    for _ in range(steps):
        chain.weights, chain.bias, chain.beside, chain.pairs = theta[:none], theta[none], theta[none + 1], theta[none + 2 :].reshape(2, 2)
        p, pairs, _ = marginals(chain.emissions(ids, sentences), sentences, chain.pairs)
        off = tags - p
        own = np.zeros(none + 1)
        for k in range(ids.shape[1]):
            own += np.bincount(ids[:, k], weights=off, minlength=none + 1)
        gradient = np.concatenate([own[:none], [off.sum(), (off * beside).sum()], (seen_pairs - pairs).ravel()]) / n - decay * theta
        scale += gradient**2
        theta = theta + rate * gradient / np.sqrt(scale)
    chain.weights, chain.bias, chain.beside, chain.pairs = theta[:none].copy(), float(theta[none]), float(theta[none + 1]), theta[none + 2 :].reshape(2, 2)
    return chain


def tagged(chain: Chain, found: Tokens) -> np.ndarray:
    """Tag-one probability of each token. Sentences without a sign share the values of their length."""
    ids = chain.ids(found.features)
    sign = (ids < len(chain.signs)).any(axis=1)
    length = np.diff(found.sentences)
    sentence = np.repeat(np.arange(len(length)), length)
    busy = np.zeros(len(length), dtype=bool)
    busy[sentence[sign]] = True
    p = np.empty(len(sign))
    plain = np.unique(length[~busy])
    if len(plain):
        starts = np.concatenate([[0], np.cumsum(plain)])
        values, _, _ = marginals(np.full(int(plain.sum()), chain.bias), starts, chain.pairs)
        quiet = ~busy[sentence]
        offset = np.arange(len(p)) - found.sentences[:-1][sentence]
        p[quiet] = values[starts[np.searchsorted(plain, length[sentence[quiet]])] + offset[quiet]]
    if busy.any():
        inside = busy[sentence]
        bounds = np.concatenate([[0], np.cumsum(length[busy])])
        some = ids[inside]
        p[inside], _, _ = marginals(chain.emissions(some, bounds), bounds, chain.pairs)
    return p


def gathered(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the largest probability, and the sum of those of one half or more."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    most, total = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    np.maximum.at(most, row, p)
    np.add.at(total, row, np.where(p >= 0.5, p, 0))
    return most, total


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, part in textops.pieces(batch.column(1)):
            found = tokens(part)
            toxic = batch.column(0).slice(start, len(part)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(part)), np.diff(found.at))
            pairs = np.stack([np.tile(row.astype(_U), found.features.shape[1]), found.features.T.ravel()], axis=1)
            pairs = np.unique(pairs[pairs[:, 1] != 0], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].copy().view(np.int64)), pa.array(toxic[pairs[:, 0].astype(int)].astype(np.int64))], names=["sign", "toxic"])


def _sequences(signs: np.ndarray, known: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in textops.pieces(batch.column(1)):
                found = tokens(part)
                toxic = batch.column(0).slice(start, len(part)).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(part)), np.diff(found.at))
                ids = known.ids(found.features)
                tag = (ids < len(signs)).any(axis=1) & (toxic[row] == 1)
                length = np.diff(found.sentences)
                order = textops.mix(found.features[found.sentences[:-1], 0] + length.astype(_U)) if len(length) else np.zeros(0, _U)
                touched = np.zeros(len(length), dtype=np.int64)
                np.add.at(touched, np.repeat(np.arange(len(length)), length), (ids < len(signs)).any(axis=1).astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array((found.sentences * ids.shape[1]).astype(np.int32)), pa.array(ids.ravel().astype(np.int32)))
                tags = pa.ListArray.from_arrays(pa.array(found.sentences.astype(np.int32)), pa.array(tag.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array((order >> _U(1)).view(np.int64)), pa.array(touched > 0), lists, tags], names=["h", "touched", "ids", "tags"])

    return run


def _measured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in textops.pieces(batch.column(1)):
                found = tokens(part)
                most, total = gathered(tagged(shared.value, found), found.at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(most), pa.array(total)], names=["toxic", "most", "total"])

    return run


def sampled(labels: DataFrame, docs: DataFrame, sample: int) -> DataFrame:
    """(toxic, share, h, text): about ``sample`` labelled rows a class with their texts. Written.

    Rows are chosen by a hash of doc_id before the texts are read, so only the sample is joined; it is
    broadcast up to four times its expected size. share is what part of its class was chosen.
    """
    labels = labels.where("toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    share = labels.groupBy("toxic").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share"))
    chosen = labels.join(F.broadcast(share), "toxic").withColumn("h", F.xxhash64("doc_id"))  # a row a class
    chosen = written(chosen.where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000), name="chosen")
    small = F.broadcast(chosen) if chosen.count() <= 8 * sample else chosen
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return written(texts.join(small, "doc_id").select("toxic", "share", "h", "text"), name="sample")


def train(labels: DataFrame, docs: DataFrame | None = None, *, sample: int = SAMPLE) -> Chain | None:
    """A chain from labels(doc_id, toxic) and docs(doc_id, text), of about ``sample`` documents a class; None without both classes.

    Without ``docs``, ``labels`` has the texts. Labels without a document or a text count for nothing but the shares.
    """
    spark = labels.sparkSession
    chosen = sampled(labels, labels if docs is None else docs, sample)
    share = chosen.groupBy("toxic").agg(F.first("share").alias("share"))
    quarter = F.pmod(F.shiftright("h", 24), F.lit(4)) == 0
    fitted = chosen.where(~quarter).select("toxic", "text")
    sizes = {r.toxic: r.n for r in fitted.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    counts = fitted.mapInArrow(_signs, "sign long, toxic long").groupBy("sign").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (sizes[1] + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (sizes[0] + 1))
    signs = np.sort(counts.where((F.col("t") >= SIGN_DOCS) & (odds >= SIGN_ODDS)).select("sign").toArrow()["sign"].to_numpy().view(np.uint64))
    known = Chain(signs, np.zeros(len(signs)))
    sequences = fitted.mapInArrow(_sequences(signs, known), "h long, touched boolean, ids array<int>, tags array<int>").orderBy(F.desc("touched"), "h").limit(SENTENCES).toArrow()
    tags = np.array([x for r in sequences["tags"].to_pylist() for x in r], dtype=np.int64)
    ids = np.array([x for r in sequences["ids"].to_pylist() for x in r], dtype=np.int64).reshape(-1, 1 + len(PREFIXES))
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in sequences["tags"].to_pylist()])]).astype(np.int64)
    chain = fit_chain(signs, ids, tags, bounds)
    held = chosen.where(quarter).select("toxic", "text").mapInArrow(_measured(spark.sparkContext.broadcast(chain)), "toxic int, most double, total double").toArrow()
    chain.curve = _logistic(held["most"].to_numpy(), np.log1p(held["total"].to_numpy()), held["toxic"].to_numpy(), {r.toxic: r.share for r in share.collect()})
    return chain


def _logistic(most: np.ndarray, total: np.ndarray, toxic: np.ndarray, shares: dict[int, float]) -> tuple[float, float, float]:
    """The curve by held-back rows, each with the weight of the labelled rows it stands for: 1 / its class's share in the sample."""
    x = np.stack([np.ones(len(toxic)), most, total], axis=1)
    y, w = toxic.astype(float), np.array([1 / shares[t] for t in toxic.tolist()])
    theta = np.array([-3.0, 3.0, 1.0])
    if not len(y) or y.min() == y.max():
        return tuple(map(float, theta))

    def loss(theta: np.ndarray) -> float:
        return float(w @ (np.logaddexp(0, x @ theta) - y * (x @ theta)) + 0.025 * theta @ theta)

    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ theta))
        gradient = x.T @ (w * (y - p)) - 0.05 * theta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        step, before = np.linalg.solve(hessian, gradient), loss(theta)
        while loss(theta + step) > before and np.abs(step).max() > 1e-9:  # large weights: a whole step may go too far
            step = step / 2
        theta = theta + step
    return tuple(map(float, theta))


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """docs(doc_id, text, ..) -> doc_id, score, predicted, spans, one row per row of ``docs``.

    spans: start:end of each run of tokens at one half or more, in code points,
    comma-joined. Null, empty or wordless text has no spans and the score of a
    text without signs. Without a chain every score is 0.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if chain is None:
        return slim.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit("").alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for start, part in textops.pieces(batch.column(1)):
                found = tokens(part)
                p = tagged(chain, found)
                most, total = gathered(p, found.at)
                a, b, c = chain.curve
                result = 1 / (1 + np.exp(-(a + b * most + c * np.log1p(total))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)), pa.array(result), pa.array((result >= 0.5).astype(np.int32)), pa.array(_spans(part, found, p >= 0.5), pa.string())],
                    names=["doc_id", "score", "predicted", "spans"],
                )

    return slim.mapInArrow(run, "doc_id long, score double, predicted int, spans string")


def _spans(column: pa.Array, found: Tokens, marked: np.ndarray) -> list[str]:
    raw, offsets = textops.buffers(column)
    out: list[list[str]] = [[] for _ in range(len(column))]
    where = np.flatnonzero(marked)
    if len(where):
        points = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        row = np.searchsorted(found.at, where, side="right") - 1
        first = np.ones(len(where), dtype=bool)
        first[1:] = (np.diff(where) > 1) | (np.diff(row) > 0)
        last = np.append(first[1:], True)
        for r, i, j in zip(row[first], where[first], where[last], strict=True):
            base = points[offsets[r]]
            out[r].append(f"{points[found.starts[i]] - base}:{points[found.ends[j]] - base}")
    return [",".join(x) for x in out]
