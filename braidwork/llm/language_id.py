"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model per language, of order four over lower-case letters and single
blanks. All languages share the arrays: a sorted array of n-gram hashes for each
order, and beside it the full interpolated log probability in every language.
The predicted language is that of the lowest cross-entropy per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import textops

#: Documents of each language, about, that the models are fitted and calibrated on: those of the lowest hashes.
SAMPLE = 500

ORDER = 4
BLANK = 32
_OTHER = 0xFFFF  # any letter beyond the basic plane
_U = np.uint64

_LETTER = np.zeros(1 << 16, dtype=np.uint16) + BLANK
for _c in range(1 << 16):
    if not 0xD800 <= _c < 0xE000 and chr(_c).isalpha():
        _LETTER[_c] = _c


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single blanks of each row in lower case, and row starts (n + 1); rows lose leading blanks."""
    raw, at = textops.buffers(pc.utf8_lower(column.cast(pa.large_string())))
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    leads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=leads[1:])
    at = leads[at]
    wide = points >= 1 << 16
    letters = _LETTER[np.where(wide, BLANK, points)]
    if wide.any():
        letters[wide] = [_OTHER if chr(p).isalpha() else BLANK for p in points[wide]]
    keep = letters != BLANK
    keep[1:] |= keep[:-1] & (letters[1:] == BLANK)
    starts = at[:-1][at[:-1] < len(letters)]
    keep[starts] = letters[starts] != BLANK
    held = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=held[1:])
    return letters[keep], held[at]


def grams(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each character, it and the three before it, packed in 64 bits; blanks stand before a row."""
    out = letters.astype(_U)
    offset = np.arange(len(letters)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, ORDER):
        before = np.full(len(letters), BLANK, dtype=_U)
        before[k:] = letters[:-k]
        before[offset < k] = BLANK
        out |= before << _U(16 * k)
    return out


def _low(packed: np.ndarray, order: int) -> np.ndarray:
    return packed if order == ORDER else packed & _U((1 << 16 * order) - 1)


@dataclass
class Model:
    """languages; for each order n: hashes and log probabilities (n-grams x languages), context hashes and log back-off weights."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    log_back: list[np.ndarray] = field(default_factory=list)
    floor: float = 0.0
    limits: np.ndarray | None = None
    sharpness: float = 8.0

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """(characters x languages); n-grams unseen everywhere back off to shorter ones."""
        out = np.zeros((len(packed), len(self.languages)), dtype=np.float32)
        left = np.arange(len(packed))
        for order in range(ORDER, 0, -1):
            here = _low(packed[left], order)
            where, found = _find(self.keys[order - 1], textops.mix(here + _U(order)))
            out[left[found]] += self.log_p[order - 1][where[found]]
            left, here = left[~found], here[~found]
            if not len(left):
                return out
            where, found = _find(self.contexts[order - 1], textops.mix((here >> _U(16)) + _U(order)))
            out[left[found]] += self.log_back[order - 1][where[found]]
        out[left] += self.floor
        return out

    def cross_entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each row in each language, and the characters of each row."""
        letters, at = characters(column)
        sums = np.zeros((len(letters) + 1, len(self.languages)))
        np.cumsum(self.log_probabilities(grams(letters, at)), axis=0, out=sums[1:])
        n = np.diff(at)
        return -(sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)[:, None], n


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return where, keys[where] == wanted


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from (packed 4-grams, counts) of each language."""
    model = Model(sorted(counts))
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for language in model.languages:
        packed, n = counts[language]
        order = np.argsort(packed)
        packed, n = packed[order], n[order].astype(float)
        by_order[ORDER].append((packed, n))
        for k in range(ORDER - 1, 0, -1):  # below the highest order, counts are of distinct characters before
            packed, n = np.unique(_low(packed, k), return_counts=True)
            by_order[k].append((packed, n.astype(float)))
    alphabet = max(2, len(np.unique(np.concatenate([x[0] for x in by_order[1]]))) + 1)
    model.floor = float(-np.log(alphabet))
    lower_keys, lower_p = np.zeros(1, _U), np.full((1, len(model.languages)), 1 / alphabet)
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([x[0] for x in by_order[k]]))
        contexts = np.unique(union >> _U(16))
        p, back = np.zeros((len(union), len(model.languages))), np.ones((len(contexts), len(model.languages)))
        context_of = np.searchsorted(contexts, union >> _U(16))
        below = lower_p[np.searchsorted(lower_keys, _low(union, k - 1) if k > 1 else np.zeros(len(union), _U))]
        for i, (packed, n) in enumerate(by_order[k]):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            at = np.searchsorted(union, packed)
            total, types = np.zeros(len(contexts)), np.zeros(len(contexts))
            np.add.at(total, context_of[at], n)
            np.add.at(types, context_of[at], 1)
            seen = total > 0
            back[seen, i] = discount * types[seen] / total[seen]
            p[at, i] = np.maximum(n - discount, 0) / total[context_of[at]]
            p[:, i] += back[context_of, i] * below[:, i]
        for into, keys, values in ((0, union, p), (1, contexts, back)):
            hashes = textops.mix(keys + _U(k))
            order = np.argsort(hashes)
            ((model.keys, model.log_p), (model.contexts, model.log_back))[into][0].append(hashes[order])
            ((model.keys, model.log_p), (model.contexts, model.log_back))[into][1].append(np.log(values[order]).astype(np.float32))
        lower_keys, lower_p = union, p
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, part in textops.pieces(batch.column(1)):
            letters, at = characters(part)
            packed = grams(letters, at)
            names, codes = np.unique(np.asarray(batch.column(0).slice(start, len(part)).to_pylist(), dtype=object).astype(str), return_inverse=True)
            code = np.repeat(codes, np.diff(at))
            for i, name in enumerate(names):
                gram, n = np.unique(packed[code == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _entropies(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in textops.pieces(batch.column(1)):
                ce, n = model.value.cross_entropies(part)
                width = len(model.value.languages)
                flat = pa.array(ce.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), lists, pa.array(n)], names=["lang", "ce", "n"])

    return run


def train(labelled: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """Models from labelled(doc_id, text, lang), of about ``sample`` documents a language; None without any.

    Four fifths of the sample give the n-gram counts, the rest the rejection
    limit of each language and the sharpness of the scores.
    """
    spark = labelled.sparkSession
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h"))
    share = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share"))
    chosen = labelled.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000)  # a row a language
    fifth = F.pmod(F.shiftright("h", 24), F.lit(5)) == 0
    rows = chosen.where(~fifth).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = rows.toArrow()
    if not table.num_rows:
        return None
    names, packed, n = np.array(table["lang"].to_pylist()), table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    model = fit({str(x): (packed[names == x], n[names == x]) for x in np.unique(names)})
    found = chosen.where(fifth).select("lang", "text").mapInArrow(_entropies(spark.sparkContext.broadcast(model)), "lang string, ce array<double>, n long").where("n > 0").toArrow()
    ce = np.array(found["ce"].to_pylist()).reshape(-1, len(model.languages))
    truth = np.array([model.languages.index(x) if x in model.languages else -1 for x in found["lang"].to_pylist()], dtype=int)
    model.limits = np.full(len(model.languages), np.inf)
    for i in range(len(model.languages)):
        own = ce[truth == i, i]
        if len(own) >= 10:
            model.limits[i] = np.quantile(own, 0.99) + 3 * own.std()
    known = truth >= 0
    if known.any():
        losses = [-np.log(np.maximum(_softmax(ce[known] * -s)[np.arange(known.sum()), truth[known]], 1e-12)).mean() for s in (1, 2, 4, 8, 16, 32)]
        model.sharpness = (1, 2, 4, 8, 16, 32)[int(np.argmin(losses))]
    return model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text, ..) -> doc_id, lang_pred, score, cross_entropy, rejected, one row per row of ``docs``.

    ``und``, score 0 and null cross_entropy where text is null or has no letter,
    or without a model. rejected: the cross-entropy is above what the language's
    own documents show; the prediction stands beside it.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return slim.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            for start, part in textops.pieces(batch.column(1)):
                ce, n = model.cross_entropies(part)
                best = ce.argmin(axis=1)
                rows = np.arange(len(n))
                score = np.where(n > 0, _softmax(ce * -model.sharpness)[rows, best], 0.0)
                lowest = ce[rows, best]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(part)),
                        pa.array(names[np.where(n > 0, best, len(model.languages))], pa.string()),
                        pa.array(score),
                        pa.array(lowest, mask=n == 0),
                        pa.array((n > 0) & (lowest > model.limits[best])),
                    ],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
