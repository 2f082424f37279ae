"""Token-id files compressed by Re-Pair, readable from any document on.

``write`` deals documents by ranges of doc_id, encodes them, and cuts each range
into shards of whole documents. A shard is one binary value: a header, the pair
that each nonterminal stands for, the number of ids it expands to, and for each document
its ids and symbols. No pair crosses the end of a document, so a document is read by
expanding its own symbols. Shards are kept in Parquet, a row each, as executors
write to shared storage through Spark alone.

Format (little-endian): ``RPG1``; documents, rules, symbols and terminals as four
uint32; then doc_id int64, 1 where doc_id is null uint8, ids uint64 and symbols
uint64 a document; left uint32, right uint32 and expansion length uint64 a rule; the
symbols as uint32. Symbol ``terminals + i`` is rule i; rules name earlier ones only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import textops

#: Ids a shard holds at least, but for the last of a range.
SHARD_IDS = 1 << 20

#: A pair becomes a rule if it stands so often in a shard; the first pass asks for a share of the shard, later ones for an eighth of the pass before.
LEAST_TIMES, FIRST_SHARE, STEP = 12, 1 / 512, 8

#: A pass at the least number that replaces a smaller share of the symbols is the last.
LEAST_GAIN = 0.02

#: Pieces kept with their ids between batches, and between tasks of a worker; beyond it the table begins anew.
KEPT_PIECES = 1_500_000

#: Bytes of text encoded at once, and pieces that the library takes at once.
TEXT_BYTES, SIDE_BY_SIDE = 1 << 21, 20_000

_MAGIC = b"RPG1"
_U = np.uint64
_OTHER, _LETTER, _DIGIT, _SPACE, _MARK = range(5)


def _classes() -> np.ndarray:
    """Of ASCII: letters, digits, the four usual kinds of white space, other visible characters. All else is ``_OTHER``."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[33:127] = _MARK
    kind[48:58] = _DIGIT
    kind[65:91] = kind[97:123] = _LETTER
    kind[[9, 10, 13, 32]] = _SPACE
    return kind


_KIND = _classes()


def _plain(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and for each text whether its classes tell where the tokenizer cuts it.

    Such a text has ASCII characters and Latin-1 letters only, and no ``<|``, with which special tokens begin.
    """
    kind = _KIND[raw]
    if not len(raw):
        return kind, np.ones(len(at) - 1, bool)
    lead = raw == 0xC3
    follow = np.zeros(len(raw), bool)
    follow[1:] = lead[:-1]
    letter = follow & (raw >= 0x80) & (raw != 0x97) & (raw != 0xB7)  # not the signs of multiplication and division
    kind[letter] = _LETTER
    kind[:-1][letter[1:]] = _LETTER
    odd = kind == _OTHER
    odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    return kind, np.diff(np.append(0, np.cumsum(odd))[at]) == 0


def _cuts(raw: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces begin that a byte-level tokenizer encodes by themselves, in texts that are ``_plain``.

    A piece is a run of one class; a blank before a letter, digit or mark goes to the
    piece it precedes; other white space before them stands alone; after a lone
    apostrophe, an English ending is cut off with it.
    """
    n = len(raw)
    begins = np.ones(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins |= edge
    space = kind == _SPACE
    met = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) + 1  # the first byte after white space
    begins[met - 1] = True
    begins[met[raw[met - 1] == 32]] = False
    lone = np.flatnonzero((raw[:-1] == ord("'")) & begins[: n - 1] & begins[1:n] & ~edge[1:n] & (kind[1:] == _LETTER)) if n > 1 else np.zeros(0, np.int64)
    one, two = raw[lone + 1], np.where(edge[np.minimum(lone + 2, n)], 0, raw[np.minimum(lone + 2, n - 1)])
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    begins[lone[short | long] + 1] = False
    begins[lone[short] + 2] = True
    begins[lone[long & ~short] + 3] = True
    return np.flatnonzero(begins[:n])


class Encoder:
    """Ids of many texts at once: distinct pieces are encoded by the library, texts are put together from them.

    Texts that are not ``_plain`` are encoded whole. A piece is known by 64 bits.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self._known, self._from, self._n, self._ids = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @property
    def terminals(self) -> int:
        return self._tokenizer.get_vocab_size(with_added_tokens=True)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' ids one after another, how many each has, and the order in which the pieces stand there.

        Pieces that begin with one blank are encoded side by side, a thousand at a time; none of them can run into the next.
        """
        joins = np.array([len(p) > 1 and p[0] == 32 and p[1] not in b" \t\n\r" for p in pieces], bool)
        alone, many = np.flatnonzero(~joins), np.flatnonzero(joins)
        single = self._encode([pieces[i].decode() for i in alone])
        ids, n = single, [np.array([len(x) for x in single], np.int64)]
        for at in range(0, len(many), SIDE_BY_SIDE):
            groups = [b"".join(pieces[i] for i in many[k : k + 1000]).decode() for k in range(at, min(at + SIDE_BY_SIDE, len(many)), 1000)]
            for e in self._tokenizer.encode_batch(groups, add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                n.append(np.bincount(np.array(e.word_ids, np.int64)))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate(n), np.append(alone, many)

    def _learn(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = raw.tobytes()
        ids, n, which = self._encode_pieces([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        begin = len(self._ids) + np.cumsum(n) - n
        order = np.argsort(hashes[which])
        hashes = hashes[which][order]
        place = np.searchsorted(self._known, hashes)
        self._known, self._from, self._n = (np.insert(old, place, new) for old, new in ((self._known, hashes), (self._from, begin[order]), (self._n, n[order])))
        self._ids = np.append(self._ids, ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a string column, null being empty, and how many each has."""
        raw, at = textops.buffers(column)
        kind, plain = _plain(raw, at)
        whole = dict(zip(np.flatnonzero(~plain).tolist(), self._encode([column[int(i)].as_py() for i in np.flatnonzero(~plain)]), strict=True))
        starts = _cuts(raw, kind, at) if len(raw) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(raw)).astype(np.int64)
        row = np.searchsorted(at, starts, side="right") - 1
        used = plain[row]
        starts, ends, row = starts[used], ends[used], row[used]
        distinct, first, which = np.unique(textops.span_hashes(textops.prefix_sums(raw), starts, ends), return_index=True, return_inverse=True)
        if len(self._known) > KEPT_PIECES:
            self._forget()
        place = np.searchsorted(self._known, distinct)
        fresh = np.ones(len(distinct), bool)
        if len(self._known):
            fresh = self._known[np.minimum(place, len(self._known) - 1)] != distinct
        if fresh.any():
            self._learn(distinct[fresh], raw, starts[first[fresh]], ends[first[fresh]])
            place = np.searchsorted(self._known, distinct)
        n, begin = self._n[place][which], self._from[place][which]
        ids = self._ids[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        counts = np.bincount(row, weights=n, minlength=len(column)).astype(np.int64)
        if not whole:
            return ids, counts
        upto = np.cumsum(counts)
        parts, done = [], 0
        for i, own in whole.items():
            parts += [ids[done : upto[i]], own]
            done, counts[i] = int(upto[i]), len(own)
        return np.concatenate([*parts, ids[done:]]), counts


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The encoder of a tokenizer's file; a worker that runs several tasks keeps it, and what it has learnt."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Shard:
    """One compressed shard; arrays as in the format."""

    doc_id: np.ndarray
    no_id: np.ndarray
    n_ids: np.ndarray
    n_symbols: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    symbols: np.ndarray
    terminals: int

    def to_bytes(self) -> bytes:
        head = np.array([len(self.doc_id), len(self.left), len(self.symbols), self.terminals], "<u4")
        kinds = ("<i8", "u1", "<u8", "<u8", "<u4", "<u4", "<u8", "<u4")
        arrays = (self.doc_id, self.no_id, self.n_ids, self.n_symbols, self.left, self.right, self.length, self.symbols)
        return b"".join([_MAGIC, head.tobytes(), *(a.astype(k).tobytes() for a, k in zip(arrays, kinds, strict=True))])

    @staticmethod
    def from_bytes(data: bytes) -> Shard:
        if data[:4] != _MAGIC:
            raise ValueError("not a token-id shard")
        docs, rules, symbols, terminals = (int(x) for x in np.frombuffer(data, "<u4", 4, 4))
        at, arrays = 20, []
        for n, kind in ((docs, "<i8"), (docs, "u1"), (docs, "<u8"), (docs, "<u8"), (rules, "<u4"), (rules, "<u4"), (rules, "<u8"), (symbols, "<u4")):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        if at != len(data):
            raise ValueError("a token-id shard of another length than its header says")
        return Shard(*arrays, terminals)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that these symbols stand for."""
        out = symbols.astype(np.uint32)
        while (rule := out >= self.terminals).any():
            place = np.arange(len(out)) + np.cumsum(rule) - rule
            wider = np.empty(len(out) + int(rule.sum()), np.uint32)
            wider[place] = np.where(rule, 0, out)
            named = out[rule] - self.terminals
            wider[place[rule]], wider[place[rule] + 1] = self.left[named], self.right[named]
            out = wider
        return out

    def ids(self, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of one document; of its symbols only those are expanded whose lengths place them there."""
        first = int(self.n_symbols[:document].sum())
        own = self.symbols[first : first + int(self.n_symbols[document])]
        named = own >= self.terminals
        n = np.ones(len(own), np.int64)
        n[named] = self.length[own[named] - self.terminals]
        ends = np.cumsum(n)
        stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        skipped = start - (int(ends[a - 1]) if a else 0)
        return self.expand(own[a:b])[skipped : skipped + max(stop - start, 0)]


def _replaced(symbols: np.ndarray, last: np.ndarray, times: int, following: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass: pairs that stand ``times`` times or more become symbols from ``following`` on, the more frequent first where they overlap.

    Returns the new symbols, where documents end, and the codes of the pairs (left in the upper half). ``last`` marks the last symbol of each document.
    """
    none = np.zeros(0, _U)
    if len(symbols) < 2:
        return symbols, last, none
    code = (symbols[:-1].astype(_U) << _U(32)) | symbols[1:]
    slot = ((code * _U(0x9E3779B97F4A7C15)) >> _U(45)).astype(np.int64)
    maybe = np.flatnonzero((np.bincount(slot[~last[:-1]], minlength=1 << 19)[slot] >= times) & ~last[:-1])
    distinct, which, n = np.unique(code[maybe], return_inverse=True, return_counts=True)
    rank = np.zeros(len(distinct), np.int64)
    rank[np.lexsort((distinct, n))] = np.arange(1, len(distinct) + 1)
    rank[n < times] = 0
    order = np.zeros(len(code) + 2, np.int64)  # by the pair that begins at a place, with a border on each side
    order[maybe + 1] = rank[which]
    inner = order[1:-1]
    same = np.flatnonzero((inner[1:] > 0) & (inner[1:] == inner[:-1])) + 1  # a pair after itself: aaa
    if len(same):
        run = np.cumsum(np.append(True, same[1:] != same[:-1] + 1)) - 1
        at = same - same[np.flatnonzero(np.append(True, same[1:] != same[:-1] + 1))][run]
        inner[same[at % 2 == 0]] = 0
    taken = np.flatnonzero((inner > order[:-2]) & (inner > order[2:]))
    pairs, named, n = np.unique(code[taken], return_inverse=True, return_counts=True)
    keep = n >= 2
    taken, named = taken[keep[named]], (np.cumsum(keep) - 1)[named[keep[named]]]
    if not len(taken):
        return symbols, last, none
    out = symbols.copy()
    out[taken] = following + named
    stays = np.ones(len(symbols), bool)
    stays[taken + 1] = False
    ends = last.copy()
    ends[taken] |= last[taken + 1]
    return out[stays], ends[stays], pairs[keep]


def compressed(ids: np.ndarray, n_ids: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray, terminals: int) -> Shard:
    """Re-Pair over whole documents: passes replace the frequent pairs by nonterminals, from the most frequent down to ``LEAST_TIMES``."""
    symbols, last = ids.astype(np.uint32), np.zeros(len(ids), bool)
    last[np.cumsum(n_ids)[n_ids > 0] - 1] = True
    times, rules, n_rules = max(LEAST_TIMES, int(len(ids) * FIRST_SHARE)), [np.zeros(0, _U)], 0
    while True:
        before = len(symbols)
        symbols, last, pairs = _replaced(symbols, last, times, terminals + n_rules)
        rules.append(pairs)
        n_rules += len(pairs)
        if times == LEAST_TIMES and before - len(symbols) <= LEAST_GAIN * before:
            break
        times = max(LEAST_TIMES, times // STEP)
    length, done = np.ones(n_rules, np.int64), 0
    code = np.concatenate(rules)
    left, right = (code >> _U(32)).astype(np.uint32), (code & _U(0xFFFFFFFF)).astype(np.uint32)
    wide = lambda part: np.where(part >= terminals, length[np.maximum(part.astype(np.int64) - terminals, 0)], 1) if n_rules else part
    for pairs in rules:
        own = slice(done, done + len(pairs))
        length[own] = wide(left[own]) + wide(right[own])
        done += len(pairs)
    upto = np.append(0, np.cumsum(last))
    n_symbols = np.diff(np.append(0, np.searchsorted(upto, np.arange(1, int(upto[-1]) + 1))))
    each = np.zeros(len(n_ids), np.int64)
    each[n_ids > 0] = n_symbols
    return Shard(doc_id, no_id, n_ids, each, left, right, length, symbols, terminals)


def _shards(tokenizer: str, end_id: int, shard_ids: int):
    """Rows (doc_id, text) in order -> (part, shard, before, n_docs, n_ids, payload); before: the ids of the part's earlier shards."""

    def row(encoder: Encoder, shard: int, before: int, held: list) -> pa.RecordBatch:
        doc_id, no_id, n, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        payload = compressed(ids, n, doc_id, no_id, encoder.terminals).to_bytes()
        values = [[TaskContext.get().partitionId()], [shard], [before], [len(n)], [len(ids)], [payload]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "shard", "before", "n_docs", "n_ids", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, size, shard, before = _encoder(tokenizer), [], 0, 0, 0
        for batch in batches:
            for start, texts in textops.pieces(batch.column(1), TEXT_BYTES):
                doc_id = batch.column(0).slice(start, len(texts))
                ids, n = encoder.encode(texts)
                ids = np.insert(ids, np.cumsum(n), end_id)
                held.append((doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False), n + 1, ids))
                size += len(ids)
                if size >= shard_ids:
                    yield row(encoder, shard, before, held)
                    held, size, shard, before = [], 0, shard + 1, before + size
        if held:
            yield row(encoder, shard, before, held)

    return run


def write(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Write docs(doc_id, text) as shards of ids under ``path``, in ascending order of doc_id, each document followed by ``end_id``.

    ``tokenizer`` is the path of a file of the tokenizers library. Null doc_ids come
    first; rows of one doc_id are ordered by a hash of their text, so that a repeated id
    is dealt to several tasks. Null and empty texts are ``end_id`` alone. Without documents there is no shard.
    """
    tie = F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"hash": F.xxhash64("text"), "tie": tie})
    keys = (F.asc_nulls_first("doc_id"), "hash", "tie")
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    dealt.mapInArrow(_shards(tokenizer, end_id, shard_ids), "part int, shard int, before long, n_docs long, n_ids long, payload binary").write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, pa.Array]]:
    """Of each shard its ids and where its documents end, with their doc_id, start and number of ids."""
    for batch in batches:
        for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = Shard.from_bytes(payload.as_py())
            ids = shard.expand(shard.symbols).astype("<u4")
            n = shard.n_ids.astype(np.int64)
            ends = np.cumsum(n)
            if len(ids) != int(ends[-1]):
                raise ValueError("a shard expands to another number of ids than it says")
            yield ids, ends, pa.array(shard.doc_id, mask=shard.no_id.astype(bool)), pa.array(start + ends - n), pa.array(n)


def _read_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, ends, *columns in _read(batches):
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int64)), pa.py_buffer(ids)])
        yield pa.RecordBatch.from_arrays([*columns, data.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, ends, *columns in _read(batches):
        data = memoryview(ids).cast("B")
        at = [0, *(ends * 4).tolist()]
        digests = [zlib.crc32(data[a:b]) for a, b in pairwise(at)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _shards_of(spark: SparkSession, path: str) -> DataFrame:
    """(start, payload): each shard, and the ids of all documents before it."""
    shards = spark.read.schema("part int, shard int, before long, n_docs long, n_ids long, payload binary").parquet(path)
    begins, done = [], 0
    for part, n in sorted(shards.groupBy("part").agg(F.sum("n_ids")).collect()):  # a row a partition
        begins.append((part, done))
        done += n
    begun = F.broadcast(spark.createDataFrame(begins, "part int, begin long"))
    return shards.join(begun, "part").select((F.col("begin") + F.col("before")).alias("start"), "payload")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Of shards under ``path``: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers) of every document."""
    return _shards_of(spark, path).mapInArrow(_read_ids, "doc_id long, start long, n_tokens long, ids binary")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with ids_crc32, the unsigned CRC-32 of the bytes of ids, in their place."""
    return _shards_of(spark, path).mapInArrow(_read_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
