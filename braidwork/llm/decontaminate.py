"""Benchmark decontamination by template windows.

Numbers, units after a number, and capitalised words inside a sentence become
typed placeholders; all other words are lower-cased. Points and commas between
digits belong to the number. Windows of templates are hashed and looked up among
the benchmark's; a run of windows that match one after another is found at its first
window alone, so a phrase that an item and a document repeat costs the sum of
their lengths, not the product. Runs that agree on one shift of document against
item are put together, then those of neighbouring shifts, which inserted and deleted
words make; it is a leak where enough of the item is covered, each word of the document counting once. A placeholder value of
the item should stand for one value of the document throughout; windows with a
changed word that breaks this do not count, but runs of equal words alone may do.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import textops

#: Words of a window; shorter items are one window.
WINDOW = 8

#: A leak covers this share of the item, or this many of its words in a row.
SHARE, RUN = 0.6, 25

#: Benchmark characters that one pass over the documents looks up; a larger benchmark takes several passes.
BLOCK_CHARS = 20_000_000

#: Units that become a placeholder after a number. Fixed values.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l s ms sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres mile miles gram grams liter liters litre litres inch inches foot feet dollar dollars euro euros cent cents percent degrees mph kmh kb mb gb tb".split()

_U = np.uint64
_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, dtype=np.int64)
_STOP[[10, 33, 46, 63]] = 1
#: What points and commas between digits are read as: bytes that UTF-8 does not have and that are no break.
_INNER = {46: 0xFE, 44: 0xFF}
_NUMBER, _UNIT, _NAME = _U(11), _U(12), _U(13)
_UNIT_HASHES = np.sort(textops.words(pa.array([" ".join(UNITS)]))[0])


@dataclass
class Templates:
    """Template word hashes, the words' own hashes, and row starts (n + 1). A word whose two hashes differ fills a slot."""

    template: np.ndarray
    own: np.ndarray
    at: np.ndarray


def _whole_numbers(column: pa.Array) -> pa.Array:
    """The column with points and commas between two digits of a row replaced by bytes that break no word."""
    raw, at = textops.buffers(column)
    digit = (raw >= 48) & (raw <= 57)
    inner = np.zeros(len(raw), dtype=bool)
    inner[1:-1] = ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
    edges = at[at < len(raw)]
    inner[edges] = False  # a row's first byte, and the last of the one before
    inner[edges[edges > 0] - 1] = False
    if not inner.any():
        return column
    raw = raw.copy()
    for byte, read in _INNER.items():
        raw[inner & (raw == byte)] = read
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(raw))


def templates(column: pa.Array) -> Templates:
    column = _whole_numbers(column)
    raw, _ = textops.buffers(column)
    own, starts, ends, at = textops.words(column, space=_BREAK)
    out = own.copy()
    if not len(own):
        return Templates(out, own, at)
    first = raw[starts]
    number = (first >= 48) & (first <= 57)
    after = np.zeros(len(own), dtype=bool)
    after[1:] = number[:-1]
    after[at[:-1][at[:-1] < len(own)]] = False
    place = np.minimum(np.searchsorted(_UNIT_HASHES, own), len(_UNIT_HASHES) - 1)
    unit = after & (_UNIT_HASHES[place] == own)
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    stops = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_STOP[raw], out=stops[1:])
    inside = np.zeros(len(own), dtype=bool)
    inside[1:] = stops[starts[1:]] == stops[ends[:-1]]
    inside[at[:-1][at[:-1] < len(own)]] = False
    out[capital & inside] = _NAME
    out[number] = _NUMBER
    out[unit] = _UNIT
    return Templates(out, own, at)


def _windows(found: Templates, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every full window of ``width`` words inside a row, and where they start."""
    n = len(found.template)
    if n < width:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    last = np.repeat(found.at[1:], np.diff(found.at))
    start = np.flatnonzero(np.arange(n) + width <= last)
    h = np.full(len(start), 0x2545F4914F6CDD1D ^ width, dtype=_U)
    for k in range(width):
        h = textops.mix(h * _U(0x9E3779B97F4A7C15) + found.template[start + k])
    return h, start


def _sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums by which runs of hashes compare wherever they stand, with ``_run_hashes``."""
    out = np.zeros(len(hashes) + 1, _U)
    np.cumsum(textops.mix(hashes) * textops.powers(len(hashes)), out=out[1:])
    return out


def _run_hashes(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (sums[start + n] - sums[start]) * inverse[start]


def _common(sums: tuple[np.ndarray, np.ndarray], inverse: tuple[np.ndarray, np.ndarray], starts: tuple[np.ndarray, np.ndarray], most: np.ndarray) -> np.ndarray:
    """How far two sequences agree from these places on, up to ``most``: bits of the length from the highest down."""
    n = np.zeros(len(most), np.int64)
    for bit in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
        more = np.minimum(n + (1 << bit), most)
        tried = more - n == 1 << bit
        same = np.zeros(len(n), bool)
        at = np.flatnonzero(tried)
        same[at] = _run_hashes(sums[0], inverse[0], starts[0][at], more[at]) == _run_hashes(sums[1], inverse[1], starts[1][at], more[at])
        n = np.where(same, more, n)
    return n


class _Windows:
    """The windows of one width in a block of items, by hash and the hash of the window before."""

    def __init__(self, width: int, hashes: np.ndarray, start: np.ndarray, item: np.ndarray, fits: np.ndarray, n_words: int):
        self.width, self.sums = width, None
        if width == WINDOW:  # items of fewer words are one window
            at_place = textops.mix(np.arange(n_words, dtype=_U) ^ _U(0xD6E8FEB86659FD93))  # a window that is not looked up matches nothing
            at_place[start[fits]] = hashes[fits]
            self.sums = _sums(at_place)
        self.start, self.item, key = start[fits], item[fits], hashes[fits]
        first = np.ones(len(self.start), bool)
        first[1:] = (self.start[1:] != self.start[:-1] + 1) | (self.item[1:] != self.item[:-1])
        prior = np.zeros(len(key), _U)  # 0: there is none
        prior[1:][~first[1:]] = key[:-1][~first[1:]]
        self.keys, key_no = np.unique(key, return_inverse=True)
        self.priors, prior_no = np.unique(prior, return_inverse=True)
        pair = (key_no.astype(np.int64) << 32) | prior_no
        order = np.argsort(pair, kind="stable")
        self.pairs, self.start, self.item = pair[order], self.start[order], self.item[order]

    def runs(self, found: Templates, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place in the documents, place in the items, item, windows) of each longest run of matching windows."""
        h, start = _windows(found, self.width)
        prior = np.ones(len(h), _U)  # 1: there is none
        inside = np.zeros(len(h), bool)
        inside[1:] = start[1:] == start[:-1] + 1
        prior[1:][inside[1:]] = h[:-1][inside[1:]]
        key_no = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        hit = np.flatnonzero(self.keys[key_no] == h) if len(self.keys) else np.zeros(0, np.int64)
        key_no, prior, place = key_no[hit].astype(np.int64), prior[hit], start[hit]
        prior_no = np.minimum(np.searchsorted(self.priors, prior), len(self.priors) - 1)
        pair = (key_no << 32) | np.where(self.priors[prior_no] == prior, prior_no, (1 << 32) - 1)
        low, high = np.searchsorted(self.pairs, key_no << 32), np.searchsorted(self.pairs, (key_no + 1) << 32)
        skip, on = np.searchsorted(self.pairs, pair), np.searchsorted(self.pairs, pair, side="right")  # these go on from the window before
        n = np.concatenate([skip - low, high - on])
        begin, place = np.concatenate([low, on]), np.concatenate([place, place])
        own = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        place = np.repeat(place, n)
        mine, item = self.start[own], self.item[own]
        if self.sums is None:
            return place, mine, item, np.ones(len(place), np.int64)
        last = np.repeat(found.at[1:], np.diff(found.at))
        most = np.minimum(last[place] - place, ends[item] - mine) - self.width + 1
        hashes = np.zeros(len(found.template), _U)
        hashes[start] = h
        length = _common((_sums(hashes), self.sums), (textops.powers(len(hashes) + 1, inverse=True), textops.powers(len(self.sums), inverse=True)), (place, mine), most)
        return place, mine, item, length


class Index:
    """The windows of a block of benchmark items."""

    def __init__(self, item_ids: list, column: pa.Array):
        self.items, self.found = item_ids, templates(column)
        n = np.diff(self.found.at)
        self.windows, self.bare = [], defaultdict(list)
        for width in sorted({int(min(WINDOW, x)) for x in n if x}):
            h, start = _windows(self.found, width)
            item = np.searchsorted(self.found.at, start, side="right") - 1
            fits = np.minimum(WINDOW, n[item]) == width
            worded = np.concatenate([[0], np.cumsum(self.found.template == self.found.own)])
            anchored = worded[start + width] > worded[start]
            some = np.zeros(len(n), dtype=bool)
            some[item[anchored]] = True
            fits &= anchored | ~some[item]  # windows of placeholders alone are looked up only for items that have no others
            self.windows.append(_Windows(width, h, start, item, fits, len(self.found.own)))
            for i, s in zip(item[some[item] & ~anchored].tolist(), start[some[item] & ~anchored].tolist(), strict=True):
                if min(WINDOW, int(n[i])) == width:
                    self.bare[i].append(s)

    def leaks(self, column: pa.Array) -> list[tuple[int, int, str, int, float]]:
        """(row, item, kind, words covered, share of the item covered) of each leak, the best of a row and item."""
        found = templates(column)
        hits = [(*w.runs(found, self.found.at[1:]), w.width) for w in self.windows]
        place, mine, item, words = (np.concatenate([np.zeros(0, np.int64), *[x[k] + (x[4] - 1 if k == 3 else 0) for x in hits]]) for k in range(4))
        if not len(place):
            return []
        row, shift = np.searchsorted(found.at, place, side="right") - 1, place - mine
        order = np.lexsort((mine, shift, item, row))
        shift, mine, item, row, words = shift[order], mine[order], item[order], row[order], words[order]
        fresh = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(row) != 0)))
        out = []
        for a, b in zip(fresh.tolist(), [*fresh[1:].tolist(), len(row)], strict=True):
            r, i = int(row[a]), int(item[a])
            length = int(self.found.at[i + 1] - self.found.at[i])
            if i not in self.bare and int(words[a:b].sum()) < min(RUN, SHARE * length):
                continue
            by_shift = defaultdict(list)
            for by, s, n in zip(shift[a:b].tolist(), mine[a:b].tolist(), words[a:b].tolist(), strict=True):
                by_shift[by].append((s, n))
            for by, runs in by_shift.items() if i in self.bare else ():  # windows of placeholders alone count beside others of the same shift
                width = min(WINDOW, length)
                for x in self.bare[i]:
                    if found.at[r] <= x + by and x + by + width <= found.at[r + 1] and (found.template[x + by : x + by + width] == self.found.template[x : x + width]).all():
                        runs.append((x, width))
            if best := self._best(found, i, by_shift):
                out.append((r, i, *best))
        return out

    def _best(self, found: Templates, item: int, by_shift: dict[int, list]) -> tuple[str, int, float] | None:
        """The way to lay an item on a document that covers most words: each shift alone, and runs of shifts that lie no further apart than the item is long."""
        length = int(self.found.at[item + 1] - self.found.at[item])
        size = {shift: min(sum(n for _, n in runs), length) for shift, runs in by_shift.items()}
        best = None
        for shift in sorted(by_shift, key=lambda x: (-size[x], x)):
            if size[shift] < min(RUN, SHARE * length) or best and best[1] >= size[shift]:
                break
            judged = self._judged(found, item, {shift: by_shift[shift]})
            best = judged if judged and (not best or judged[1] > best[1]) else best
        if best and best[1] == length:
            return best
        groups, before = [], None
        for shift in sorted(by_shift):
            if before is None or shift - before > length:
                groups.append({})
            groups[-1][shift], before = by_shift[shift], shift
        for group in groups:
            if len(group) > 1 and (judged := self._judged(found, item, group)) and (not best or judged[1] > best[1]):
                best = judged
        return best

    def _judged(self, found: Templates, item: int, group: dict[int, list]) -> tuple[str, int, float] | None:
        """(kind, words covered, share) of the runs of some shifts together, or None where they are no leak.

        Shifts of most words come first; of what they cover, a later shift takes only
        words of the item that are not covered by words of the document that are not used.
        """
        base, stop = int(self.found.at[item]), int(self.found.at[item + 1])
        low = min(s + by for by, runs in group.items() for s, _ in runs)
        high = max(s + n + by for by, runs in group.items() for s, n in runs)
        steps = np.zeros((2, max(stop - base, high - low) + 1), np.int64)
        for by, runs in group.items():
            for s, n in runs:
                steps[0, s - base] += 1
                steps[0, s + n - base] -= 1
                steps[1, s + by - low] += 1
                steps[1, s + n + by - low] -= 1
        left = np.count_nonzero(np.cumsum(steps, axis=1) > 0, axis=1).min()  # no more words can be laid on each other
        covered, used, places = np.zeros(stop - base, dtype=bool), np.zeros(high - low, dtype=bool), np.zeros(stop - base, dtype=np.int64)
        for shift in sorted(group, key=lambda x: (-sum(n for _, n in group[x]), x)):
            for s, n in group[shift]:
                fresh = np.flatnonzero(~covered[s - base : s - base + n] & ~used[s + shift - low : s + shift - low + n]) + s
                covered[fresh - base], used[fresh + shift - low], places[fresh - base] = True, True, fresh + shift
            if int(covered.sum()) >= left:
                break
        if not _enough(covered):
            return None
        mine, theirs = self.found.own[base:stop], found.own[places]
        slots = np.flatnonzero(covered & (self.found.template[base:stop] != mine))
        meant = defaultdict(set)
        for k in slots:
            meant[mine[k]].add(theirs[k])
        bad = np.zeros(stop - base, dtype=bool)  # changed words of a value that stands for two of the document
        bad[[k for k in slots if len(meant[mine[k]]) > 1 and mine[k] != theirs[k]]] = True
        if bad.any():
            equal, laid, width = covered & (mine == theirs), covered, min(WINDOW, stop - base)
            covered = np.zeros(stop - base, dtype=bool)
            for runs in group.values():
                for s, n in runs:
                    cuts = np.concatenate([[-1], np.flatnonzero(bad[s - base : s - base + n]), [n]])
                    for a, b in zip((cuts[:-1] + 1).tolist(), cuts[1:].tolist(), strict=True):
                        covered[s - base + a : s - base + b] |= b - a >= width
            covered &= laid
            if not _enough(covered):  # equal words alone, in runs of half a window
                covered = np.zeros(stop - base, dtype=bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    covered[a:b] = b - a >= WINDOW // 2
            if not _enough(covered):
                return None
        kind = "exact" if (mine == theirs)[covered].all() else "template"
        return kind, int(covered.sum()), float(covered.mean())


def _enough(covered: np.ndarray) -> bool:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return bool(len(edges)) and (float(covered.mean()) >= SHARE or int((edges[1::2] - edges[::2]).max()) >= RUN)


def _blocks(benchmark: DataFrame, item: str) -> Iterator[Index]:
    """The benchmark in blocks of about BLOCK_CHARS characters; one is on the driver at a time."""
    items = benchmark.where("text IS NOT NULL").select(F.col(item).alias("item"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_CHARS))
    for k in range(n):
        table = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toArrow().combine_chunks()
        yield Index(table["item"].to_pylist(), table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string()))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text, ..), benchmark(item_id, text, ..) -> doc_id, item_id, kind, n_words, share of each leak.

    kind is ``exact`` where the covered words are equal, else ``template``. Null
    or empty texts leak nothing, an empty table gives none. Repeated documents
    and items give a row each. Of ways to lay an item on a document, the one that
    covers most words counts, of equal ones the first. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _blocks(benchmark, "item_id"):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for start, part in textops.pieces(batch.column(1)):
                    found = index.leaks(part)
                    rows = pa.array([start + f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), pa.array([index.items[f[1]] for f in found], pa.int64()), *[pa.array([f[k] for f in found], t) for k, t in ((2, pa.string()), (3, pa.int64()), (4, pa.float64()))]],
                        names=["doc_id", "item_id", "kind", "n_words", "share"],
                    )

        part = slim.mapInArrow(run, "doc_id long, item_id long, kind string, n_words long, share double")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, that leak no benchmark item. Rows without text stay; repeated rows stay or go together."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for index in _blocks(benchmark, "item_id"):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, part in textops.pieces(batch.column(at)):
                    keep = np.ones(len(part), dtype=bool)
                    keep[[f[0] for f in shared.value.leaks(part)]] = False
                    yield batch.slice(start, len(part)).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
