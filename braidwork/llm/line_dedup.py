"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

A line is compared in lower case without outer blanks. Its set is its distinct
``SHINGLE``-character substrings; two lines count as one from ``PERCENT`` percent
of Jaccard similarity. Signatures are taken over wider shingles where a line is
long: lines of one language share many short shingles and few wide ones, so few
pairs that are not alike share a band. A line of many shingles is signed by few
hashes dealt into bins, one of few shingles by a hash a value. Lines that share a
band are verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import textops
from braidwork.llm.linking import connected_components, cross_pairs, hub_pairs, labelled, least_difference, left_join, shared_postings, split_keys, with_hubs
from braidwork.llm.scratch import drop, step, written

#: Characters of a shingle; lines with fewer are their own set. One changed character leaves lines of 39 or more above PERCENT.
SHINGLE = 4

#: Percent of Jaccard similarity from which two lines count as one.
PERCENT = 80

#: Characters of the shingles by which a long line is signed.
WIDE = 8

#: Bands of a signature; rows of a band for short lines, and for long ones, whose wide shingles agree less.
BANDS, ROWS, WIDE_ROWS = 20, 6, 4

#: Bits of a band's key: what they leave out may add candidates, which are verified, and loses none; 3 of some 19 bytes of a posting are saved.
KEY_BITS = 40

#: Characters from which a line is signed as a long one, and up to which as a short one.
LONG, SHORT = 48, 64

#: Long lines by number of wide shingles: from how many on, and into how many bins, a power of two, a hash is dealt.
LEVELS = ((0, 8), (128, 32))

#: Repeated lines of fewer characters stay in the documents, list marks and the like; in the line table they are as all others.
KEPT_CHARS = 3

#: Lines up to which their ids are broadcast to the scan of the texts (8 bytes each).
MOST_BROADCAST = 2_000_000

#: Ids of lines that a task remembers, so as to sign each once.
REMEMBERED = 1_000_000

_WORDS = 16
_SKETCH = [f"s{i}" for i in range(_WORDS)]
_BITS = 1024
_NONE = np.iinfo(np.uint64).max

_U = np.uint64
_SEEDS = textops.mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_HALVES = (slice(0, BANDS // 2), slice(BANDS // 2, BANDS))


def _code_points(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)


_POINT_KEYS = textops.mix(np.arange(1, (1 << 16) + 1, dtype=_U))


def _hash_points(points: np.ndarray) -> np.ndarray:
    """Prefix sums over characters, for span_hashes."""
    out = np.zeros(len(points) + 1, dtype=_U)
    keyed = _POINT_KEYS[np.minimum(points, 0xFFFF)]
    wide = np.flatnonzero(points >= 0xFFFF)
    keyed[wide] = textops.mix(points[wide].astype(_U) + _U(1))
    keyed *= textops._powers(textops._MULTIPLIER, len(points))
    np.cumsum(keyed, out=out[1:])
    return out


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums over all lower-case characters, and of each line: row, number in the row, start and end without outer blanks."""
    raw, at = textops.buffers(pc.utf8_lower(column.cast(pa.large_string())))
    points = _code_points(raw)
    leads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=leads[1:])
    at = leads[at]
    breaks = np.flatnonzero(points == 10)
    starts = np.concatenate([at[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, side="right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.append(starts[1:], len(points))
    same = np.append(row[1:] == row[:-1], False)
    ends = np.where(same, ends - 1, at[row + 1])
    number = np.arange(len(starts)) - np.searchsorted(row, row)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    solid = np.flatnonzero(~blank)
    if len(solid):
        first = np.searchsorted(solid, starts)
        last = np.searchsorted(solid, ends) - 1
        some = last >= first
        starts = np.where(some, solid[np.minimum(first, len(solid) - 1)], starts)
        ends = np.where(some, solid[np.maximum(last, 0)] + 1, starts)
    else:
        ends = starts
    return _hash_points(points), row, number, starts, ends


def _shingles(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each line (repeats included), and where each line's begin."""
    length = ends - starts
    n = np.where(length > width, length - width + 1, (length > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    every = sums[width:] - sums[:-width]  # each place at once, then those inside a line
    every *= textops._powers(textops._INVERSE, len(every))
    step = np.ones(int(at[-1]), dtype=np.int64)
    some = np.flatnonzero(n)
    step[at[some]] = starts[some] - np.concatenate([[0], starts[some[:-1]] + n[some[:-1]] - 1])
    begin = np.cumsum(step)
    values = every[np.minimum(begin, max(len(every) - 1, 0))] if len(every) else np.zeros(len(begin), _U)
    short = np.flatnonzero((length > 0) & (length < width))
    values[at[short]] = (sums[ends[short]] - sums[starts[short]]) * textops._powers(textops._INVERSE, len(sums))[starts[short]] + length[short].astype(_U)
    return textops.mix(values), at


def _distinct(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """About how many distinct shingles each line has, counted by the bits they fall on."""
    n, filled = np.diff(at), []
    for start in range(0, len(n), 1 << 14):
        some = n[start : start + (1 << 14)]
        bits = np.zeros(len(some) * _BITS, np.uint8)
        own = values[at[start] : at[start + len(some)]] & _U(_BITS - 1)
        bits[np.repeat(np.arange(len(some)) * _BITS, some) + own.view(np.int64)] = 1
        filled.append(bits.reshape(-1, _BITS).sum(axis=1, dtype=np.int64))
    return -_BITS * np.log1p(-np.minimum(np.concatenate(filled), _BITS - 1) / _BITS)


def _signed(values: np.ndarray, at: np.ndarray, rows: int, bins: int, tag: int) -> np.ndarray:
    """(lines, BANDS) keys: as many hashes as it takes, each dealt into ``bins`` smallest values."""
    n, k = np.diff(at), BANDS * rows
    signs = []
    if bins > 1:
        base, shift = np.repeat(np.arange(len(n), dtype=np.int64) * bins, n), _U(65 - int(bins).bit_length())
    for seed in _SEEDS[: -(-k // bins)]:
        hashed = values * seed
        if bins == 1:
            signs.append(np.minimum.reduceat(hashed, at[:-1])[:, None])
            continue
        least = np.full(len(n) * bins, _NONE, dtype=_U)
        np.minimum.at(least, base + (hashed >> shift).view(np.int64), hashed)
        least = least.reshape(-1, bins)
        empty = least == _NONE
        for step in range(1, bins):  # an empty bin takes the next filled one's value, marked by the distance
            if not empty.any():
                break
            ahead = np.roll(least, -step, axis=1)
            filled = empty & ~np.roll(empty, -step, axis=1)
            least[filled] = textops.mix(ahead[filled] + _U(step))
            empty &= ~filled
        signs.append(least)
    signs = np.concatenate(signs, axis=1)[:, :k]
    keys = np.zeros((len(n), BANDS), dtype=_U)
    for r in range(rows):
        keys = textops.mix(keys * _U(31) + signs[:, r::rows])
    return textops.mix(keys + (np.arange(BANDS, dtype=_U) + _U(BANDS * tag))) >> _U(64 - KEY_BITS)


def _picked(values: np.ndarray, at: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some lines alone, and where each one's begin."""
    n = np.diff(at)[lines]
    out = np.zeros(len(lines) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return values[np.repeat(at[:-1][lines] - out[:-1], n) + np.arange(out[-1])], out


def _signatures(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lines, keys) for each way of signing; a line near a border is signed in both ways."""
    length = ends - starts
    found = []
    wide = np.flatnonzero(length >= LONG)
    short = length < SHORT
    if len(wide):
        values, at = _shingles(sums, starts[wide], ends[wide], WIDE)
        about = _distinct(values, at)
        short[wide[about < SHORT]] = True  # long, but of few shingles over and over
        for k, (least, bins) in enumerate(LEVELS):
            most = LEVELS[k + 1][0] if k + 1 < len(LEVELS) else np.inf
            chosen = np.flatnonzero((about >= 0.78 * least) & (about < most / 0.78))
            if len(chosen):
                found.append((wide[chosen], _signed(*_picked(values, at, chosen), WIDE_ROWS, bins, k + 1)))
    short = np.flatnonzero(short)
    if len(short):
        found.append((short, _signed(*_shingles(sums, starts[short], ends[short]), ROWS, 1, 0)))
    return found


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0, np.int64)
    for batch in batches:
        for start, part in textops.pieces(batch.column(2)):
            sums, row, number, starts, ends = lines_of(part)
            some = ends > starts
            row, number, starts, ends = row[some], number[some], starts[some], ends[some]
            ids = textops.span_hashes(sums, starts, ends).view(np.int64)
            fresh, first = np.unique(ids, return_index=True)
            new = ~np.isin(fresh, seen, assume_unique=True)
            fresh, first = fresh[new], first[new]
            seen = np.sort(np.concatenate([seen, fresh])) if len(seen) < REMEMBERED else fresh
            signed = _signatures(sums, starts[first], ends[first])
            lines = first[np.concatenate([x for x, _ in signed])] if signed else np.zeros(0, np.int64)
            keys = np.concatenate([x for _, x in signed]) if signed else np.zeros((0, BANDS), _U)
            order = np.argsort(lines, kind="stable")
            cut = np.searchsorted(lines[order], np.arange(len(ids) + 1)) * (BANDS // 2)
            taken = pa.array(row + start)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(number), pa.array(ids), *[textops.list_column(keys[order, half].ravel(), cut) for half in _HALVES]],
                names=["row_key", "doc_id", "line_no", "id", "bands0", "bands1"],
            )


def _texts(wanted):
    """A scan for whole lines: (id, line, n, sketch..); only those of the broadcast ids, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = wanted.value if wanted is not None else None
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for _, part in textops.pieces(batch.column(0)):
                sums, _, _, starts, ends = lines_of(part)
                some = ends > starts
                starts, ends = starts[some], ends[some]
                ids, first = np.unique(textops.span_hashes(sums, starts, ends).view(np.int64), return_index=True)
                new = ~np.isin(ids, seen, assume_unique=True)
                if chosen is not None:
                    new &= np.isin(ids, chosen, assume_unique=True)
                ids, first = ids[new], first[new]
                seen = np.sort(np.concatenate([seen, ids])) if len(seen) < REMEMBERED else ids
                text = textops.buffers(pc.utf8_lower(part.cast(pa.large_string())))[0].tobytes().decode("utf-8") if len(ids) else ""
                keys = _row_keys(*_shingles(sums, starts[first], ends[first]))
                shift = _row_shift(len(ids))
                at = np.searchsorted(keys >> shift, np.arange(len(ids) + 1, dtype=_U)).astype(np.int64)
                sketch = textops.sketches(textops.mix(keys & ((_U(1) << shift) - _U(1))), at, _WORDS).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([text[a:b] for a, b in zip(starts[first], ends[first], strict=True)], pa.string()), pa.array(np.diff(at)), *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(_WORDS)]],
                    names=["id", "line", "n", *_SKETCH],
                )

    return run


def _row_shift(n: int) -> np.uint64:
    """Bits that are left of a 64-bit key beside the number of one of n rows."""
    return _U(64 - max(1, int(n).bit_length()))


def _row_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorted distinct keys of row number and shingle hash: a piece of a megabyte leaves 47 bits of the hash or more, one line 63."""
    shift = _row_shift(len(at) - 1)
    row = np.repeat(np.arange(len(at) - 1, dtype=_U), np.diff(at))
    keys = np.sort((row << shift) | (values >> (_U(64) - shift)))
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, part in textops.pieces(batch.column(2)):
            sides = []
            for column in (part, batch.column(3).slice(start, len(part))):
                raw, at = textops.buffers(column)
                leads = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=leads[1:])
                at = leads[at]
                sides.append(_row_keys(*_shingles(_hash_points(_code_points(raw)), at[:-1], at[1:])))
            x, y = sides
            both = np.sort(np.concatenate([x, y]))
            shift = _row_shift(len(part))
            common = np.bincount((both[1:][both[1:] == both[:-1]] >> shift).astype(np.int64), minlength=len(part))
            union = np.bincount((both >> shift).astype(np.int64), minlength=len(part)) - common
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(part)), batch.column(1).slice(start, len(part)), pa.array(100 * common >= PERCENT * union)], names=["a", "b", "linked"]
            )


def _whole_lines(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(id) -> (id, line, n, sketch..) from the texts. Written.

    Of the documents that hold a line, one is read again.
    """
    texts, known = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("string").alias("text")), None
    if wanted.count() <= MOST_BROADCAST:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.select("id").toArrow()["id"].to_numpy()))
        holders = lines.join(F.broadcast(wanted), "id", "left_semi").groupBy("id").agg(F.min("row_key").alias("row_key")).select("row_key").distinct()
        texts = texts.join(F.broadcast(written(holders, name="holders")), "row_key", "left_semi")  # no more than there are ids
    found = texts.select("text").mapInArrow(_texts(known), "id long, line string, n long, " + ", ".join(f"{s} long" for s in _SKETCH))
    if known is None:
        found = found.join(wanted, "id", "left_semi")
    return written(found.dropDuplicates(["id"]), name="texts", release=True)


def _possible(x, y):
    """Whether the sizes and sketches of two lines leave room for the threshold."""
    p = PERCENT
    near = (100 * x("n") >= p * y("n")) & (100 * y("n") >= p * x("n"))
    return near & ((100 + p) * least_difference(x, y, _SKETCH) <= (100 - p) * (x("n") + y("n")))


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs(a, b) that reach the threshold on their lines' whole sets. Written."""
    full = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b").join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a")
    found = full.select("a", "b", "la", "lb").mapInArrow(_verify, "a long, b long, linked boolean")
    return written(found.where("linked").select("a", "b"), name="verified", release=True)


def _components(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, component) of the lines that any other is like."""
    held = [shared_postings(lines.where(f"size({bands}) > 0").select(F.explode(bands).alias("key"), "id")) for bands in ("bands0", "bands1")]
    both = held[0].unionByName(held[1])
    wanted = written(both.select("id").distinct(), name="wanted")
    often = lines.select("id").join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, "id", "left_semi").groupBy("id").agg(F.count("*").alias("w"))
    texts = _whole_lines(docs, lines, wanted)
    links = _verified(texts, hub_pairs(with_hubs(both, often)))
    components = written(connected_components(links), name="components")
    postings, held = held, written(labelled(both.select("key", "id"), components), name="labelled")
    drop(*postings)
    keys = written(split_keys(held), name="keys")
    open_ = held.join(keys.select("key"), "key", "left_semi").join(texts.select("id", "n", *_SKETCH), "id")
    return connected_components(links.unionByName(_verified(texts, cross_pairs(open_, keys, _possible, once=True))))


def line_table(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ..) -> row_key, doc_id, line_no, rep_doc_id, rep_line_no, kept, a row a line that is not blank.

    Lines are ``\\n``-split, numbered from 0. rep_* name the first line, by
    doc_id (null last) and number, of the component of fuzzy equality; that line
    alone is kept. row_key is a hash of doc_id and text: repeated rows are one
    document, and keep or lose the same lines. Null and empty texts have no
    lines, an empty table gives none. Other columns of ``docs`` are not read.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with step() as keep:
        lines = written(keyed.where("text IS NOT NULL").mapInArrow(_sign, "row_key long, doc_id long, line_no long, id long, bands0 array<long>, bands1 array<long>"), name="lines")
        by_id = _firsts(docs, lines)
        keep(lines)
        keep(by_id)
    found = left_join(lines.select("row_key", "doc_id", "line_no", "id"), by_id, "id", "n")
    kept = F.col("first").isNull() | ((F.col("first.k") == F.col("row_key")) & (F.col("first.l") == F.col("line_no")))
    return found.select(
        "row_key", "doc_id", "line_no",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.d")).alias("rep_doc_id"),
        F.coalesce("first.l", "line_no").alias("rep_line_no"), kept.alias("kept"),
    )


def _firsts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, n, first) of the lines of each component of two lines or more: the place of its first one. Written."""
    components = _components(docs, lines)
    lines = lines.select("row_key", "doc_id", "line_no", "id")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.col("row_key").alias("k"))
    ids = lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    ids = written(ids, name="ids", release=True)
    groups = ids.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("total")).where("total > 1").select("component", "first")
    return written(ids.select("id", "component", "n").join(groups, "component").select("id", "n", "first"), name="firsts")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that ``line_table`` drops, but for those under KEPT_CHARS; a document that loses all its text goes.

    Columns and their names stay as they are, but for the values of n_chars,
    which follow the text where it is a column. Documents without text stay.
    """
    with step() as keep:
        dropped = written(line_table(docs).where("NOT kept").groupBy("row_key").agg(F.collect_set("line_no").alias("dropped")), name="dropped")
        keep(dropped)
    row, text, gone = F.col("row"), F.col("row.text").cast("string"), F.col("dropped")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.struct("*").alias("row")).join(dropped, F.col("key") == F.col("row_key"), "left")
    brief = lambda x: F.length(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")) < KEPT_CHARS
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i.cast("long")) | brief(x)), "\n")
    cut = keyed.withColumn("cut", F.when(gone.isNull(), text).otherwise(left)).where(gone.isNull() | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    shown = row.withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        shown = shown.withField("n_chars", F.when(gone.isNull(), F.col("row.n_chars")).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType))
    return cut.select(shown.alias("row")).select("row.*")
