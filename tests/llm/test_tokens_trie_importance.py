import functools
import hashlib
import operator
import random
import zlib
from math import floor, log

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from braidwork.llm import importance, prefix_trie, token_files
from braidwork.llm.ordered import ordered

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["'s", "'", "''s", "don't", " 'll", "\n'll", "\n\n", "  ", " ", "\t", "é", "Élan", "x", "12", "3 4", "!?", "<|endoftext|>", "<", "|", "漢字", "a'b", "'re", "'ree", "'rée", "÷", "×", "'S", "\r\n", "'d ", "'ve's", "ß", "\x0b", "\xa0"]


def test_pieces_are_cut_as_the_tokenizer_cuts_them():
    r = random.Random(3)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(4000)] + ["", None, "'", "'s"]
    expected = [x.ids for x in Tokenizer.from_file(TOKENIZER).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ids, n = token_files.Encoder(TOKENIZER).encode(pa.array(texts))
    assert n.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [y for x in expected for y in x]


def test_shards_expand_to_what_was_compressed():
    r = np.random.default_rng(5)
    for alphabet, size in ((1, 400), (2, 3000), (40, 20_000), (50_000, 500)):
        n = r.integers(0, 60, size // 30)
        ids = r.integers(0, alphabet, int(n.sum())).astype(np.uint32)
        if alphabet == 40:
            ids = np.tile(ids[:1000], len(ids) // 1000 + 1)[: len(ids)]
        shard = token_files.Shard.from_bytes(token_files.compressed(ids, n, np.arange(len(n)), np.zeros(len(n), bool), 50_257).to_bytes())
        assert np.array_equal(shard.expand(shard.symbols), ids)
        assert alphabet > 2 or len(shard.symbols) < len(ids)
        ends = np.cumsum(n)
        for d in range(len(n)):
            own = ids[ends[d] - n[d] : ends[d]]
            assert np.array_equal(shard.ids(d), own)
            a, b = sorted(r.integers(0, n[d] + 1, 2).tolist())
            assert np.array_equal(shard.ids(d, a, b), own[a:b])
    with pytest.raises(ValueError, match="length"):
        token_files.Shard.from_bytes(shard.to_bytes() + b"x")


def test_token_files_round_trip(spark, tmp_path):
    r = random.Random(1)
    texts = [" ".join(r.choice(["so", "the", "tale", "goes", "é", "x1"]) for _ in range(r.randint(0, 300))) for _ in range(120)] + [None, "", "<|endoftext|>", "word " * 60_000]
    rows = [(i * 3 % 124, t, "k") for i, t in enumerate(texts)] + [(None, "no id", "k"), (7, "twice", "k"), (7, "again", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    path = str(tmp_path / "shards")
    token_files.write(docs, path, tokenizer=TOKENIZER, end_id=2, shard_ids=2000)
    found = token_files.read(spark, path).collect()
    assert len(found) == len(rows)
    t = Tokenizer.from_file(TOKENIZER)
    encoded = sorted(((i is not None, i or 0), tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x, _ in rows)
    assert sorted(((f.doc_id is not None, f.doc_id or 0), tuple(np.frombuffer(f.ids, "<u4").tolist())) for f in found) == encoded
    digests = {(d.doc_id, d.start, d.n_tokens, d.ids_crc32) for d in token_files.read_digests(spark, path).collect()}
    assert digests == {(f.doc_id, f.start, f.n_tokens, zlib.crc32(bytes(f.ids))) for f in found}
    at = 0
    for f in sorted(found, key=lambda f: f.start):
        assert f.start == at and f.n_tokens == len(f.ids) // 4
        at += f.n_tokens
    order = [(f.doc_id is not None, f.doc_id or 0) for f in sorted(found, key=lambda f: f.start)]
    assert order == sorted(order)
    empty = str(tmp_path / "none")
    token_files.write(docs.limit(0), empty, tokenizer=TOKENIZER, end_id=2)
    assert token_files.read(spark, empty).count() == 0


def test_ordered_counts_across_partitions(spark):
    r = random.Random(2)
    rows = [(r.choice([0, 1, 1, 1, 1, 2]), i, r.randint(0, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "s long, i long, v long").repartition(5)
    found = {(f.s, f.i): f for f in ordered(df, "s", "i", segment="s", sums=("v",), xors=("v",)).collect()}
    place, total, bits = {}, {}, {}
    for rank, (s, i, v) in enumerate(sorted(rows)):
        total[s], bits[s] = total.get(s, 0) + v, bits.get(s, 0) ^ v
        f = found[s, i]
        assert (f["rank"], f.place, f.sum_v, f.xor_v) == (rank, place.get(s, 0), total[s], bits[s])
        place[s] = place.get(s, 0) + 1


@pytest.mark.parametrize("batch", [1, 4])
def test_totals_of_segments_that_begin_with_a_batch(spark, batch):
    rows = [(i // 4, i, i + 1) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {f.i: f for f in ordered(spark.createDataFrame(rows, "s long, i long, v long"), "s", "i", segment="s", sums=("v",), xors=("v",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s, i, _ in rows:
        values = [v for t, j, v in rows if t == s and j <= i]
        assert (found[i].place, found[i].sum_v, found[i].xor_v) == (len(values) - 1, sum(values), functools.reduce(operator.xor, values))


def plain_trie(paths: dict[int, list]) -> set:
    """Nodes of {conv_id: [(role, text)]} by plain dictionaries."""
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children = {n: [m for m in members if m and m[:-1] == n] for n in members}

    def below(n):
        return [n, *[x for m in children[n] for x in below(m)]]

    own = {n: (len(m) - 1) * len(n[-1][1].encode()) if n else 0 for n, m in members.items()}
    return {
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), sum(not children[x] for x in below(n)), sum(own[x] for x in below(n)), hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in members.items()
    }


@pytest.mark.parametrize("block", [2, 3, 64])
def test_trie_against_plain_dictionaries(spark, block):
    r = random.Random(block)
    turn = [("user", "a"), ("bot", "bé"), ("user", ""), ("", "b")]
    paths = {c: [r.choice(turn) for _ in range(r.choice([0, 1, 2, 5, 9]))] for c in range(60)}
    paths |= {c: [turn[0]] * 30 for c in range(60, 75)} | {80: [turn[0]] * 30 + [turn[1]], 81: [turn[0]] * 17 + [turn[3]] * 14}
    rows = [(c, k, role or None, text or None, 1) for c, p in paths.items() for k, (role, text) in enumerate(p)]
    turns = prefix_trie.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int").repartition(5))
    found_rows, convs = prefix_trie.whole(turns)
    convs = convs.unionByName(spark.createDataFrame([(c, 0) for c, p in paths.items() if not p], "conv_id long, length long"))
    found = prefix_trie.trie(found_rows, convs, block=block)
    assert {tuple(x) for x in found.drop("first_node", "last_node").collect()} == plain_trie(paths)
    spans = {(x.first_node, x.last_node) for x in found.collect()}
    assert {a for a, _ in spans} == set(range(len(spans)))
    assert all(b < c or d <= b for a, b in spans for c, d in spans if a < c)


def test_spliced_conversations(spark):
    r = random.Random(4)
    paths = {c: [("u", r.choice("xyz") * (k + 1)) for k in range(r.choice([1, 3, 12]))] for c in range(0, 40) if c % 10 != 5}
    rows = [(c, k if k else None, role, text) for c, p in paths.items() for k, (role, text) in enumerate(p)] + [(None, 1, "u", "lost")]
    turns = prefix_trie.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    expected = {}
    for c, p in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        expected[c] = paths.get(c - c % 5, [])[:h] + p[h:]
    found = prefix_trie.trie(*prefix_trie.spliced(turns, group=5, most=9)).drop("first_node", "last_node")
    assert {tuple(x) for x in found.collect()} == plain_trie(expected)
    tied = prefix_trie.turn_rows(spark.createDataFrame([(1, 1, None, "no role"), (1, 1, "", "empty"), (1, 1, "u", "é"), (1, None, "z", None)], "conv_id long, turn long, role string, text string"))
    assert [x.n_bytes for x in tied.orderBy("place").collect()] == [0, 5, 2, 7]
    none = prefix_trie.turn_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert prefix_trie.trie(*prefix_trie.spliced(none, group=5, most=9)).count() == 0


def plain_runs(text: str | None, most: int) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in lowered).split(" ")
    words = [w for w in words if w]
    return [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize(("most", "common"), [(1, 0), (1, 3), (2, 50)])
def test_importance_against_plain_counts(spark, most, common, monkeypatch):
    monkeypatch.setattr(importance, "COMMON_TIMES", 2)
    r = random.Random(most)
    say = ["The", "the", "tale", "of", "É", "über", "x1", "a b", "<tag>", "--", "q　"]
    texts = [" ".join(r.choice(say) for _ in range(r.randint(0, 60))) for _ in range(90)] + [None, "", "?!", "long " * 30_000]
    docs = [(i, t, i) for i, t in enumerate(texts)] + [(None, "the tale " * 15, 0), (3, texts[3], 3)]
    target = [("the über tale of x1 " * 5,), (None,)]
    s, t = {}, {}
    for counts, rows in ((s, [d[1] for d in docs]), (t, [x for x, in target])):
        for text in rows:
            for f in plain_runs(text, most):
                counts[f] = counts.get(f, 0) + 1
    bucket = lambda f: zlib.crc32(f.encode()) % 100
    in_s, in_t = [0] * 100, [0] * 100
    for counts, into in ((s, in_s), (t, in_t)):
        for f, n in counts.items():
            into[bucket(f)] += n
    gain = [floor(1000 * log((b + 1) * (sum(in_s) + 100) / ((a + 1) * (sum(in_t) + 100)))) for a, b in zip(in_s, in_t, strict=True)]
    expected = []
    for i, text, _ in docs:
        own = plain_runs(text, most)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        expected.append([i, len(own), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(plain_runs(text, 1))])
    able = sorted((e for e in expected if e[4] >= 20), key=lambda e: (-e[3], e[0] is not None, e[0] or 0))
    ranks = {id(e): k + 1 for k, e in enumerate(able[: 10 * len(able) // 100])}
    frame = spark.createDataFrame(docs, "doc_id long, text string, rank int").repartition(4)
    weighed = importance.weights(frame, spark.createDataFrame(target, "text string"), most=most, buckets=100, common=common)
    assert sorted((x.doc_id is not None, x.doc_id or 0, x.n_features, x.weight) for x in weighed.collect()) == sorted((e[0] is not None, e[0] or 0, e[1], e[2]) for e in expected)
    found = importance.resampled(frame, spark.createDataFrame(target, "text string"), most=most, buckets=100)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2], x[3], x[4] or 0)
    assert sorted(map(key, found.select("doc_id", "n_features", "weight", "score", "rank").collect())) == sorted(key([*e[:4], ranks.get(id(e))]) for e in expected)


def test_importance_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resampled(docs, docs).count() == 0
    assert [tuple(x) for x in importance.resampled(some, docs).select("doc_id", "n_features", "rank").collect()] == [(1, 2, None)]
