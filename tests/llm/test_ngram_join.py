import random

from braidwork.llm import ngram_join
from tests.llm import brute


def _edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def _rows(seed=5):
    """Families of near copies, a passage that most rows share, and rows made of few shared lines."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    lines = [[rng.choice(vocabulary) for _ in range(9)] for _ in range(9)]
    texts = []
    for family in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 90))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(_edited(rng, base, rng.randrange(0, 3)) + (passage if rng.random() < 0.6 else []))
    for _ in range(120):
        texts.append([w for line in rng.sample(lines, 7) for w in line])
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n "), (len(rows) + 3, "One TWO"), (len(rows) + 4, "one two")]


def test_equals_brute_force(spark):
    rows = _rows()
    for rare, percent, width in ((5, 85, 4), (0.1, 80, 5)):
        ngram_join.RARE, kept = rare, ngram_join.RARE
        try:
            found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
        finally:
            ngram_join.RARE = kept
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near_duplicates(rows, width, percent)
        assert len(found) == len(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, node string, key string")
    assert ngram_join.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (None, "q r"), (7, None)]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(found, key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (7, 0, 7)], key=str)


def test_short_texts_of_frequent_tokens(spark):
    base = " ".join(f"b{i}" for i in range(9))
    rows = [(i, f"{base} own{i}") for i in range(200)] + [(200, base)]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85).collect()
    assert {r.doc_id: r.component_id for r in found} == dict.fromkeys(range(201), 0)


def test_calm_documents_with_frequent_prefixes(spark):
    """Two texts at exactly the threshold whose common prefix tokens are all frequent, beside documents that share a passage."""
    rng = random.Random(12)
    words = [f"a{i}" for i in range(23)]
    rows = [(0, " ".join(words)), (1, " ".join(words[3:]))]
    for i in range(20):
        at = rng.randrange(0, 18)
        rows.append((2 + i, " ".join([f"u{i}x{k}" for k in range(8)] + words[at : at + 6] + [f"v{i}x{k}" for k in range(8)])))
    passage = [f"p{k}" for k in range(8)]
    rows += [(30 + i, " ".join(passage + [f"q{i}x{k}" for k in range(rng.randrange(3, 12))])) for i in range(40)]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near_duplicates(rows, 4, 85)


def test_variants_about_the_threshold(spark):
    """Texts cut out of and inserted into a few originals, so that most pairs lie just above or below the threshold, with few tokens of their own."""
    rng = random.Random(13)
    rows = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(rng.randrange(30, 70))]
        inserts = [[f"f{family}i{j}x{k}" for k in range(3)] for j in range(5)]
        for _ in range(60):
            out = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.choice([5, 12, 20, 26])
                out[at : at + rng.randrange(0, 3)] = rng.choice(inserts)
            rows.append((len(rows), " ".join(out[rng.randrange(0, 4) : len(out) - rng.randrange(0, 4)])))
    kept, ngram_join.RARE = ngram_join.RARE, 1
    try:
        found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85).collect()
    finally:
        ngram_join.RARE = kept
    expected = brute.near_duplicates(rows, 4, 85)
    assert len({c for _, c in expected.values()}) > 10
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
