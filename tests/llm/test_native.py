import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import boosting, license_scan, personal_data, quality_rules, spans
from tests.llm import brute

PARTS = [
    "a.b@c.de", "x@y", "mail me@host.example.com_z@q.r", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.02.3.4", "4994226020900891", "4390 6985-7587 3170",
    "4111 1111 1111 1111", "+1 (499) 555-6503", "+12", "+49 30 1234567", "é", "𝄞", "\n", " ", "  ", "-", ".", "+", "the", "the", "On", "ed", "and", "a", "b", "\t", "#*", "%&",
    "under the MIT License", "under the mit  license.", "Apache License, Version 2.0", "apache license version 2", "CC BY-NC 4.0", "cc by nc", "nc", "cc", "under",
    'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "\x85", " ", "K", "İ",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["".join(p + rng.choice([" ", " ", "", "\n"]) for p in rng.choices(PARTS, k=rng.randrange(0, 60))) for _ in range(250)]
    texts += ["\n".join(rng.choices(["the the the a b c d", "x y z", "", " ", "one two three four five six"], k=rng.randrange(1, 9))) for _ in range(80)]
    texts += [None, "", " ", "a " * 3000, "+" * 300, "1" * 400, "9 " * 500, "a" * 5000]
    return list(enumerate(texts)) + [(None, "x@y.z"), (0, texts[0]), (0, texts[0])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s" if i is not None and i % 3 else None, "clash") for i, t in rows], "doc_id long, text string, source string, base string").repartition(5)


def _sorted(found):
    return sorted(found, key=str)


def test_personal_data(docs, rows):
    found = personal_data.detect(docs).collect()
    expected = [(i, hashlib.sha256(",".join(brute.personal_data(t)).encode()).hexdigest()) for i, t in rows]
    assert _sorted((r.doc_id, r.base_sha256) for r in found) == _sorted(expected)
    by_id = dict(rows)
    for r in found:
        base = brute.personal_data("x@y.z" if r.doc_id is None else by_id[r.doc_id])
        shown = r.spans.split(",") if r.spans else []
        assert set(base) <= set(shown)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone")]
    assert any("secret:" in r.spans for r in found)


def test_personal_data_in_very_long_texts(spark):
    n = 200_000
    texts = {"card": "1" * n, "spaced": "9 " * (n // 2), "email": "a@b" + ".c" * (n // 2), "ip": "1." * (n // 2), "phone": "+1" + "-2" * (n // 2), "word": "x" * n, "address": "a (at) b" + " (dot) c" * (n // 8), "account": "DE02 " + "1234 " * (n // 5)}
    rows = [(i, t) for i, t in enumerate(texts.values())]
    found = {r.doc_id: r for r in personal_data.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows) and [found[2].n_email, found[2].spans] == [1, f"email:0:{len(texts['email'])}"]
    expected = {"card": "", "phone": "", "word": "", "email": f"email:0:{len(texts['email'])}"}  # by hand: the plain patterns take a time of n squared here
    at = list(texts)
    assert {k: found[at.index(k)].base_sha256 for k in expected} == {k: hashlib.sha256(x.encode()).hexdigest() for k, x in expected.items()}


def test_every_proposal_against_finditer(spark):
    rng = random.Random(8)
    parts = [*PARTS, "aB3_9-xK2pQ7zLmN4vTy", "0123456789abcdef0123", "me (at) host (dot) org", "you [at] example.net", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "call (030) 123-45 67 89", "\x01", "so"]
    texts = ["".join(p + rng.choice([" ", "", "\n", ", "]) for p in rng.choices(parts, k=40)) for _ in range(120)]
    found = personal_data.proposals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    n = len(personal_data.BASE)
    for r in found:
        for k, (kind, pattern, needle) in enumerate(personal_data.PROPOSED):
            expected = [(m.start(), m.end()) for m in re.finditer(pattern, texts[r.doc_id]) if m.group()] if not needle or needle in texts[r.doc_id] else []
            assert [(m.a, m.b) for m in r.proposed if m.kind == n + k] == expected, kind
    assert all(sum(m.kind == n + k for r in found for m in r.proposed) > 60 for k in range(len(personal_data.PROPOSED)))


def test_several_secrets_of_a_text(spark):
    text = "token=aB3dE6gH9jK2mN5pQ8sT and secret: Zx9Cv8Bn7Mq6Wl5Er4Ty3 or api_key=q1W2e3R4t5Y6u7I8o9P0"
    rows = [(i, text) for i in range(80)] + [(100 + i, f"plain words of text number {i} go here") for i in range(80)]
    found = {r.doc_id: r.spans for r in personal_data.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    starts = [text.index(x) for x in ("aB3d", "Zx9C", "q1W2")]
    assert all(found[i].split(",") == [f"secret:{a}:{a + n}" for a, n in zip(starts, (20, 21, 20), strict=True)] for i in range(80))
    assert not any(found[100 + i] for i in range(80))


def test_many_matches_in_one_text_take_linear_time(spark):
    addresses = "".join(f"user{i}@example.org " for i in range(100_000))
    licensed = "licensed under the mit license or so " * 60_000
    began = time.time()
    (r,) = personal_data.detect(spark.createDataFrame([(1, addresses)], "doc_id long, text string")).collect()
    assert r.n_email == 100_000 and r.spans.endswith(f"email:{len(addresses) - 22}:{len(addresses) - 1}")
    (r,) = license_scan.scan(spark.createDataFrame([(1, licensed)], "doc_id long, text string")).collect()
    assert (r.n_base, r.first_word, r.last_word) == (60_000, 1, 59_999 * 7 + 1)
    assert time.time() - began < 90


def test_running_sums(spark):
    rows = [(i, [random.Random(i).randrange(9) for _ in range(n)]) for i, n in enumerate([0, 1, 127, 128, 129, 1000])]
    found = spark.createDataFrame(rows, "i long, v array<long>").select("i", spans.running(F.col("v")).alias("s"))
    assert {r.i: r.s for r in found.collect()} == {i: list(itertools.accumulate(v)) for i, v in rows}


def test_account_numbers_are_checked(spark):
    rows = [(i, f"pay to {'DE89 3704 0044 0532 0130 00' if i % 2 else 'DE88 3704 0044 0532 0130 00'} now") for i in range(60)]
    found = {r.doc_id: r.spans for r in personal_data.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(("account:7:34" in found[i]) == (i % 2 == 1) for i in range(60))


def test_quality(spark, docs, rows):
    kept = quality_rules.judged(quality_rules.document_features(docs))
    found = kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert _sorted(map(tuple, found)) == _sorted((i, *brute.quality(t)) for i, t in rows)
    assert kept.where("base_failed AND kept").count() == 0
    bad = spark.createDataFrame([(i, "a b", "bad") for i in range(50)] + [(99, "one two three four five six seven eight nine ten eleven", "bad")] + [(i, "one two three four five six seven eight nine ten", "good") for i in range(100, 150)], "doc_id long, text string, source string")
    verdicts = {r.doc_id: r.kept for r in quality_rules.judged(quality_rules.document_features(bad)).collect()}
    assert verdicts[99] is False and verdicts[100] is True


def test_licenses(spark, docs, rows):
    found = license_scan.scan(docs).collect()
    assert _sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == _sorted((i, *brute.licenses(t)) for i, t in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    one = spark.createDataFrame([(1, "Licensed under the GNU General Public License, version 3."), (2, "Licensed under CC BY-NC-SA 4.0, or SPDX-License-Identifier: MPL-2.0"), (3, "released under the terms of the BSD 3-Clause License")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(one).collect()} == {1: "gpl-3.0", 2: "cc-by-nc,cc-by-nc-sa-4.0,mpl-2.0", 3: "bsd-3-clause"}
    assert len(license_scan.rules()) > 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert personal_data.detect(none).count() == license_scan.scan(none).count() == quality_rules.judged(quality_rules.document_features(none)).count() == 0


def test_boosting_learns_and_sql_agrees(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (400, 3))
    y = ((x[:, 0] > 1) & (x[:, 2] < 2)).astype(float)
    bias, trees = boosting.fit(x, y, np.ones(400))
    p = np.array([boosting.probability(bias, trees, r) for r in x])
    assert ((p > 0.5) == (y > 0.5)).all()
    limit = boosting.threshold(p, y, np.ones(400), 0.95)
    assert 0 < limit <= p[y > 0].min() + 1e-12
    expression = boosting.sql(bias, trees, ["a", "b", "c"])
    got = [r[0] for r in spark.createDataFrame([tuple(map(int, r)) for r in x[:50]], "a int, b int, c int").selectExpr(expression).collect()]
    assert np.allclose(got, p[:50], atol=1e-9)
