"""Operators on small fixtures, against plain Python."""

import math
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from braidwork.llm import decontaminate, importance, language_id, license_scan, line_dedup, mixing, ngram_join, personal_data, quality_rules, token_files, toxic_spans, url_filter
from braidwork.llm.scratch import scratch_path
from tests.llm import brute

#: Extra columns whose names the operators use themselves.
CLASHES = "node string, key string, id string, row_key string, n_words string, score string, words string, base string, labels string, h string, start string, item_id string, host string, kept string, spans string"
SCHEMA = f"doc_id long, text string, source string, lang string, toxic int, url string, page_id long, {CLASHES}"


def _frame(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


def _line_sets(rows):
    out = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            x = x.lower().strip(" \t\r\v\f")
            if x:
                out[i, k] = {x[j : j + line_dedup.SHINGLE] for j in range(len(x) - line_dedup.SHINGLE + 1)}
    return out


def test_lines_against_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(4, 60))] for _ in range(40)]
    texts = []
    for _ in range(60):
        picked = []
        for line in rng.sample(base, rng.randrange(1, 6)):
            line = list(line)
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
            picked.append(" ".join(line).capitalize() + rng.choice(["", ".", " "]))
        texts.append("\n".join(picked + rng.choices(["", "Es.", " "], k=2)))
    rows = list(enumerate(texts)) + [(60, None), (61, ""), (62, "\n\n"), (63, "x" * 5000)]
    found = {(r.doc_id, r.line_no): r for r in line_dedup.line_table(_frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    sets = _line_sets(rows)
    assert set(found) == set(sets)
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 100 * len(sets[a] & sets[b]) >= line_dedup.PERCENT * len(sets[a] | sets[b])]
    expected = brute.components(keys, links)
    wrong = [k for k in keys if (found[k].rep_doc_id, found[k].rep_line_no) != expected[k]]
    assert len(wrong) <= 0.01 * len(keys)  # banding may miss a pair at the threshold
    assert all(found[k].kept == ((found[k].rep_doc_id, found[k].rep_line_no) == k) for k in keys)


def test_lines_removed_from_documents(spark):
    line = "a line that stands in more than one document"
    rows = [(1, f"first of its own kind here\n{line}", "s"), (2, f"second of quite another kind\n{line.upper()}\nok", "s"), (3, line, "s"), (4, None, "s"), (5, "", None), (None, "null identifier, own text", "s"), (6, "ok", "s"), (6, "ok", "s")]
    found = sorted(((r.doc_id, r.text) for r in line_dedup.without_repeats(_frame(spark, rows)).collect()), key=str)
    assert found == sorted([(1, rows[0][1]), (2, "second of quite another kind\nok"), (4, None), (5, ""), (None, rows[5][1]), (6, "ok"), (6, "ok")], key=str)
    assert line_dedup.line_table(_frame(spark, [])).count() == 0


def test_short_lines_have_rows_and_are_dropped(spark):
    rows = [(1, "Yes, sir.\n- \n\nno", "s"), (2, " yes, SIR.\n-\nown line", "s"), (3, "no\nYes, sir!", "s")]
    found = {(r.doc_id, r.line_no): (r.rep_doc_id, r.rep_line_no, r.kept) for r in line_dedup.line_table(_frame(spark, rows)).collect()}
    first = {(2, 0): (1, 0, False), (2, 1): (1, 1, False), (3, 0): (1, 3, False)}
    assert found == {k: first.get(k, (*k, True)) for k in ((1, 0), (1, 1), (1, 3), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1))}
    assert sorted((r.doc_id, r.text) for r in line_dedup.without_repeats(_frame(spark, rows)).collect()) == [(1, rows[0][1]), (2, "-\nown line"), (3, "no\nYes, sir!")]


def test_lines_with_one_changed_character(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz      "
    rows = []
    for length in range(40, 91):
        line = "a" + "".join(rng.choices(letters, k=length - 2)) + "z"
        at = rng.randrange(10, length - 10)
        rows += [(2 * length, line, "s"), (2 * length + 1, line[:at] + "#" + line[at + 1 :], "s")]
    found = {r.doc_id: r.rep_doc_id for r in line_dedup.line_table(_frame(spark, rows)).collect()}
    assert all(found[2 * n] == 2 * n for n in range(40, 91))
    assert sum(found[2 * n + 1] != 2 * n for n in range(40, 91)) <= 1  # banding may miss a pair at the threshold


def test_templates(spark):
    bench = spark.createDataFrame(
        [(1, "Yesterday Alice walked 5 miles and then Bob walked 7 miles so how far did Alice walk after 5 days of walking in the rain"), (2, "tiny item"), (3, None), (4, "")],
        "item_id long, text string",
    )
    texts = [
        "Yesterday Carol walked 9 miles and then Dave walked 3 miles so how far did Carol walk after 9 days of walking in the rain",  # consistent
        "Yesterday Carol walked 9 miles and then Dave walked 3 miles so how far did Erin walk after 2 days of walking in the rain",  # Alice is two names
        "Intro. YESTERDAY, alice walked 5 miles and then Bob walked 7 miles so how far did Alice walk after 5 days of walking in the rain! More.",
        "nothing to see here at all, only plain words that no benchmark holds",
        "some tiny item there",
        None,
        "",
    ]
    docs = _frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs, bench).collect()}
    assert found.keys() == {(0, 1), (2, 1), (4, 2)} and found[0, 1] == "template" and found[4, 2] == "exact"
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [1, 3, 5, 6]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_against_plain_windows(spark):
    """Items of plain words: a leak is 0.6 of the item, or 25 words on end, in windows of 8 that a run of neighbouring shifts shares."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(40)]
    items = [rng.choices(words, k=rng.randrange(3, 70)) for _ in range(25)]
    docs = []
    for _ in range(150):
        text = rng.choices(words, k=rng.randrange(0, 30))
        for _ in range(rng.randrange(0, 3)):
            item = rng.choice(items)
            a = rng.randrange(len(item))
            part = item[a : a + rng.randrange(1, len(item) + 1)]
            for _ in range(rng.randrange(0, 3)):
                part.insert(rng.randrange(len(part) + 1), rng.choice(words))
            text += part + rng.choices(words, k=rng.randrange(0, 9))
        docs.append(text)

    def leaked(item, text):
        size = min(8, len(item))
        met = {}
        for i in range(len(item) - size + 1):
            for j in range(len(text) - size + 1):
                if item[i : i + size] == text[j : j + size]:
                    met.setdefault(j - i, set()).update(range(i, i + size))
        groups, before = [], None
        for shift in sorted(met):
            if before is None or shift - before > len(item):
                groups.append(set())
            groups[-1] |= met[shift]
            before = shift
        for covered in [*met.values(), *groups]:
            runs = "".join("x" if i in covered else " " for i in range(len(item))).split()
            if len(covered) >= 0.6 * len(item) or max(map(len, runs), default=0) >= 25:
                return True
        return False

    frame = _frame(spark, [(i, " ".join(t), "s") for i, t in enumerate(docs)])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()}
    assert found == {(d, i) for d, t in enumerate(docs) for i, item in enumerate(items) if leaked(item, t)} and found


def test_numbers_alone_are_met_beside_words(spark):
    item = "sum of 1 2 3 4 5 6 7 8 9 10 11 12 is what"
    kinds = _kinds(item, [item, "sum of 1 2 3 4 5 6 7 8 9 10 11 12 is what", " ".join("5" for _ in range(3000))])
    assert kinds == {0: "exact", 1: "exact"}


def _kinds(item, texts):
    index = decontaminate.Index([1], pa.array([item]))
    return {f[0]: f[2] for f in index.leaks(pa.array(texts))}


def test_templates_with_inserted_words_and_separators():
    item = [f"word{i}" for i in range(39)]
    texts = [item[:19] + ["more"] + item[19:], item[:19] + item[20:], item[:19] + ["so"] * 12 + item[19:], item[:19] + ["so"] * 60 + item[19:], item[:16] + ["other"] * 20]
    assert _kinds(" ".join(item), [" ".join(x) for x in texts]) == {0: "exact", 1: "exact", 2: "exact"}
    shape = "the baker sold {} loaves on the first market day and then {} more loaves on the next so how many did the baker sell in all"
    numbers = [shape.format("1,050", "2.5"), shape.format("7.", "2 "), shape.format("950", "5"), "9." + shape.format("1", "2")]
    assert _kinds(shape.format("950", "5"), numbers) == {0: "template", 1: "template", 2: "exact", 3: "template"}
    assert len(decontaminate.templates(pa.array(["1,", "2", ",3.5,", "4.x 1,000,000.25"])).own) == 1 + 1 + 1 + 3


def test_templates_with_one_changed_slot():
    words = [f"word{i}" for i in range(59)]
    words[10], words[40] = "Alice", "Alice"
    copy = list(words)
    copy[40] = "Erin"
    short = "each day Alice reads a page before Alice sleeps"
    assert set(_kinds(" ".join(words), [" ".join(copy)])) == {0}
    assert set(_kinds(short, [short.replace("Alice sleeps", "Erin sleeps")])) == {0}


def test_urls(spark):
    urls = ["https://www.a.example.org/en/12?x", "http://EXAMPLE.org/es/", "x://example.org", "http://com/fr/1#a", "http://notexample.org/es/", "http://a.com/de/", "no scheme", None, "://", "http://h.net/fr/", "http://x.com/fr/\nq", "a://b.org/c://d.com/de/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])], "page_id long, url string")
    rules = spark.createDataFrame([*url_filter.BASE_RULES, ("block", None, "/")], "verdict string, host string, path string")

    def expected(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = brute.lower(host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    for most in (url_filter.BLOCK_RULES, 2):
        kept, url_filter.BLOCK_RULES = url_filter.BLOCK_RULES, most
        try:
            found = url_filter.judge(pages, rules).collect()
        finally:
            url_filter.BLOCK_RULES = kept
        assert len(found) == len(urls) + 2
        assert all((r.host, r.path, r.rule, r.verdict) == expected(urls[r.page_id]) for r in found if r.page_id is not None)
    assert url_filter.judge(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("repeats", [4.0, 1.5])
def test_mixture_meets_its_budgets(spark, repeats):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), s) for i, s in enumerate(["a"] * 700 + ["b"] * 150 + ["c"] * 20 + [None] * 30)] + [(9999, None, "a"), (9998, "", "z")]
    kept, mixing.BLOCK_BITS = mixing.BLOCK_BITS, 2
    try:
        found = mixing.mixed(_frame(spark, rows), repeats=repeats).collect()
    finally:
        mixing.BLOCK_BITS = kept
    words = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    total = sum(words.values())

    def curve(e):
        z = sum((w / total) ** e for w in words.values())
        p = [(w / total) ** e / z for w in words.values()]
        return -sum(x * math.log(x) for x in p), max((w / total) ** (e - 1) / z for w in words.values())

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        entropy, most = curve(mid)
        if entropy < mixing.ENTROPY * math.log(4):
            high = mid
        else:
            low = mid
    sparing, top = 0.0, 1.0
    for _ in range(60):
        mid = (sparing + top) / 2
        sparing, top = (mid, top) if curve(mid)[1] > repeats else (sparing, mid)
    e = max(low, top if curve(0)[1] > repeats else 0)
    z = sum(w**e for w in words.values())
    for s, w in words.items():
        mine = [r for r in found if r.source == s]
        budget = w**e / z * total
        assert budget - 40 <= sum(r.n_words for r in mine) <= budget + 40
        passes = {}
        for r in mine:
            passes.setdefault(r.pass_no, []).append(r.doc_id)
        assert all(len(set(x)) == len(x) for x in passes.values())
        for k in range(max(passes)):  # all but the last pass are whole
            assert len(passes[k]) == sum(x == s and bool(t) for _, t, x in rows)
        ordered = sorted((r.place % (1 << 64), r.n_words) for r in mine if r.pass_no == max(passes))
        room = round(budget) - max(passes) * w
        before = sum(n for _, n in ordered) - ordered[-1][1]
        assert before < room + 1 and all(r.block_no == (r.place % (1 << 64)) >> 62 for r in mine)
    assert mixing.mixed(_frame(spark, [])).count() == 0


def test_language(spark):
    rng = random.Random(4)
    make = {"en": "the of and ing tion er", "xx": "zq vök ûrr gnä pfü", "yy": "αβ γδε ζη θικ"}
    rows = [(i, " ".join(rng.choices(make[x].split(), k=30)), "s", x) for i, x in enumerate(rng.choices(list(make), k=300))]
    labelled = spark.createDataFrame(rows[:200] + [(900, None, "s", "en"), (901, "the of", "s", None)], "doc_id long, text string, source string, lang string")
    model = language_id.train(labelled)
    tail = [(500, None), (501, ""), (502, "12 34 !!"), (503, "THE  of, AND"), (504, "漢字 😀 𝒳"), (505, "the of and " * 30000)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows[200:]] + tail, "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(found[r[0]].lang_pred == r[3] for r in rows[200:])
    assert [found[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and found[503].lang_pred == found[505].lang_pred == "en"
    assert found[504].rejected and all(0 <= r.score <= 1 for r in found.values())
    assert language_id.train(labelled.limit(0)) is None and {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    letters, at = language_id.characters(pa.array(["abra cadabra", "barbar a", "rabarbara"]))
    packed, n = np.unique(language_id.grams(letters, at), return_counts=True)
    model = language_id.fit({"a": (packed, n), "b": (packed[:5], n[:5])})
    alphabet = np.unique(letters).astype(np.uint64)
    for context in ("bar", "zzz", " ab", "rba"):
        head = sum(np.uint64(ord(c)) << np.uint64(16 * (3 - i)) for i, c in enumerate(context))
        total = np.exp(model.log_probabilities(head | alphabet)).sum(axis=0)
        assert (total <= 1 + 1e-4).all() and total[0] > 0.8


def test_kneser_ney_by_the_formula():
    """Probabilities by the recursive definition over plain strings, counts of lower orders being of distinct characters before."""
    from collections import Counter

    texts = {"a": ["abra cadabra", "barbar a", "rabarbara cab"], "b": ["abba acca", "cab bac dab", "dad abc"]}
    rows = {k: pa.array(v) for k, v in texts.items()}
    model = language_id.fit({k: np.unique(language_id.grams(*language_id.characters(v)), return_counts=True) for k, v in rows.items()})
    alphabet = len({c for v in texts.values() for t in v for c in t}) + 1

    def counts(lines):
        top = Counter(("    " + t)[i + 1 : i + 5] for t in lines for i in range(len(t)))
        found = {4: top}
        for k in (3, 2, 1):
            found[k] = Counter(g[1:] for g in found[k + 1])
        return found

    tables = {k: counts(v) for k, v in texts.items()}

    def p(language, gram, k=4):
        if not k:
            return 1 / alphabet
        table, own = tables[language][k], gram[-k:]
        ones, twos = (sum(n == m for n in table.values()) for m in (1, 2))
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        mates = [n for g, n in table.items() if g[:-1] == own[:-1]]
        if not mates:
            return p(language, gram, k - 1)
        return max(table[own] - discount, 0) / sum(mates) * (table[own] > 0) + discount * len(mates) / sum(mates) * p(language, gram, k - 1)

    wanted = ["abra", "   a", "zabc", " cab", "dada", "bbbb", "r ca"]
    packed = np.array([sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(g)) for g in wanted], dtype=np.uint64)
    got = np.exp(model.log_probabilities(packed))
    assert np.allclose(got, [[p(x, g) for x in model.languages] for g in wanted], rtol=1e-4)


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 3, 4, 8])
    e, pairs = rng.normal(size=8), rng.normal(size=(2, 2))
    p, joint, z = toxic_spans.marginals(e, bounds, pairs)
    whole, logs, linked = np.zeros(8), 0.0, np.zeros((2, 2))
    for a, b in zip(bounds, bounds[1:], strict=False):
        tags = [[(k >> i) & 1 for i in range(b - a)] for k in range(1 << (b - a))]
        weight = np.array([np.exp(sum(e[a + i] * t[i] for i in range(b - a)) + sum(pairs[x, y] for x, y in zip(t, t[1:], strict=False))) for t in tags])
        logs += np.log(weight.sum())
        for t, w in zip(tags, weight / weight.sum(), strict=True):
            whole[a:b] += w * np.array(t)
            for x, y in zip(t, t[1:], strict=False):
                linked[x, y] += w
    assert np.allclose(p, whole) and np.allclose(joint, linked) and np.isclose(z, logs)


def test_toxic(spark):
    rng = random.Random(6)
    clean = [f"w{i}" for i in range(60)]

    def text(bad):
        words = rng.choices(clean, k=40)
        for _ in range(4 if bad else 0):
            words[rng.randrange(40)] = "grunz" + rng.choice(["el", "ig", "ung", "en", "em"]) if rng.random() < 0.5 else "idiot"
        return " ".join(w + (". " if rng.random() < 0.1 else "") for w in words)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    chain = toxic_spans.train(spark.createDataFrame(rows[:300] + [(900, None, 1), (901, "x", None)], "doc_id long, text string, toxic int"))
    tail = [(500, None), (501, ""), (502, "é w1 Idiot grunzium w2")]
    found = {r.doc_id: r for r in toxic_spans.score(spark.createDataFrame([(i, t) for i, t, _ in rows[300:]] + tail, "doc_id long, text string"), chain).collect()}
    assert all(found[i].predicted == y for i, _, y in rows[300:])
    assert found[500].predicted == found[501].predicted == 0 and found[502].spans.startswith("5:")
    assert toxic_spans.train(spark.createDataFrame([], "doc_id long, text string, toxic int")) is None


def test_toxic_scores_follow_the_base_rate_of_all_labels(spark):
    """2 % toxic, all with a word that 4 % of the clean ones hold too: it makes a document toxic in a third of the cases."""
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        bad = i % 100 < 2
        words = rng.choices([f"w{k}" for k in range(40)], k=7)
        if bad or rng.random() < 0.04:
            words[rng.randrange(7)] = "grunz"
        rows.append((i, " ".join(words), int(bad)))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    docs = spark.createDataFrame([(0, "w1 w2 grunz w3")], "doc_id long, text string")
    for sample in (6000, 1000):
        row = toxic_spans.score(docs, toxic_spans.train(labelled, sample=sample)).first()
        assert row.predicted == 0 and 0.1 < row.score < 0.5


OPERATORS = {
    "language": lambda docs: language_id.predict(docs, language_id.train(docs)),
    "copies": ngram_join.near_duplicates,
    "licenses": license_scan.scan,
    "lines": line_dedup.line_table,
    "leaks": lambda docs: decontaminate.leaks(docs, docs.select(docs.doc_id.alias("item_id"), "text")),
    "urls": lambda docs: url_filter.judge(docs, docs.sparkSession.createDataFrame(url_filter.BASE_RULES, "verdict string, host string, path string")),
    "mixture": mixing.mixed,
    "personal": personal_data.detect,
    "quality": lambda docs: quality_rules.judged(quality_rules.document_features(docs)),
    "toxic": lambda docs: toxic_spans.score(docs, toxic_spans.train(docs)),
    "tokens": lambda docs: _through_files(docs),
    "importance": lambda docs: importance.resampled(docs, docs),
}


def _through_files(docs):
    path = scratch_path(docs.sparkSession, "shards")
    token_files.write(docs, path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(docs.sparkSession, path)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    texts = [None, "", " \n\n ", "a", "one two three four five six", "one two three four five six", "word " * 20000, "x" * 50000, "mail a@b.cd now", "éß 漢字 😀"]
    rows = [(i, t, "s" if i % 2 else None, "en" if i % 3 else "fr", i % 2, "http://a.org/x", i) for i, t in enumerate(texts)]
    rows += [(None, "one two three four five six", "s", None, None, None, None), rows[4], rows[4]]
    extra = len(CLASHES.split(","))
    docs = spark.createDataFrame([(*r, *["clash"] * extra) for r in rows], SCHEMA).repartition(3)
    out = OPERATORS[name](docs)
    n = out.count()
    if name == "lines":
        assert n == sum(bool(x.strip()) for r in rows for x in (r[1] or "").split("\n"))
    elif name in ("leaks", "mixture"):
        assert n > 0
    else:
        assert n == len(rows)
    assert OPERATORS[name](docs.limit(0)).count() == 0


def _plain_runs(document, item, width):
    """Longest runs of equal windows by comparing all places: (document place, item place, windows)."""
    at = lambda words, i: tuple(words[i : i + width])
    n, m = len(document) - width + 1, len(item) - width + 1
    out = set()
    for p in range(n):
        for s in range(m):
            if at(document, p) == at(item, s) and not (p and s and at(document, p - 1) == at(item, s - 1)):
                k = 1
                while p + k < n and s + k < m and at(document, p + k) == at(item, s + k):
                    k += 1
                out.add((p, s, k))
    return out


def test_window_runs_against_all_places():
    rng = random.Random(6)
    for words in ("ab", "abc", "abcdefgh"):
        items = [[rng.choice(words) for _ in range(rng.choice([3, 8, 12, 40]))] for _ in range(6)]
        documents = [[rng.choice(words) for _ in range(rng.choice([0, 5, 30]))] + rng.choice(items) * rng.choice([1, 2]) for _ in range(8)]
        index = decontaminate.Index(list(range(6)), pa.array([" ".join(x) for x in items]))
        found = decontaminate.templates(pa.array([" ".join(x) for x in documents]))
        mine = index.found.at
        runs = set()
        for w in index.windows:
            for p, s, i, k in zip(*(x.tolist() for x in w.runs(found, mine[1:])), strict=True):
                d = int(np.searchsorted(found.at, p, side="right")) - 1
                runs.add((d, i, p - int(found.at[d]), s - int(mine[i]), k))
        expected = {(d, i, *x) for d, document in enumerate(documents) for i, item in enumerate(items) for x in _plain_runs(document, item, min(decontaminate.WINDOW, len(item)))}
        assert runs == expected


def test_repetitive_items(spark):
    phrase = "row row your boat "
    bench = spark.createDataFrame([(1, phrase * 90), (2, "la " * 30_000), (3, "what is the name of the tall person " * 8 + "who sings")], "item_id long, text string")
    docs = [
        (1, "once upon a time " + phrase * 90 + "they said"),  # verbatim among other words
        (2, "boat " + phrase * 300),  # the phrase goes on for longer, from another of its words
        (3, phrase * 3),  # 12 words are no copy of 360, however often they could be laid on it
        (4, "la " * 40_000),
        (5, "la " * 12),
        (6, "they sing " + "what is the name of the tall person " * 8 + "who sings well"),
        (7, "what is the name of the tall person who sings"),
    ]
    found = {(r.doc_id, r.item_id): (r.kind, r.n_words) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert found == {(1, 1): ("exact", 360), (2, 1): ("exact", 360), (4, 2): ("exact", 30_000), (6, 3): ("exact", 66)}


def test_many_nested_rules_of_one_host():
    rng = random.Random(3)
    rules = [("h.org", "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(6)))) for _ in range(300)] + [("org", "/"), ("org", "/a"), ("a.h.org", "/b/c")]
    table = [(url_filter.key_of(h), p, h + p, rng.choice(["allow", "block"])) for h, p in rules]
    pages = sorted((url_filter.key_of(h), "/" + "/".join(rng.choice("abcd") for _ in range(rng.randrange(7)))) for h in ("h.org", "x.h.org", "a.h.org", "org", "com") for _ in range(80))
    for begin in (0, 150, 333):  # a partition may begin anywhere
        for (key, path), found in zip(pages[begin:], url_filter.Rules(table).sweep(iter(pages[begin:])), strict=True):
            fits = [(len(r), len(k), r, v == "block", v) for k, p, r, v in table if key.startswith(k) and path.startswith(p)]
            assert found == max(fits, default=None)
    many = url_filter.Rules([(url_filter.key_of("h.org"), f"/{i:06d}/", f"h.org/{i:06d}/", "block") for i in range(100_000)])
    began = time.time()
    swept = many.sweep((url_filter.key_of("h.org"), f"/{i:06d}/page") for i in range(100_000))
    assert sum(x is not None for x in swept) == 100_000 and time.time() - began < 20


def test_band_keys_of_lines_are_short():
    """Whole 64-bit keys took three bytes more of a posting; short ones differ as well."""
    text = "\n".join(f"line {i} of {'many ' * (i % 30)}lines that are all their own {i * i}" for i in range(500))
    sums, _, _, starts, ends = line_dedup.lines_of(pa.array([text]))
    keys = np.concatenate([k.ravel() for _, k in line_dedup._signatures(sums, starts, ends)])
    assert keys.max() < 1 << 40 and len(np.unique(keys)) > 5000
