"""The corpus pipeline's stages on rows with nulls, empty and long texts, ties, repeats and clashing column names."""

import random

import corpus_pipeline
import pytest
from tests.llm import brute

CLASHES = ("words", "passes", "budget", "row_key", "key", "row", "host_rejected", "n_words", "word_chars", "kept", "base_failed", "component", "node", "id", "place", "s", "n", "room", "full", "at", "b", "dropped", "cut", "text_", "_key", "hub", "bands0")
SCHEMA = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def _prose(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "vita", "nova", "terra"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    base = [_prose(rng, rng.randrange(30, 60)) for _ in range(12)]
    texts = [base[i % 12] if i % 3 else base[i % 12] + f" tail{i}" for i in range(40)] + [_prose(rng, 40) for _ in range(20)]
    texts += [None, "", " \n ", "short one", _prose(rng, 8000), "x" * 20000, "same words here " * 40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, texts[45]), (3, texts[3]), (3, texts[3]), (4, texts[50] + " more words of another kind entirely")]
    return [(i, t, "s" if k % 3 else None, len(t or "")) + tuple(f"{c}{k}" for c in CLASHES) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, rows):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, rows[46][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_hands_rows_on(spark, docs, rows, sf_dir, name, stage):
    out = stage(spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert set(out.columns) - set(docs.columns) <= ({"pass_no", "block_no", "n_words"} if name == "mixture" else set())
    before = {r[4]: r for r in rows}  # the first clashing column names the row
    for r in out.collect():
        was = before[r.words]
        assert (r.doc_id, r.source) == (was[0], was[2])
        assert tuple(r[c] for c in CLASHES) == was[4:]
        if name != "lines":
            assert (r.text, r.n_chars) == (was[1], was[3])
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.columns == out.columns and empty.count() == 0


def test_quality_drops_what_fails(spark, docs, rows, sf_dir):
    kept = {r.words for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    assert kept and kept == {r[4] for r in rows if not brute.quality(r[1])[-1] and r[4] in kept}
    assert all(r[4] not in kept for r in rows if brute.quality(r[1])[-1])


def test_one_of_each_group_stays(spark, docs, rows, sf_dir):
    kept = [r.words for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    texts = {k: r[1] for k, r in enumerate(rows)}
    found = brute.near_duplicates(list(texts.items()), 5, 80)
    groups = {}
    for k, (n, c) in found.items():
        if n:
            groups.setdefault(c, []).append(k)
    alone = [rows[k][4] for k, (n, _) in found.items() if not n]
    assert len(kept) == len(groups) + len(alone) and set(alone) <= set(kept)
    for members in groups.values():
        staying = [k for k in members if rows[k][4] in kept]
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        assert len(staying) == 1 and (not ids or rows[staying[0]][0] == min(ids))


def test_leaks_go_and_the_rest_stays(spark, docs, rows, sf_dir):
    kept = {r.words for r in corpus_pipeline.decontamination(spark, docs, sf_dir).collect()}
    assert rows[46][4] not in kept and {r[4] for r in rows if r[1] != rows[46][1]} == kept


def test_run_ends_with_rows(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("n_words IS NOT NULL").count() > 0
