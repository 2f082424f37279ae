import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators import cuts, packing, read_model


def _rows(spark, seed):
    r = random.Random(seed)
    rows = [(g, i, r.choice([0, 1, 3, 9, 10]), r.random() < 0.3, r.choice(["line", "line", "condition", "choice", "jump", "ending"])) for g in ("a", "b", None) for i in range(r.choice([1, 40, 150]))]
    return rows, spark.createDataFrame(rows, "g string, i long, z long, b boolean, kind string").repartition(5)


def _by_group(rows):
    out = {}
    for g, *x in rows:
        out.setdefault(g, []).append(x)
    return out


@pytest.mark.parametrize("seed", [1])
def test_greedy_packing_against_folds(spark, seed):
    rows, df = _rows(spark, seed)
    fit, split, spaced = {}, {}, {}
    for g, items in _by_group(rows).items():
        n = total = no = 0
        for i, z, *_ in items:
            if n + 1 > 7 or total + z > 30:
                n, total, no = 0, 0, no + 1
            n, total, fit[g, i] = n + 1, total + z, no
        total = no = 0
        for i, z, b, _ in items:
            split[g, i], total = no, total + z
            if total >= 25 or b and 2 * total >= 25:
                total, no = 0, no + 1
        since = 4
        for i, _, b, _ in items:
            spaced[g, i] = i == 0 or b and since >= 4
            since = 1 if spaced[g, i] else since + 1
    got = lambda found, c: {(x.g, x.i): x[c] for x in found.collect()}
    assert got(packing.next_fit(df, "g", "i", {"z": 30}, 7), "bin_no") == fit
    assert got(packing.boundary_split(df, "g", "i", "z", "b", 25), "chunk_no") == split
    assert got(read_model.spaced_boundaries(df, "g", "i", "b", 4), "accepted") == spaced


@pytest.mark.parametrize("stretch", [16])
def test_strong_cuts_against_a_fold(spark, monkeypatch, stretch):
    monkeypatch.setattr(packing, "STRETCH", stretch)
    rows, df = _rows(spark, 3)
    expected = {}
    for g, items in _by_group(rows).items():
        now, no = [], 0
        for i, z, _, kind in items:
            while now and (len(now) >= 11 or sum(x[1] for x in now) + z > 40):
                best = max(((packing.CUT_STRENGTH.get(x[2], 0), k) for k, x in enumerate(now) if k >= len(now) - 5), default=(0, 0))
                stop = best[1] + 1 if best[0] else len(now)
                expected.update({(g, x[0]): no for x in now[:stop]})
                now, no = now[stop:], no + 1
            now.append((i, z, kind))
        expected.update({(g, x[0]): no for x in now})
    found = packing.strong_cuts(df, "g", "i", "kind", "z", most_items=11, most_size=40, reach=4)
    assert {(x.g, x.i): x.chunk_no for x in found.collect()} == expected


def test_a_long_group_is_dealt_to_many_tasks(spark):
    df = spark.range(300_000).select(F.lit("only").alias("g"), F.col("id").alias("i"), (F.col("id") % 7).alias("z"))
    rows = cuts.placed(df, "g", "i", "z")
    assert rows.agg(F.max("sum_z"), F.max("place")).first()[:] == (sum(i % 7 for i in range(300_000)), 299_999)
    found = packing.next_fit(df, "g", "i", {"z": 50}, 1000)
    n = total = no = 0
    for i in range(300_000):
        if n + 1 > 1000 or total + i % 7 > 50:
            n, total, no = 0, 0, no + 1
        n, total = n + 1, total + i % 7
    assert found.agg(F.count_distinct("bin_no"), F.max("bin_no"), F.count("*")).first()[:] == (no + 1, no, 300_000)
