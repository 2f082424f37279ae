import random

import duckdb

from braidwork.functions import keys
from braidwork.operators import loops
from braidwork.operators import relational as R
from braidwork.plans import catalog, read_models, registry  # noqa: F401  they register their queries
from pyspark.sql import functions as F


def _edges(spark, seed=1, n=40, m=60):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return pairs, spark.createDataFrame(pairs, "src long, dst long")


def test_breadth_first(spark):
    pairs, edges = _edges(spark)
    depth = {0: 0}
    frontier = [0]
    while frontier:
        frontier = sorted({b for a, b in pairs if a in frontier and b not in depth})
        depth |= {b: max(depth.values()) + 1 for b in frontier}
    found = {r.node: r.depth for r in loops.breadth_first(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert found == depth


def test_components(spark):
    pairs, edges = _edges(spark, seed=3, m=25)
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in loops.components(edges).collect()} == root


def test_pages_and_runs(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabba")] + [(2, 0, None), (2, 1, None)], "g long, o long, v string")
    runs = sorted((r.g, r.run_no, r.first_at, r.last_at, r.run_value, r.length) for r in R.runs(df, "g", "o", "v").collect())
    assert runs == [(1, 1, 0, 1, "a", 2), (1, 2, 2, 3, "b", 2), (1, 3, 4, 4, "a", 1), (2, 1, 0, 1, None, 2)]
    page = [(r.v, r.o) for r in R.keyset_page(df.where("g = 1"), ["v", "o"], ("a", 1), 2).collect()]
    assert page == [("a", 4), ("b", 2)]


def test_keys(spark):
    df = spark.createDataFrame([(i, f"d{i}") for i in range(50)], "k long, d string")
    assert keys.generation(df, "k", "d").collect() == keys.generation(df.orderBy(F.desc("k")).repartition(7), "k", "d").collect()
    assert df.select(keys.padded(F.col("k"), 4)).first()[0] == "0000"


def test_merged_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (2, 1, 2)], "g long, a long, b long")
    assert sorted(map(tuple, R.merged_intervals(df, "g", "a", "b").collect())) == [(1, 0, 7, 2), (1, 9, 10, 1), (2, 1, 2, 1)]


def test_innermost_interval_against_all_pairs(spark):
    r = random.Random(7)
    spans = [(r.choice("ab"), a := r.randrange(-50, 900), a + r.choice([-3, 0, 1, 7, 64, 300]), i) for i in range(200)]
    points = [(r.choice("abc"), r.randrange(-60, 1200), i) for i in range(300)]
    expected = {}
    for k, at, i in points:
        over = [(-a, b, s) for g, a, b, s in spans if g == k and a <= at <= b]
        if over:
            expected[i] = min(over)[2]
    found = R.innermost_interval(spark.createDataFrame(points, "k string, at long, i long"), spark.createDataFrame(spans, "k string, start long, end long, s long"), ["k"], "at", "start", "end", "s")
    assert {x.i: x.owner for x in found.collect()} == expected
    assert R.innermost_interval(spark.createDataFrame(points, "k string, at long, i long"), spark.createDataFrame([], "k string, start long, end long, s long"), ["k"], "at", "start", "end", "s").count() == 0


def _against_sql(spark, query, folder, **tables):
    """The rows of a query and of its SQL over small tables."""
    db = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    found = registry.QUERIES[query](spark, str(folder))
    return sorted(map(tuple, found.collect()), key=repr), sorted(db.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLES[query]})").fetchall(), key=repr)


def test_nearest_section_rounds_and_takes_no_null_users(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10.4", 5), (4, "2024-01-01 00:00:09.6", 5), (8, "2024-01-01 00:00:10.9", 5), (2, "2024-01-01 00:00:01", None), (12, "2024-01-01 00:00:01", None), (3, "2024-01-01 00:00:01", 6)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found, expected = _against_sql(spark, "nearest_section", tmp_path, events=events)
    assert found == expected == [(5, 1, 4), (6, 3, None), (None, 2, None)]


def test_bfs_witness_goes_as_far_as_its_sql(spark, tmp_path):
    part = spark.range(167).select(F.col("id").alias("p_partkey"), F.lit(20).alias("p_size"))  # 7 p + 3 leads from 1 through most of 0 to 166
    found, expected = _against_sql(spark, "bfs_witness", tmp_path, part=part)
    assert len(found) == 61 and found == expected


def test_merged_intervals_of_copies(spark):
    rows = [(1, 10, 40)] * 6 + [(1, 60, 70), (1, 70, 90)]
    found = R.merged_intervals(spark.createDataFrame(rows, "g long, a long, b long").repartition(4), "g", "a", "b")
    assert sorted(map(tuple, found.collect())) == [(1, 10, 40, 6), (1, 60, 90, 2)]
