import pytest
from pyspark.sql import functions as F

from braidwork.sources import scripts
from braidwork.streaming import incremental


def test_inventory_and_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/One.rpy").write_text("label start:\r\n    jump end\n")
    (tmp_path / "two.rpy").write_text("return")
    (tmp_path / "other.txt").write_text("no script")
    found = scripts.inventory(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.size for r in found.collect()} == {"One.rpy": 27, "two.rpy": 6}
    with pytest.raises(ValueError):
        scripts.inventory(spark, str(tmp_path), max_files=1)
    texts = scripts.verified(spark, str(tmp_path), found).select(scripts.stem(F.col("path")).alias("path"), F.col("content").cast("string").alias("text"))
    lines = {(r.path, r.line_no): r.line for r in scripts.physical_lines(texts).collect()}
    assert lines == {("one", 1): "label start:", ("one", 2): "    jump end", ("one", 3): "", ("two", 1): "return"}
    changed = found.withColumn("digest", F.lit("0"))
    with pytest.raises(Exception, match="changed since the inventory"):
        scripts.verified(spark, str(tmp_path), changed).collect()


def test_preferred_and_ambiguous(spark):
    rows = [("a", 1, "A.rpy", "x"), ("a", 0, "b/a.rpy", "y"), ("a", 0, "a/a.rpy", "z"), ("b", 2, "b.rpy", "x")]
    candidates = spark.createDataFrame(rows, "stem string, tier int, path string, digest string")
    assert {(r.stem, r.path) for r in scripts.preferred(candidates).collect()} == {("a", "a/a.rpy"), ("b", "b.rpy")}
    assert [tuple(r) for r in scripts.ambiguous(candidates).collect()] == [("a", 0, 2)]


def test_streams_agree_with_tables(spark, tmp_path):
    rows = [("u", "x", "2024-01-01 00:00:00"), ("u", "x", "2024-01-01 00:10:00"), ("u", "y", "2024-01-01 02:00:00"), ("v", "x", "2024-01-01 00:05:00")]
    table = spark.createDataFrame(rows, "user string, kind string, ts string").withColumn("ts", F.to_timestamp("ts"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert incremental.first_seen(table, key="user", digest="kind", at="ts").count() == 3
    assert {(r.user, r.n) for r in incremental.sessions(table, key="user", at="ts").collect()} == {("u", 2), ("u", 1), ("v", 1)}
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = (
        incremental.windowed_counts(stream, at="ts", kind="kind")
        .writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    whole = {tuple(r) for r in incremental.windowed_counts(table, at="ts", kind="kind").collect()}
    assert {tuple(r) for r in spark.table("windows").collect()} == whole and len(whole) == 2
