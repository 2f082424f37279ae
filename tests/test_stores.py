import pickle
import zlib

from braidwork.operators import models
from braidwork.sources import archives, stores


def _archive(members, key=0x42424242):
    body, index = b"", {}
    at = len(archives.HEADER) + 16 + 1 + 8 + 1
    for name, content in members.items():
        index[name] = [(at + len(body) ^ key, len(content) ^ key, content[:2])]
        body += content[2:]
    header = archives.HEADER + b"%016x %08x\n" % (at + len(body), key)
    return header + body + zlib.compress(pickle.dumps(index))


def test_archives(spark, tmp_path):
    (tmp_path / "a.rpa").write_bytes(_archive({"x/one.rpy": b"label start:\n", "two.txt": b"hello"}))
    (tmp_path / "b.rpa").write_bytes(b"no archive")
    (tmp_path / "c.rpa").write_bytes(archives.HEADER + b"%016x %08x\n" % (34, 0) + zlib.compress(b"cos\nsystem\n(S'true'\ntR."))
    rows = archives.members(spark, str(tmp_path)).collect()
    assert {(r.member, bytes(r.content)) for r in rows if r.member} == {("x/one.rpy", b"label start:\n"), ("two.txt", b"hello")}
    assert sorted(r.fault for r in rows if r.fault) == ["an archive index may not name os.system", "no archive of version 3"]
    assert [r.member for r in archives.members(spark, f"{tmp_path}/a.rpa", suffix=".rpy").collect()] == ["x/one.rpy"]


def test_generations(spark, tmp_path):
    path = str(tmp_path / "store")
    assert stores.publish(spark.range(3), path, 1) == 3 and stores.publish(spark.range(5), path, 2) == 5
    spark.range(9).write.parquet(f"{path}/data/{3:012d}")  # written, never named
    assert stores.current(spark, path).count() == 5 and stores.generations(spark, path).count() == 2
    for k, n in enumerate((1, 4)):
        stores.export(spark.createDataFrame([(2, None), (1, "b"), (3, "c")], "k int, a string").repartition(n), str(tmp_path / f"out{k}"), ["k"])
    lines = [[r.value for r in spark.read.text(str(tmp_path / f"out{k}")).orderBy("value").collect()] for k in (0, 1)]
    assert lines[0] == lines[1] == ['{"a":"b","k":1}', '{"a":"c","k":3}', '{"a":null,"k":2}']


def test_corrections(spark):
    boundaries = spark.createDataFrame([(1, True), (2, False), (3, True)], "k int, accepted boolean")
    fixes = spark.createDataFrame([(1, "merge"), (2, "merge"), (9, "split")], "k int, action string")
    assert {r.k: (r.accepted, r.status) for r in models.corrected(boundaries, fixes, "k").collect()} == {1: (False, "applied"), 2: (False, "rejected"), 3: (True, "none"), 9: (None, "orphaned")}
