"""Script archives as tables: the index of a version-3 archive, and the members it names."""

from __future__ import annotations

import io
import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an archive begins with. Fixed value.
HEADER = b"RPA-3.0 "

#: Bytes of an index, unpacked, at most.
MOST_INDEX = 64 << 20


class _Plain(pickle.Unpickler):
    """Reads numbers, texts, bytes, lists, tuples and dicts; anything that names a class is refused."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"an archive index may not name {module}.{name}")


def read_index(content: bytes) -> list[tuple[str, int, int, bytes]]:
    """(member, offset, length, prefix) in order of name; ValueError for what is no archive."""
    if not content.startswith(HEADER):
        raise ValueError("no archive of version 3")
    line = content[: content.index(b"\n")]
    offset, key = int(line[8:24], 16), 0
    for part in line[25:].split():
        key ^= int(part, 16)
    if not 0 < offset < len(content):
        raise ValueError("the index lies outside the archive")
    unpacker = zlib.decompressobj()
    packed = unpacker.decompress(content[offset:], MOST_INDEX)
    if unpacker.unconsumed_tail:
        raise ValueError("the index is too large")
    found = []
    for name, parts in _Plain(io.BytesIO(packed), encoding="latin-1").load().items():
        name = name.decode() if isinstance(name, bytes) else name
        start, length, *prefix = parts[0]
        start, length = start ^ key, length ^ key
        head = prefix[0] if prefix else b""
        head = head.encode("latin-1") if isinstance(head, str) else head
        if ".." in name.split("/") or start < 0 or length < len(head) or start + length - len(head) > len(content):
            raise ValueError(f"{name}: the member lies outside the archive")
        found.append((name, start, length, head))
    return sorted(found)


def members(spark: SparkSession, path: str, *, pattern: str = "*.rpa", suffix: str = "") -> DataFrame:
    """(archive, member, size, content, digest, fault) of every archive below ``path``; one whose index can't be read is a row with its fault alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(archive, name, n, head + content[a : a + n - len(head)], None) for name, a, n, head in read_index(content) if name.endswith(suffix)]
                except (ValueError, pickle.UnpicklingError, zlib.error, IndexError, TypeError, AttributeError, EOFError) as fault:
                    rows = [(archive, None, None, None, str(fault))]
                yield pd.DataFrame(rows, columns=["archive", "member", "size", "content", "fault"])

    found = files.mapInPandas(run, "archive string, member string, size long, content binary, fault string")
    return found.select("archive", "member", "size", "content", F.sha2("content", 256).alias("digest"), "fault")
