"""URL rules by a sort-merge range join over reversed-host keys.

A host's labels, reversed and each followed by a low byte, make a key; a rule's
host and all its subdomains are then one interval of keys, and intervals nest.
Pages are range-partitioned and sorted by key. One sweep through a partition
keeps the stack of hosts whose interval is open. A host's paths are sorted and
each knows the next shorter one that it extends, so intervals of paths nest as
those of hosts do: the longest that a page's path starts with lies on the way up
from where the path would stand. A page takes the longest rule of the open hosts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.scratch import step, written

#: Rules that one sweep holds; a longer list takes a sweep a block of so many, about, whole hosts in each.
BLOCK_RULES = 500_000

#: verdict, host, path. Fixed values.
BASE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z folded. Path: from there up to ? or #. Both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)  # lazy: the first ://
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(host: str) -> str:
    return "".join(f"{label}\x01" for label in reversed(host.split(".")))


Best = tuple[int, int, str, bool, str]  # length of the rule, of its host's key, the rule, whether it blocks, the verdict


class Rules:
    """Rules (key, path, rule, verdict) by host key and path, of equal ones the one that blocks."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        rules = sorted(rules, key=lambda r: (r[0], r[1], r[3] != "block"))
        self.rules = [r for i, r in enumerate(rules) if not i or r[:2] != rules[i - 1][:2]]
        self.paths = [r[1] for r in self.rules]
        self.shorter = [-1] * len(self.rules)  # the longest rule of the same host whose path this one's extends
        self.keys: list[str] = []
        self.first: list[int] = []
        nested: list[int] = []
        for i, (key, path, *_) in enumerate(self.rules):
            if not self.keys or self.keys[-1] != key:
                self.keys.append(key)
                self.first.append(i)
                nested = []
            while nested and not path.startswith(self.paths[nested[-1]]):
                nested.pop()
            self.shorter[i] = nested[-1] if nested else -1
            nested.append(i)
        self.first.append(len(self.rules))

    def longest(self, host: int, path: str) -> Best | None:
        """The longest rule of a host, by its number, that ``path`` starts with."""
        low, high = self.first[host], self.first[host + 1]
        at = bisect_right(self.paths, path, low, high) - 1
        at = at if at >= low else -1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.shorter[at]
        if at < 0:
            return None
        key, _, rule, verdict = self.rules[at]
        return len(rule), len(key), rule, verdict == "block", verdict

    def sweep(self, pages: Iterator[tuple[str, str]]) -> Iterator[Best | None]:
        """The longest rule of each page (key, path), in ascending key order.

        A partition may begin inside intervals, so the stack starts with the hosts that are prefixes of the first key.
        """
        stack: list[int] = []
        at = None
        for key, path in pages:
            if at is None:
                labels = key.split("\x01")[:-1]
                for n in range(1, len(labels) + 1):
                    prefix = "".join(f"{x}\x01" for x in labels[:n])
                    host = bisect_right(self.keys, prefix) - 1
                    if host >= 0 and self.keys[host] == prefix:
                        stack.append(host)
                at = bisect_right(self.keys, key)
            while stack and not key.startswith(self.keys[stack[-1]]):
                stack.pop()
            while at < len(self.keys) and self.keys[at] <= key:
                if key.startswith(self.keys[at]):
                    stack.append(at)
                at += 1
            yield max((found for host in stack if (found := self.longest(host, path))), default=None)


def judge(pages: DataFrame, rules: DataFrame, *, otherwise: str = "allow") -> DataFrame:
    """pages(page_id, url, ..), rules(verdict, host, path) -> page_id, host, path, rule, verdict.

    One row per row of ``pages``. The longest rule (host and path together) that
    fits wins; of two as long, the one with the longer host, then the greater
    text, then block. Without a rule the verdict is ``otherwise``. Null urls have an
    empty host and path and no rule. Rules with a null field are left out.
    """
    slim = pages.select("page_id", F.col("url").cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    slim = slim.select("page_id", host.alias("host"), path.alias("path"))
    key = F.when(F.col("host") != "", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "\x01"), F.lit("\x01"))).otherwise(F.lit(""))
    none = F.lit(None).cast("string")
    slim = slim.select("page_id", "host", "path", key.alias("key"), none.alias("rule"), none.alias("verdict"), F.lit(0).alias("host_key"))
    listed = rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL").select("verdict", "host", "path").distinct()
    n = max(1, -(-listed.count() // BLOCK_RULES))
    with step() as keep:
        for k in range(n):
            slim = _swept(slim, listed.where(F.pmod(F.xxhash64("host"), F.lit(n)) == k))
            slim = written(slim, name="judged") if n > 1 else slim
        if n > 1:
            keep(slim)
    return slim.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def _swept(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` with rule, verdict and host_key (the length of the rule's key) of the longest of these rules, where it is longer than what they have."""
    shared = pages.sparkSession.sparkContext.broadcast(Rules([(key_of(r.host), r.path, r.host + r.path, r.verdict) for r in rules.toLocalIterator()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def feed():
            for batch in batches:
                if batch.num_rows:
                    pending.append(batch)
                    yield from zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)

        found: list[Best | None] = []
        for best in shared.value.sweep(feed()):
            found.append(best)
            if len(found) == pending[-1].num_rows:
                done = pending.pop()
                known = [rule and (len(rule), n, rule, verdict == "block", verdict) for rule, verdict, n in zip(*(c.to_pylist() for c in done.columns[4:]), strict=True)]
                tops = [max((x for x in pair if x), default=None) for pair in zip(known, found, strict=True)]
                columns = [pa.array([t and t[k] for t in tops], pa.string()) for k in (2, 4)]
                yield pa.RecordBatch.from_arrays([*done.columns[:4], *columns, pa.array([t[1] if t else 0 for t in tops], pa.int32())], names=done.schema.names)
                found = []

    ordered = pages.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key", "path")  # a hot host spreads by path and id
    return ordered.mapInArrow(run, pages.schema)
