"""Places of a pattern's matches in a text, with DataFrame functions, in time linear in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values summed one after another; sums of blocks are then summed likewise. A list that grows by one is copied each time, so it has to be short.
BLOCK = 128

_MARK = "\x01"


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _appended(values: Column, step) -> Column:
    """step(total, value) -> (total after the value, what is listed for it); the list."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def merge(t: Column, x: Column) -> Column:
        following, listed = step(t.at, x)
        return F.struct(following.cast("long").alias("at"), F.array_append(t.out, listed.cast("long")).alias("out"))

    return F.aggregate(values, start, merge).out


def running(values: Column) -> Column:
    """The sums of a list of whole numbers up to and with each of them."""

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: _appended(F.slice(v, i * BLOCK + 1, BLOCK), lambda at, x: (at + x, at + x)))

    def joined(sums: Column) -> Column:
        begins = _appended(sums, lambda at, block: (at + F.element_at(block, -1), at))
        return F.flatten(F.zip_with(sums, begins, lambda block, begin: F.transform(block, lambda x: x + begin)))

    return let(values, lambda v: F.when(F.size(v) == 0, v.cast("array<bigint>")).otherwise(let(blocks(v), joined)))


def cut(text: Column, pattern: Column) -> Column:
    """``text`` cut at its matches of group 1 of ``pattern``, leftmost first: what lies before the first, the first, what lies between, and so on."""
    clean = F.translate(text, _MARK, "\x02")
    return F.split(F.regexp_replace(clean, pattern, F.lit(f"{_MARK}$1{_MARK}")), _MARK)


def places(parts: Column, size) -> Column:
    """array<struct<a, b, s>> of the matches in ``parts`` of ``cut``: where each begins and ends, counted by size(part, whether it is a match), and the match. Empty matches are none."""

    def listed(p: Column) -> Column:
        counted = F.transform(p, lambda x, i: size(x, i % 2 == 1).cast("long"))
        found = let(running(counted), lambda s: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda k: F.struct(F.get(s, k - 1).alias("a"), F.get(s, k).alias("b"), F.get(p, k).alias("s"))))
        return F.when(F.size(p) > 2, F.filter(found, lambda m: m.s != ""))

    return F.coalesce(let(parts, listed), F.array().cast("array<struct<a:bigint,b:bigint,s:string>>"))
