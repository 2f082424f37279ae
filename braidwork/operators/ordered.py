"""Ranks and running totals over all rows in order, without a window over one partition.

Rows are dealt by ranges of the sort key and sorted within them. Each task counts
from its own start; what a range inherits from those before it is one row a
partition, summed on the driver and joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.operators.loops import written

_ADDED = ("part", "seq", "head", "place")


def _scan(segment: str | None, sums: Sequence[str], xors: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a partition's rows in order: its number, the row's number, whether its segment began with the partition, its place and totals in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, last, first_run = TaskContext.get().partitionId(), 0, None, True
        place, total = 0, dict.fromkeys([*[f"sum_{s}" for s in sums], *[f"xor_{x}" for x in xors]], 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            marks = batch.column(segment).to_numpy(zero_copy_only=False) if segment else np.zeros(n, np.int64)
            begins = np.append(last is None or marks[0] != last, marks[1:] != marks[:-1])
            begins[0] &= seq > 0  # the first rows of a partition may belong to the segment before
            at = np.flatnonzero(begins)
            run_of = np.cumsum(begins)  # 0: the segment carried into this batch
            head = (run_of == 0) & first_run
            first_run = first_run and not len(at)
            starts = np.append(0, at)
            places = np.arange(n) - starts[run_of] + np.where(run_of == 0, place, 0)
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(head), pa.array(places)]
            for name in total:
                add, back = (np.cumsum, np.subtract) if name.startswith("sum_") else (np.bitwise_xor.accumulate, np.bitwise_xor)
                values = batch.column(name[4:]).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = add(values)
                before = np.append(0, np.where(at > 0, upto[at - 1], 0))  # the total where each run begins; one may begin with the batch
                found = back(upto, before[run_of])
                carried = np.where(run_of == 0, total[name], 0)
                found = found + carried if back is np.subtract else found ^ carried
                columns.append(pa.array(found))
                total[name] = int(found[-1])
            seq, last, place = seq + n, marks[-1], int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *_ADDED, *total])

    return run


def ordered(rows: DataFrame, *keys: str | Column, segment: str | None = None, sums: Sequence[str] = (), xors: Sequence[str] = (), without: Sequence[str] = (), write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``rows`` with rank (from 0, in the order of ``keys``), place (from 0, within the segment) and totals up to and with the row.

    ``segment`` is a whole-number column without nulls whose equal rows lie side by side
    in that order; sum_c and xor_c are the totals of c in it, or over all rows
    where there is none. Keys that tie everywhere end up in one task: give a last
    key that tells rows apart. ``without`` names columns that only order. ``write`` writes a table and gives it back.
    """
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*without)
    totals = [*[f"sum_{s}" for s in sums], *[f"xor_{x}" for x in xors]]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema] + ["part int", "seq long", "head boolean", "place long", *[f"{t} long" for t in totals]])
    local = write(dealt.mapInArrow(_scan(segment, sums, xors), kinds))
    mark = F.col(segment) if segment else F.lit(0)
    ends = local.groupBy("part").agg(F.max_by(F.struct(mark.cast("long").alias("mark"), "head", "seq", (F.col("place") + 1).alias("place"), *totals), "seq").alias("end")).select("part", "end.*")
    carried, before, carry = [], 0, None
    for row in sorted(ends.collect()):  # a row a partition
        carried.append((row.part, before, *(carry or (None, *[0] * (1 + len(totals))))))
        ours = carry is not None and row.head and row.mark == carry[0]  # one segment fills the partition and goes on
        carry = (row.mark, row.place + (carry[1] if ours else 0), *[(row[t] + c if t.startswith("sum_") else row[t] ^ c) if ours else row[t] for t, c in zip(totals, carry[2:] if carry else [0] * len(totals), strict=True)])
        before += row.seq + 1
    kept = rows.sparkSession.createDataFrame(carried, ", ".join(["part int, before long, c_mark long, c_place long", *[f"c_{t} long" for t in totals]]))
    ours = F.col("head") & (F.col("c_mark") == mark)
    more = lambda c: F.when(ours, F.col(f"c_{c}")).otherwise(0)
    full = local.join(F.broadcast(kept), "part")
    added = {"rank": F.col("seq") + F.col("before"), "place": F.col("place") + more("place")}
    added |= {t: F.col(t) + more(t) if t.startswith("sum_") else F.col(t).bitwiseXOR(more(t)) for t in totals}
    return full.select(*dealt.columns, *[c.alias(k) for k, c in added.items()])
