"""Stable keys and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and the first 20 hex digits of SHA-256 over the NUL-joined parts; a null part is empty text."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\0", *texts), 256), 1, 20))


def padded(number: Column, width: int = 12) -> Column:
    """A sort key: the number with leading zeros."""
    return F.lpad(number.cast("string"), width, "0")


def generation(df: DataFrame, key: str, digest: str, *, buckets: int = 4096) -> DataFrame:
    """One row ``generation``: a digest of all (key, digest) rows that doesn't depend on their order.

    Rows are hashed, hashes are sorted and hashed within ``buckets`` groups by their
    first digits, and the groups' digests once more, so no task holds all rows.
    """
    row = F.sha2(F.concat_ws("\0", F.col(key).cast("string"), F.col(digest)), 256)
    groups = df.select(row.alias("h")).groupBy(F.pmod(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), F.lit(buckets)).alias("b")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("g")
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "g"))), lambda x: x.g), "")
    return groups.agg(F.sha2(whole, 256).alias("generation"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and no blanks; nulls are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of ``canonical_json``."""
    return F.sha2(canonical_json(fields), 256)


def list_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and the first 20 hex digits of SHA-256 over the parts as a JSON list."""
    items = [F.regexp_replace(F.to_json(F.struct(p.alias("x")), {"ignoreNullFields": "false"}), r'^\{"x":(.*)\}$', "$1") for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")), 256), 1, 20))
