"""Ranks and running totals in order, with tables of this subpackage's steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from braidwork.llm.scratch import written
from braidwork.operators import ordered as library


def ordered(rows: DataFrame, *keys: str | Column, name: str = "ordered", **options) -> DataFrame:
    """The library's ``ordered``, written under ``name`` in the step that is open."""
    return library.ordered(rows, *keys, write=lambda df: written(df, name=name, release=True), **options)
