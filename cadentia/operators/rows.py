"""Rows carried as one struct, so that no name which an operator gives meets a user's column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(df: DataFrame) -> DataFrame:
    """Each row as one struct column ``row``."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def of(name: str) -> Column:
    """A column of the carried row."""
    return F.col(f"row.`{name}`")
