"""Columns that are computed once, however often what follows names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, keep: list, **columns: Column) -> DataFrame:
    """``keep`` and the named columns. A generator stands between them and what follows, so that projections aren't merged
    and costly expressions (split texts, token lists) aren't evaluated again for each mention or inside of lambdas."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
