"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from millrace.runtime import spread

LANGS = ["en", "es", "fr", "de", "pt", "it", "zh", "ja"]
CODE_LANGS = ["python", "javascript", "rust", "go", "sql"]

FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
FENCED = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
INVISIBLE = str.maketrans(dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD], None))
SPACES = str.maketrans({" ": " ", "　": " ", "\r": None})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_by_batch(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``f`` on Arrow batches of ``df``, spread over all cores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b)

    return spread(df).mapInPandas(run, schema)


def tidy(text: str) -> str:
    """Line ends, odd spaces and invisible characters made plain; length may change."""
    return text.translate(SPACES).translate(INVISIBLE)
