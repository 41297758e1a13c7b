"""Repetition inside of a text (QF3, QS2, QS6): counts of n-grams, which need a hash table a text, in Arrow batches."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _grams_repeated(s: pd.Series) -> pd.Series:
    def one(t: str | None) -> float | None:
        if t is None:
            return None
        n = len(t) - 5  # the last run isn't counted
        return 1.0 - len({t[i : i + 5] for i in range(n)}) / n if n > 0 else 0.0

    return s.map(one, na_action=None).astype("float64")


def _penalty(s: pd.Series) -> pd.Series:
    def one(w: list | None) -> float | None:
        if w is None:
            return None
        w = list(w)
        scores = []
        for n in (3, 5, 10):
            total = len(w) - n  # the last run isn't counted
            if total > 0:
                most = max(Counter(zip(*(w[k : k + total] for k in range(n)))).values())
                if most < total:
                    scores.append(1 - most / total)
        return sum(scores) / len(scores) if scores else 1.0

    return s.map(one, na_action=None).astype("float64")


def _top_share(s: pd.Series) -> pd.Series:
    return s.map(lambda w: None if w is None else max(Counter(w).values()) / len(w) if len(w) else 0.0, na_action=None).astype("float64")


def char_repetition(c: Column) -> Column:
    """Share of runs of five characters that stood before in the text."""
    return F.pandas_udf(_grams_repeated, "double")(c)


def word_penalty(words: Column) -> Column:
    """QS2: one minus the share of the most frequent run, averaged over runs of 3, 5 and 10 words where positive; else 1."""
    return F.pandas_udf(_penalty, "double")(words)


def top_share(words: Column) -> Column:
    """Share of the most frequent word."""
    return F.pandas_udf(_top_share, "double")(words)
