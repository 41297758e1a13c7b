"""Cleaning and normalising text: Column in, Column out, all JVM-side (CLN operators)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
WORD = "[\\p{L}\\p{N}_]+"


def normalize_whitespace(c: Column) -> Column:
    """CLN1: CRLF and CR become LF, a tab four spaces, a no-break space a space; the byte order mark goes."""
    for a, b in (("\r\n", "\n"), ("\r", "\n"), ("\t", "    "), ("\u00a0", " "), ("\ufeff", "")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_control(c: Column) -> Column:
    """CLN2."""
    return F.regexp_replace(c, CONTROL, "")


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else None, na_action=None)


def normalize_unicode(c: Column) -> Column:
    """CLN3: NFC. Python sees only texts that aren't plain ASCII."""
    odd = F.when(c.rlike("[^\\x00-\\x7f]"), c)
    return F.coalesce(F.pandas_udf(_nfc, "string")(odd), c)


def strip_tags(c: Column) -> Column:
    """CLN4."""
    return F.regexp_replace(c, "<[^>]+>", "")


def trim(c: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def collapse_blank_lines(c: Column, most: int = 2) -> Column:
    """CLN5: at most ``most`` blank lines in a row."""
    lines = F.split(c, "\n", -1)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("blank"))

    def step(acc: Column, x: Column) -> Column:
        blank = F.when(F.trim(F.regexp_replace(x, "\\s", "")) == "", acc["blank"] + 1).otherwise(F.lit(0))
        return F.struct(F.when(blank > most, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"), blank.alias("blank"))

    return F.aggregate(lines, start, step, lambda acc: F.array_join(acc["out"], "\n"))


def clean(c: Column, html: bool = False) -> Column:
    """CLN6: Unicode form, white space, control characters, tags if asked, blank lines, trim."""
    c = strip_control(normalize_whitespace(normalize_unicode(c)))
    return trim(collapse_blank_lines(strip_tags(c) if html else c))


def clean_html(c: Column) -> Column:
    """CLN8: scripts, styles, comments and tags go, six entities are decoded, white space collapses."""
    c = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    c = F.regexp_replace(F.regexp_replace(c, "(?s)<!--.*?-->", ""), "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return trim(F.regexp_replace(c, "\\s+", " "))


def paragraphs(c: Column) -> Column:
    """CLN9: pieces between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "\\n\\s*\\n", -1), trim), lambda x: x != "")


def squeeze(c: Column) -> Column:
    """CLN11: white-space runs become one space; the form that exact hashes are taken of."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def words(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[.!?]+", -1), trim), lambda x: x != "")


def count_of(c: Column, sign: str) -> Column:
    """How often a single character stands in a text."""
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def document_text(*columns: str) -> Column:
    """The first column that is neither null nor empty (``or`` chain)."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def url_kind(c: Column) -> Column:
    """CLN12: kind of an image's address; paths count as local whether or not there is a file."""
    u = F.trim(c)
    return F.when(u.rlike("^https?://"), "http").when(u.startswith("s3://"), "s3").when(u.startswith("/") | u.startswith("file://"), "local").otherwise("unknown")
