"""Per-document text statistics and what is not prose (problem 3).

Each text gets a vector of statistics.  For each language, a robust mean and
covariance of prose are found over all texts: starting from medians and fixed least
deviations, rounds of concentration keep the texts nearest to the current centre
and take mean and covariance again (sums of products per language, added up by
Spark).  A text's squared Mahalanobis distance splits into one contribution per
statistic; texts beyond the cutoff, which comes from the distribution of all distances,
are named by the statistics that contribute most.

Defined results: null, empty and blank texts have n_words 0, null statistics, no
distance and no kind.  Repeated rows each get their own result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import FENCED, LANGS, table
from millrace.runtime import materialize, spread

STATS = ["mean_word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio", "list_share", "table_share", "repeat_ratio", "odd_word_ratio", "name_ratio"]
#: Least standard deviations, so that a statistic that is nearly constant in prose doesn't blow up the distance.
FLOOR = np.array([0.6, 0.02, 0.02, 0.2, 0.06, 0.07, 0.07, 0.06, 0.05, 0.1])
#: The direction in which a statistic speaks against prose: 1 upward, -1 downward, 0 both.
SIDE = np.array([0, 1, 1, -1, -1, 1, 1, 1, 1, 1])

BULLET = re.compile(r"^\s*(?:[-*+•‣◦▪·–—]\s+|\(?\d{1,3}[.)]\s+|\(?[a-zA-Z][.)]\s+|\(?[ivxIVX]{1,5}[.)]\s+|\[[ xX✓]?\]\s+|[│|]*\s*[├└]─*\s*|☐|☑|✓)")
WORD = re.compile(r"\b[^\W\d_]+(?:['’-][^\W\d_]+)*\b")
PIECE = re.compile(r"(?<=[.!?。！？])[ -]*|\n[ -]*| - | \| ")
CJK = re.compile(r"[぀-ヿ一-鿿]")
NAME = re.compile(r"\b\w*_\w+\b|\b[a-z]+[A-Z]\w*|\b[\w.-]+/[\w./-]+|\b[A-Z][a-z]+(?= \d+\.\d)")
GAP = re.compile(r"\S {2,}(?=\S)|\t")
END = re.compile(r"[.!?:;…。！？]['\")\]»”]*\s*$")
STRANGE, LATIN1 = re.compile("[�\x80-\x9f]"), re.compile("[\x80-¿ÃÂâåæçäãèéï]")
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
CONSONANTS = re.compile("[aeiouyáàâãäéèêëíìîïóòôõöúùûü]")
VOWELS = set("aeiouyáàâãäéèêëíìîïóòôõöúùûüæœ")


def _bare_entry(line: str) -> bool:
    """A short line that is no sentence."""
    return len(line) <= 60 and len(line.split()) <= 6 and not re.search(r"[.!?。！？]\s*$", line)


def _rows(lines: list[str]) -> list[bool]:
    """Which lines are rows of a block in which consecutive lines have the same columns."""
    mark = [False] * len(lines)
    for sep, least in (("|", 2), ("│", 2), ("\t", 1), (";", 1), (",", 1), (None, 1)):
        counts = []
        for x in lines:
            if sep in (None, ",", ";") and BULLET.match(x):
                n = 0
            elif sep is None:
                n = len(GAP.findall(x)) + (x[:3] == "   ")
                n = 1 if n >= 1 and len(x) - len(x.replace(" ", "")) > 0.2 * len(x) else 0
            else:
                n = x.count(sep)
                if sep in ",;" and n and (max(len(c.split()) for c in x.split(sep)) > 3 or x.rstrip().endswith(sep)):
                    n = 0
                if sep in "|│" and n and set(x) <= set("|│-+=:─┼┤├ "):
                    n = -1  # a rule fits any row
            counts.append(n)
        i = 0
        while i < len(lines):
            if counts[i] == 0 or counts[i] != -1 and counts[i] < least:
                i += 1
                continue
            j, want = i, 0
            while j < len(lines) and (counts[j] == -1 or counts[j] >= least and (not want or counts[j] == want or sep is None)):
                want = want or (counts[j] if counts[j] > 0 else 0)
                j += 1
            if j - i >= 3 and want:
                for k in range(i, j):
                    mark[k] = True
            i = max(j, i + 1)
    return mark


def shares(text: str) -> tuple[float, float]:
    """Shares of a text's characters in entries of enumerations and in rows of tables."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    sizes = [len(x.strip()) for x in lines]
    whole = sum(sizes) or 1
    rows = _rows(lines)
    in_table = sum(n for n, r in zip(sizes, rows) if r)
    in_list = 0
    run: list[int] = []

    def close() -> int:
        got = sum(sizes[k] for k in run) if len(run) >= 3 else 0
        run.clear()
        return got

    for i, x in enumerate(lines):
        if rows[i]:
            in_list += close()
            continue
        if BULLET.match(x) or _bare_entry(x):
            run.append(i)
            continue
        in_list += close()
        cells = [c.strip() for c in re.split(r"[,、;，]", x)]
        if len(cells) >= 6 and len(x) / len(cells) < 40 and np.mean([len(c.split()) <= 4 for c in cells]) > 0.9:
            in_list += sizes[i]
    in_list += close()
    return in_list / whole, in_table / whole


@lru_cache(100_000)
def unreadable(word: str) -> bool:
    """A word without vowels, with long runs of consonants, of great length, or of vowels alone."""
    v = sum(c in VOWELS for c in word)
    run = max(map(len, CONSONANTS.split(word)))
    return v == 0 or run >= 5 or len(word) > 28 or v > 0.75 * len(word) and len(word) > 5


def language_of(words: dict[str, int], text: str, common: dict[str, frozenset[str]]) -> tuple[str, float]:
    """The language with the most common words, and their share of the words (of the letters for Chinese and Japanese)."""
    cjk = CJK.findall(text)
    if len(cjk) > 0.2 * len(text.replace(" ", "")):
        lang = "ja" if sum("぀" <= c <= "ヿ" for c in cjk) > 0.1 * len(cjk) else "zh"
        marks = {c for w in common.get(lang, ()) for c in w}
        return lang, min(1.0, 1.6 * sum(c in marks for c in cjk) / len(cjk))
    best, share = "", -1.0
    n = sum(words.values()) or 1
    for lang in LANGS[:6]:
        own = common.get(lang, frozenset())
        got = sum(k for w, k in words.items() if w in own) / n
        if got > share:
            best, share = lang, got
    return best, share


def measure(text: str, common: dict[str, frozenset[str]]) -> tuple:
    """language, n_words, then the statistics in the order of STATS, and the share of readable characters."""
    text = text.replace("\r", "").replace("﻿", "").replace(" ", " ")
    prose = FENCED.sub("\n", text) if "```" in text else text
    if not prose.strip():
        prose = text
    bare = NAME.sub(" ", prose)
    words = WORD.findall(bare.lower())
    n_names = len(NAME.findall(prose))
    tally = Counter(words)
    lang, common_ratio = language_of(tally, bare, common)
    tight = "".join(prose.split())
    n = len(tight) or 1
    letters = sum(map(len, LETTERS.findall(tight)))
    digits = sum(map(len, DIGITS.findall(tight)))
    lines = [x for x in prose.split("\n") if x and not x.isspace()]
    size = sum(len(x) for x in lines) or 1
    ended = sum(len(x) for x in lines if END.search(x)) / size
    ls, ts = shares(prose)
    raw = prose.encode("utf-8", "replace")
    packed = len(zlib.compress(raw, 6)) / max(1, len(raw))
    repeat = max(0.0, 0.35 - packed) if len(raw) > 150 else 0.0
    if len(words) >= 8:
        top = max(tally.values()) / (len(words) + n_names)
        repeat = max(repeat, top - 0.2)
    pieces = Counter(p.strip() for p in PIECE.split(prose) if len(p.strip()) > 1)
    if pieces:
        piece, times = pieces.most_common(1)[0]
        if times >= 3 and times * len(piece) > 0.6 * sum(k * len(p) for p, k in pieces.items()):
            repeat = max(repeat, 0.5)
    cjk = lang in ("zh", "ja")
    latin = {w: k for w, k in tally.items() if not CJK.search(w)} if CJK.search(prose) else tally
    n_latin = sum(latin.values())
    odd_ratio = sum(k for w, k in latin.items() if len(w) >= 4 and unreadable(w)) / n_latin if n_latin >= 5 else 0.0
    strange = 0 if tight.isascii() else len(STRANGE.findall(tight))
    latin1 = 0 if tight.isascii() else len(LATIN1.findall(tight))
    if latin1 > 0.25 * n or strange > 0.03 * n:
        odd_ratio = max(odd_ratio, min(1.0, (latin1 + strange) / n * 2))
        common_ratio *= 0.2
    mean_len = float(np.mean([len(w) for w in words])) if words and not cjk else 5.0
    total = len(words) + n_names
    return (
        lang, total if not cjk else letters,
        min(mean_len, 30.0), (n - letters - digits) / n, digits / n, ended, common_ratio, ls, ts, repeat, odd_ratio, n_names / max(1, total) if not cjk else 0.0,
    )


def statistics(df: DataFrame, common: DataFrame, key: str = "rec_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of ``also``, language, n_words and STATS for each row."""
    lists = {r.language: frozenset(w.lower() for w in r.w) for r in common.groupBy("language").agg(F.collect_set("word").alias("w")).collect()}
    keys = [key, *also]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [measure(t, lists) if isinstance(t, str) and t and not t.isspace() else (None, 0, *[None] * len(STATS)) for t in b[text]]
            got = pd.DataFrame(rows, columns=["language", "n_words", *STATS])
            yield pd.concat([b[keys].reset_index(drop=True), got.astype(dict.fromkeys(STATS, float))], axis=1)

    return spread(df.select(*keys, text)).mapInPandas(run, f"{shape}, language string, n_words long, " + ", ".join(f"{s} double" for s in STATS))


Centre = dict[str, tuple[np.ndarray, np.ndarray]]  # by language: mean, inverse covariance


def _sums(stats: DataFrame, centre: Centre | None, cutoff: float) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of the statistics by language, over the texts within the cutoff."""
    k = len(STATS)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, g in b.dropna(subset=["language"]).groupby("language"):
                x = g[STATS].to_numpy(float)
                if centre is not None and lang in centre:
                    m, inv = centre[lang]
                    d = x - m
                    x = x[np.einsum("ij,jk,ik->i", d, inv, d) <= cutoff]
                elif centre is not None:
                    continue
                v = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                got[lang] = got.get(lang, 0) + v
        yield pd.DataFrame([(lang, i, float(y)) for lang, v in got.items() for i, y in enumerate(v)], columns=["language", "i", "v"])

    rows = stats.select("language", *STATS).mapInPandas(part, "language string, i int, v double").groupBy("language", "i").agg(F.sum("v").alias("v")).collect()
    flat: dict[str, np.ndarray] = {}
    for r in rows:  # a fixed number of sums for each of the few languages
        flat.setdefault(r.language, np.zeros(1 + k + k * k))[r.i] = r.v
    return {lang: (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)) for lang, v in flat.items()}


def prose_centre(stats: DataFrame, rounds: int = 3, cutoff: float = 40.0) -> Centre:
    """Robust mean and inverse covariance of prose for each language, over all texts."""
    cols = [F.percentile_approx(s, 0.5, 1000).alias(s) for s in STATS]
    med = {r.language: np.array([r[s] for s in STATS]) for r in stats.where(F.col("language").isNotNull()).groupBy("language").agg(*cols).collect()}
    # prose has little in lists and tables, whatever the median of a small or odd language
    centre: Centre = {}
    for lang, m in med.items():
        m = m.copy()
        m[[5, 6, 7, 8]] = np.minimum(m[[5, 6, 7, 8]], 0.02)
        centre[lang] = (m, np.diag(1 / (2.0 * FLOOR) ** 2))
    for _ in range(rounds):
        new: Centre = {}
        for lang, (n, s, ss) in _sums(stats, centre, cutoff).items():
            if n < 5 * len(STATS):
                new[lang] = centre[lang]
                continue
            m = s / n
            cov = ss / n - np.outer(m, m)
            new[lang] = (m, np.linalg.inv(cov + np.diag(FLOOR**2)))
        centre = {**centre, **new}
    return centre


def cutoff_of(stats: DataFrame, centre: Centre, tail: float = 0.002, core: float = 40.0) -> float:
    """The squared distance that prose passes with probability ``tail``.

    Distances are standardized by each language's covariance, so all languages share one distribution; their logarithms
    are nearly normal, and its median and upper quartile, which what isn't prose hardly moves, give the cutoff.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lang, g in b.dropna(subset=["language"]).groupby("language"):
                if lang in centre:
                    m, inv = centre[lang]
                    d = g[STATS].to_numpy(float) - m
                    q = np.einsum("ij,jk,ik->i", d, inv, d)
                    out.append(np.log(np.maximum(q[q <= core], 1e-6)))
            yield pd.DataFrame({"d": np.concatenate(out) if out else np.zeros(0)})

    r = stats.select("language", *STATS).mapInPandas(part, "d double").agg(F.percentile_approx("d", [0.5, 0.75], 10000).alias("q")).first()
    if not r.q:
        return core
    mid, upper = r.q
    return float(np.exp(mid + NormalDist().inv_cdf(1 - tail) * max(upper - mid, 0.1) / NormalDist().inv_cdf(0.75)))


def judge(lang: str, x: np.ndarray, centre: Centre, cutoff: float) -> tuple[float, np.ndarray, str | None]:
    """Squared distance from prose, contributions that add up to it, and the kind of what isn't prose.

    Only texts beyond the cutoff have a kind: that of the statistics that contribute most against prose.
    """
    m, inv = centre[lang]
    d = x - m
    c = d * (inv @ d)
    dist = float(c.sum())
    if dist <= cutoff:
        return dist, c, None
    against = dict(zip(STATS, np.where((SIDE == 0) | (d * SIDE > 0), np.maximum(c, 0), 0.0)))
    share = dict(zip(STATS, x))
    # entries that are one piece over and over, or words that can't be read, are no entries
    real = max(0.0, 1 - share["repeat_ratio"] / 0.5) * max(0.0, 1 - share["odd_word_ratio"] / 0.4)
    mostly = share["list_share"] + share["table_share"] >= 0.5
    score = {"list": against["list_share"] * real, "table": against["table_share"] * real}
    junk = sum(against[k] for k in ("common_ratio", "odd_word_ratio", "repeat_ratio", "mean_word_length"))
    if not mostly:  # in lists and tables, numbers and names are what the entries are made of
        junk += sum(against[k] for k in ("symbol_ratio", "digit_ratio", "name_ratio"))
        score = {}
    score["junk"] = junk
    kind = max(score, key=score.get)
    return dist, c, kind if score[kind] > 0.5 * cutoff else None


def name_kinds(stats: DataFrame, centre: Centre, cutoff: float, key: str = "rec_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Adds distance, contributions (statistic to share of the distance) and kind (null: prose or no text)."""
    keys = [key, *also]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[STATS].to_numpy(float)
            rows = []
            for i, lang in enumerate(b["language"]):
                if lang is None or lang not in centre:
                    rows.append((None, None, None))
                    continue
                dist, c, kind = judge(lang, x[i], centre, cutoff)
                rows.append((dist, dict(zip(STATS, map(float, c))), kind))
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=["distance", "contributions", "kind"])], axis=1)

    own = ", ".join(f"{s} double" for s in STATS)
    return stats.mapInPandas(run, f"{shape}, language string, n_words long, {own}, distance double, contributions map<string,double>, kind string")


def outliers(df: DataFrame, common: DataFrame, key: str = "rec_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    stats = materialize(statistics(df, common, key, text, also), "stats")  # used by every round
    centre = prose_centre(stats)
    return name_kinds(stats, centre, cutoff_of(stats, centre), key, also)


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(table(spark, sf_dir, "scored"), table(spark, sf_dir, "common_words"), also=("source",))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = outliers(table(spark, sf_dir, "scored"), table(spark, sf_dir, "common_words"))
    return got.where(F.col("kind").isNotNull()).select("rec_id", "kind")


QUERIES = {"p3_statistics": p3_statistics, "p3_found": p3_found}
