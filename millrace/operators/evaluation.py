"""Metrics of answers, losses, runs and choices (EV2 to EV8, WN1 to WN3, MIX4, MIX5, VA3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of questions, and kinds of tasks by their marks.
QUESTIONS = ["what", "how", "why", "when", "where", "who"]
TASKS = {"math": ["calculate", "solve", "compute", "math"], "coding": ["write code", "implement", "function", "debug"], "reasoning": ["explain", "why", "analyze", "think"], "writing": ["write", "essay", "summary", "compose"], "factual": ["what is", "who is", "when", "where"]}


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """EV3: of word sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fluency(c: Column) -> Column:
    """EV3."""
    w = F.filter(F.split(c, "\\s+"), lambda x: x != "")
    return F.when(F.size(w) == 0, 0.0).otherwise(F.when(F.length(c) < 10, 0.5).otherwise(1.0) * F.when(F.size(w) != F.size(F.array_distinct(w)), 0.9).otherwise(1.0))


def relevance(prompt: Column, answer: Column) -> Column:
    """EV3: the prompt's words in the answer, counted twice if the prompt asks a question."""
    share = F.size(F.array_intersect(prompt, answer)) / F.size(prompt)
    asks = F.arrays_overlap(prompt, F.array(*map(F.lit, QUESTIONS)))
    return F.when(F.size(prompt) == 0, 0.0).otherwise(F.least(F.lit(1.0), share * F.when(asks, 2).otherwise(1)))


def category(c: Column) -> Column:
    """EV5: the first kind of task one of whose marks is there; general else."""
    low, out = F.lower(c), None
    for k, ws in TASKS.items():
        hit = F.greatest(*(low.contains(w).cast("int") for w in ws)) == 1
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise("general")


def answer(c: Column, form: str) -> Column:
    """EV5: the answer in a response of a form (json, xml, markdown); the whole response, trimmed, if it isn't of it."""
    got = {"json": F.when(F.try_parse_json(c).isNotNull(), F.coalesce(F.get_json_object(c, "$.answer"), F.lit(""))), "xml": F.nullif(F.regexp_extract(c, "(?s)<answer>(.*?)</answer>", 1), F.lit("")), "markdown": F.nullif(F.regexp_extract(c, "(?s)```(?:json)?\\s*(.*?)```", 1), F.lit(""))}
    return F.trim(F.coalesce(got[form], c)) if form in got else F.trim(c)


def complies(c: Column, form: str) -> Column:
    """EV5."""
    return {"json": F.try_parse_json(c).isNotNull(), "xml": c.contains("<response>") & c.contains("</response>"), "markdown": c.contains("```")}.get(form, F.lit(True))


def first_number(c: Column) -> Column:
    """EV5: what a solution is compared by."""
    return F.regexp_extract(c, "-?\\d+\\.?\\d*", 0)


def steps(c: Column) -> Column:
    """EV5: numbered or bulleted lines, and sentences begun with First, Then and the like."""
    return F.regexp_count(c, F.lit("(?:\\d+\\.|[-*])\\s*(.+)")) + F.regexp_count(c, F.lit("(?i)\\b(First|Second|Third|Then|Next|Finally)\\s*[:.]?\\s*(.+)"))


def pass_at_k(df: DataFrame, by: str, passed: Column, k: int) -> DataFrame:
    """EV4: the chance that one of k drawn tries passes, by ``by``: 1 - C(n - c, k) / C(n, k)."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(passed.cast("long")).alias("c"))
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (F.col("n") - F.col("c") - i) / (F.col("n") - i))
    return g.select(by, "n", "c", F.when(F.col("n") < k, F.when(F.col("c") > 0, 1.0).otherwise(0.0)).when(F.col("n") - F.col("c") < k, 1.0).otherwise(1 - miss).alias("pass_at_k"))


def window_perplexity(df: DataFrame, by: str, order: list[str], loss: str, size: int, stride: int) -> DataFrame:
    """EV2: exp of the mean loss of windows of ``size`` entries every ``stride``; infinite from a mean of 100."""
    w = Window.partitionBy(by).orderBy(*order)
    x = df.select(by, loss, (F.row_number().over(w) - 1).alias("_at"))
    each = x.select(by, loss, F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / stride).cast("int")), F.expr(f"int(_at div {stride})"))).alias("window"))
    m = each.groupBy(by, "window").agg(F.avg(loss).alias("m"))
    return m.select(by, "window", F.when(F.col("m") >= 100, F.lit(float("inf"))).otherwise(F.exp("m")).alias("perplexity"))


def early_stop(df: DataFrame, by: str, order: list[str], loss: str, patience: int = 3, delta: float = 0.01) -> DataFrame:
    """WN3: by run, the best loss, its step, and the step at which ``patience`` steps without an improvement of ``delta`` end it
    (null if none). A run's steps are folded by one task."""
    kind = df.schema[by].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        best, best_at, wait, stop = float("inf"), -1, 0, None
        for i, v in enumerate(pdf.sort_values(order)[loss]):
            if pd.isna(v):
                continue
            if v < best - delta:
                best, best_at, wait = v, i, 0
            else:
                wait += 1
                if wait >= patience:
                    stop = i
                    break
        return pd.DataFrame({by: [pdf[by].iloc[0]], "best": [best], "best_at": [best_at], "stopped_at": pd.array([stop], "Int64")})

    return df.select(by, *order, loss).groupBy(by).applyInPandas(fold, f"{by} {kind}, best double, best_at long, stopped_at long")


def pairwise(df: DataFrame, task: str, who: str, score: str) -> DataFrame:
    """EV7: wins, ties and share by ordered pair of competitors that did the same task; competitors are few."""
    m = df.groupBy(task, who).agg(F.round(F.avg(score), 9).alias("s"))
    a, b = m.select(task, F.col(who).alias("a"), F.col("s").alias("sa")), m.select(task, F.col(who).alias("b"), F.col("s").alias("sb"))
    g = a.join(b, task).where("a < b").groupBy("a", "b").agg(F.sum((F.col("sa") > F.col("sb")).cast("long")).alias("wins_a"), F.sum((F.col("sa") < F.col("sb")).cast("long")).alias("wins_b"), F.count("*").alias("n"))
    return g.withColumn("rate_a", F.col("wins_a") / F.col("n"))


def weighted_choice(draws: DataFrame, u: Column, weights: DataFrame, name: str, weight: str) -> DataFrame:
    """MIX4: a draw's ``u`` in [0, 1) met with the range of cumulative weight it falls into. Weights are settings: a few rows."""
    w = Window.orderBy(name)
    total = Window.partitionBy()
    r = weights.where(F.col(weight) > 0).select(name, (F.sum(weight).over(w) / F.sum(weight).over(total)).alias("_hi"), ((F.sum(weight).over(w) - F.col(weight)) / F.sum(weight).over(total)).alias("_lo"))
    return draws.withColumn("_u", u).join(F.broadcast(r), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_u", "_lo", "_hi")


def weighted_order(u: Column, weight: Column) -> Column:
    """MIX5: the order that makes the first n rows a sample without replacement by weight: least -ln(u) / w first."""
    return -F.log(u) / weight


def uniform(key: Column, seed: int = 42) -> Column:
    """A number in (0, 1) from a key, the same in any engine that has MD5."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
