"""Exact deduplication, balancing, mixing, splitting and statistics over records (DD, BAL, MIX, SPL, AG operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.bind import bind
from millrace.operators.rank import ranked, ranked_within
from millrace.runtime import materialize


def seeded(key: str, seed: int = 42) -> Column:
    """A reproducible random order: the same in any engine that has MD5."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def exact_duplicates(df: DataFrame, key: str, by: Column) -> DataFrame:
    """key, duplicate_of (the first record of the same content) and is_duplicate, null contents being no one's duplicates.

    The first key per content is a combined aggregate of digests, so only (digest, key) is shuffled; a hot digest is
    combined before the shuffle.
    """
    d = df.select(key, F.sha2(by, 256).alias("_h"))
    first = d.where("_h is not null").groupBy("_h").agg(F.min(key).alias("duplicate_of"))
    return d.join(first, "_h", "left").select(key, F.coalesce("duplicate_of", key).alias("duplicate_of"), F.coalesce(F.col("duplicate_of") != F.col(key), F.lit(False)).alias("is_duplicate"))


def first_n(df: DataFrame, by: str, order: list[Column], n: Column | int, salts: int = 64) -> DataFrame:
    """BAL2, BAL8: at most n rows of each group in the given order.

    Each of a group's salted parts is cut to n first, so a hot group isn't sorted whole.
    """
    part = Window.partitionBy(by, "_salt").orderBy(*order)
    some = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n)
    return some.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn", "_salt")


def upsample(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """BAL3: each group repeated round-robin in key order up to n rows; larger groups stay whole. Adds copy (0 for originals)."""
    size = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    rn = ranked_within(df, by, [key], "_rn").join(size, F.equal_null(F.col(by), F.col("_by")))
    copies = F.when(F.col("_rn") < F.lit(n) % F.col("_n"), F.floor(F.lit(n) / F.col("_n")) + 1).otherwise(F.floor(F.lit(n) / F.col("_n")))
    return rn.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(copies.cast("long"), F.lit(1)) - 1))).drop("_rn", "_n", "_by")


def temperature_weights(w: DataFrame, temperature: float) -> DataFrame:
    """MIX1: weights to the power 1/T, normalised, clamped to [0.01, 0.9]."""
    p = F.pow("weight", F.lit(1.0 / temperature))
    return w.withColumn("mixed", F.least(F.lit(0.9), F.greatest(F.lit(0.01), p / F.sum(p).over(Window.partitionBy("mix_name")))))


def as_of(left: DataFrame, right: DataFrame, at: str, since: str, value: str) -> DataFrame:
    """MIX2: the right side's latest value not later than the left side's time.

    Both sides are cut into ranges of time; each range is walked by its own task and begins with the last value of the
    ranges before (one row a range).
    """
    row = F.struct(*left.columns)
    both = left.select(F.col(at).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(F.col(since).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(row).schema[0].dataType).alias("_row"), F.col(value).alias("_v"))
    )
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    x = materialize(both.repartitionByRange(n, "_t").withColumn("_range", F.spark_partition_id()), "as-of")
    last = x.where("_v is not null").groupBy("_range").agg(F.max_by("_v", "_t").alias("_v"))
    ranges = x.select("_range").distinct().join(last, "_range", "left")
    before = ranges.select("_range", F.last("_v", True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # one row a range
    w = Window.partitionBy("_range").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    y = x.withColumn("_v", F.last("_v", True).over(w)).join(F.broadcast(before), "_range").where("_side = 1")
    return y.select("_row.*", F.coalesce("_v", "_before").alias(value))


def shingles(w: Column, width: int = 5) -> Column:
    """DD7: distinct hashes of the runs of ``width`` of the words ``w`` (a bound column); of the whole text if it is shorter."""
    n = F.size(w) - (width - 1)
    runs = F.slice(w, F.lit(1), F.greatest(n, F.lit(0)))
    for k in range(2, width + 1):
        runs = F.zip_with(runs, F.slice(w, F.lit(k), F.greatest(n, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    whole = F.array(F.xxhash64(F.array_join(w, " ")))
    return F.when(n < 1, whole).otherwise(F.array_distinct(F.transform(runs, lambda x: F.xxhash64(x))))


def _digested(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, shingle set and its digest of each text that is neither null nor empty; texts of white space alone are equal."""
    x = bind(df.where(F.col(text).isNotNull() & (F.col(text) != "")), [key], w=F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), "\\s+", " ")), " "))
    x = bind(x, [key], s=F.sort_array(shingles(F.col("w"), width)))
    return x.withColumn("_d", F.md5(F.col("s").cast("string")))


def shingle_sets(df: DataFrame, key: str, text: str, width: int = 5) -> DataFrame:
    """Each distinct shingle set once: its least key (the representative), the set s and its size n."""
    return materialize(_digested(df, key, text, width).groupBy("_d").agg(F.min(F.struct(key, "s")).alias("x")).select("x.*").withColumn("n", F.size("s")), "shingles")


def shingle_classes(df: DataFrame, key: str, text: str, width: int = 5) -> DataFrame:
    """key and class (the representative in ``shingle_sets``) of each text that is neither null nor empty."""
    d = materialize(_digested(df, key, text, width).select(key, "_d"), "classes")
    return d.join(d.groupBy("_d").agg(F.min(key).alias("class")), "_d").select(key, "class")


def jaccard_pairs(df: DataFrame, key: str, text: str, t: float = 0.8, width: int = 5) -> DataFrame:
    """DD11: pairs a < b of different texts with Jaccard similarity of at least t, exactly.

    Equal shingle sets are joined once (by their least key); ``shingle_classes`` tells which records they stand for.
    """
    return similar_sets(shingle_sets(df, key, text, width), key, t)


def similar_sets(s: DataFrame, key: str, t: float = 0.8) -> DataFrame:
    """Pairs a < b of ``shingle_sets`` with Jaccard similarity of at least t.

    Shingles are ordered by rarity; two sets within the threshold share one of the first n - ceil(t n) + 1 of each,
    so only those are joined.
    """
    flat = s.select(key, "n", F.explode("s").alias("h"))
    df_ = flat.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    # shingles of one set only can't meet anything, but keep their place in the order: they come first
    rare = flat.join(df_, "h").groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("o"))
    lead = F.col("n") - F.ceil(F.col("n") * t - 1e-9).cast("int") + 1 - (F.col("n") - F.size("o"))
    pre = rare.where(lead > 0).select(key, "n", F.explode(F.slice("o", F.lit(1), F.least(lead, F.size("o")))).alias("p")).select(key, "n", "p.h")
    a, b = pre.select(F.col(key).alias("a"), F.col("n").alias("na"), "h"), pre.select(F.col(key).alias("b"), F.col("n").alias("nb"), "h")
    cand = a.join(b, "h").where("a < b").where(F.least("na", "nb") >= F.greatest("na", "nb") * t - 1e-9).select("a", "b").distinct()
    x = cand.join(s.select(F.col(key).alias("a"), F.col("s").alias("_x")), "a").join(s.select(F.col(key).alias("b"), F.col("s").alias("_y")), "b")
    both = F.size(F.array_intersect("_x", "_y"))
    return x.withColumn("similarity", both / (F.size("_x") + F.size("_y") - both)).where(F.col("similarity") >= t).select("a", "b", "similarity")


def greedy_keep(nodes: DataFrame, pairs: DataFrame, key: str, few: int = 1 << 20) -> DataFrame:
    """Keys that a pass in key order keeps, dropping each that is similar to a kept earlier one.

    Rounds on the pair list alone: a record without an undecided or kept earlier partner is kept, its later partners go.
    Each round decides at least the least undecided key, so the rounds end; long chains of versions take many, so once
    at most ``few`` pairs are undecided, one task passes over them in key order.
    """
    edges = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges")
    dropped = None
    while edges.count() > few:
        kept = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = materialize(edges.join(kept, "a", "left_semi").select("b").distinct(), "gone")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        edges = materialize(edges.join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti"), "edges")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: set = set()
        for p in batches:
            new = []
            for a, b in zip(p["a"].tolist(), p["b"].tolist()):  # all pairs that could drop a came before
                if a not in out and b not in out:
                    out.add(b)
                    new.append(b)
            yield pd.DataFrame({"b": pd.Series(new, dtype=p["b"].dtype)})

    rest = edges.repartition(1).sortWithinPartitions("a", "b").mapInPandas(walk, f"b {edges.schema['b'].dataType.simpleString()}")
    dropped = rest if dropped is None else dropped.unionByName(rest)
    return nodes.select(key).join(dropped.distinct().select(F.col("b").alias(key)), key, "left_anti")


def index_percentile(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """AG2: sorted values at index int(n p). Equal values are counted first, so only different ones are put in order."""
    g = ranked(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c")), [value], "_r", {"_before": "_c"})
    n = g.agg(F.sum("_c").alias("_n"))
    x = g.crossJoin(F.broadcast(n))  # one row
    at = {p: F.floor(F.col("_n") * p) for p in shares}
    cols = [F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_c")), F.col(value))).alias(f"p{int(p * 100)}") for p, i in at.items()]
    return x.agg(F.min(value).alias("least"), *cols, F.max(value).alias("most"), F.round(F.sum(F.col(value) * F.col("_c")) / F.sum("_c"), 6).alias("mean"))
