"""Vector search, fusion, reranking and chunking (VS, RT, RR, RG, EM operators)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rank import ranked_within


def knn(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, metric: str = "cosine", block: int = 2048) -> DataFrame:
    """VS1, VS2: for each query its k nearest rows (itself left out), exactly: query, neighbour, score, rank.

    Rows and queries are cut into blocks of bounded size; each pair of blocks is one matrix product, from which the best k
    of each query in the block survive. Scores are similarities (cosine, dot) or negative distances (euclidean).
    Null vectors are left out; a zero vector has cosine 0 with all.
    """
    kind = rows.schema[key].dataType.simpleString()

    def blocks(df: DataFrame, side: str) -> DataFrame:
        df = df.where(F.col(vector).isNotNull()).select(key, vector)
        n = max(1, -(-df.count() // block))
        return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(f"{side}b")).agg(F.collect_list(F.struct(key, vector)).alias(side)), n

    (left, nq), (right, nr) = blocks(queries, "q"), blocks(rows, "r")
    spark = rows.sparkSession
    pairs = spark.range(nq * nr).select(F.expr(f"int(id div {nr})").alias("qb"), F.expr(f"int(id % {nr})").alias("rb"))
    met = pairs.join(left, "qb").join(right, "rb")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, r in zip(b["q"], b["r"]):
                qk, rk = [x[key] for x in q], np.array([x[key] for x in r])
                a, c = np.array([x[vector] for x in q], np.float64), np.array([x[vector] for x in r], np.float64)
                if metric == "cosine":
                    na, nc = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(c, axis=1, keepdims=True)
                    s = (a / np.where(na == 0, 1, na)) @ (c / np.where(nc == 0, 1, nc)).T
                elif metric == "dot":
                    s = a @ c.T
                else:
                    s = -np.sqrt(np.maximum((a**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * a @ c.T, 0))
                for i, x in enumerate(qk):
                    own = np.where(rk == x, -np.inf, s[i])
                    near = np.round(own, 9)
                    at = np.lexsort((rk, -near))[:k]
                    out += [(x, rk[j], float(own[j]), float(near[j])) for j in at if np.isfinite(own[j])]
            yield pd.DataFrame(out, columns=["query", "neighbour", "score", "near"])

    # blocks cut and blocks meet by the same order: rounded score, then the neighbour's key
    got = met.mapInPandas(best, f"query {kind}, neighbour {kind}, score double, near double")
    w = Window.partitionBy("query").orderBy(F.desc("near"), "neighbour")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("near")


def hash_embedding(c: Column, dims: int = 384) -> Column:
    """EM1: byte i mod 32 of the text's SHA-256, scaled to [-1, 1), for each dimension."""
    digest = F.sha2(c, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") - 128) / 128.0)


def token_chunks(df: DataFrame, keep: list[str], tokens: str, size: int = 512, stride: int = 462, least: int = 128) -> DataFrame:
    """RG1: keep, chunk and w: runs of ``size`` tokens every ``stride``; a tail shorter than least // 4 joins the run before.

    Starts are exploded before tokens are sliced, so a token list is made once, however many chunks it gives.
    """
    n = F.size(tokens)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda i: (i == 0) | (n - i >= least // 4))
    x = df.select(*keep, tokens, F.posexplode(starts).alias("chunk", "_i"))
    # the last start is the one after which no other has tokens enough
    last = (F.size(tokens) - F.col("_i") - stride) < least // 4
    to = F.when(last & (F.size(tokens) - F.col("_i") < size + least // 4), F.size(tokens) - F.col("_i")).otherwise(F.lit(size))
    return x.select(*keep, "chunk", F.slice(tokens, F.col("_i") + 1, to).alias("w"))


def overlap_score(query: Column, doc: Column) -> Column:
    """RR1: shared words over the query's words."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, doc)) / F.size(F.array_distinct(query))).otherwise(0.0)


def length_score(query: Column, doc: Column) -> Column:
    """RR3."""
    return F.when(doc < query, doc / query).when(doc > query * 10, 0.5).otherwise(1.0)


def within_budget(df: DataFrame, group: str, order: list[Column | str], size: str, budget: int) -> DataFrame:
    """RT3: the longest prefix of each group, in a unique order, whose sizes add up to at most the budget."""
    x = ranked_within(df, group, order, "_at", {"_before": size})
    return x.withColumn("running", F.col("_before") + F.coalesce(size, F.lit(0))).where(F.col("running") <= budget).drop("_at", "_before")
