"""Mixing sources to target shares of the total tokens (problem 8).

The size of a mix is the largest at which every source can give its share with each
text used at most ``max_repeats`` times.  A source's quota is some full passes over
its texts and the start of one more, cut where the running sum of tokens meets the
quota.  The texts of each pass form blocks; a splitting tree halves the output
shards again and again and splits each source's exact number of blocks between the
halves by a multivariate hypergeometric draw, so every shard knows how many blocks
of which source it gets.  Shards then draw disjoint runs of permuted blocks and
shuffle inside.

Running sums and ranks are taken in buckets of nearly equal size (quantiles of the
order key) and joined with the buckets' prefix sums, so a source that holds a third
of all texts is spread over many tasks.

Defined results: texts without tokens (null, empty) are never chosen; a source that
is missing from the texts, has weight 0, a null weight or no repeats left gives
nothing, is reported with its target, and leaves the others in proportion.
Repeated rows are texts of their own.  Null sources match no mix.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.tokens import TOKENIZER, count_tokens
from millrace.runtime import materialize

MOST_BLOCKS = 2048  # blocks of a source and pass, whatever its size: what the tree is drawn over and sent to all tasks
MOST_SHARDS = MOST_BLOCKS // 4  # of a mix, so that every shard gets blocks; beyond it shards grow with the mix
BUCKET_ROWS = 100_000  # rows in a bucket of the order key, while BUCKETS allow it
BUCKETS = 256, 2048  # of the order key: least and most


def split(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of each source's blocks by shard: row s holds the blocks of each source in shard s; columns add up to ``blocks``.

    Each node of the tree gives its left half of the shards a number of blocks in proportion to the shards, and draws
    which sources they come from without replacement.
    """
    if shards == 1:
        return blocks[None, :]
    left = shards // 2
    n = int(blocks.sum())
    take = min(n, int(round(n * left / shards)))
    drawn = rng.multivariate_hypergeometric(blocks, take, method="marginals") if n else np.zeros_like(blocks)
    return np.concatenate([split(drawn, left, rng), split(blocks - drawn, shards - left, rng)])


def plan_quotas(weights: dict[str, tuple[float, int]], tokens: dict[str, int]) -> tuple[float, dict[str, float]]:
    """Total tokens of the mix and each source's quota. weights: source -> (weight, max_repeats)."""
    whole = sum(w for w, _ in weights.values() if w and w > 0)
    share = {s: w / whole for s, (w, m) in weights.items() if w and w > 0 and m and m > 0 and tokens.get(s)} if whole > 0 else {}
    if not share:
        return 0.0, {}
    # sources that can give something keep their ratios; the scarcest one sets the size
    total = min(weights[s][1] * tokens[s] / f for s, f in share.items())
    return total, {s: total * f for s, f in share.items()}


def mix(docs: DataFrame, mixes: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", tokenizer: str = TOKENIZER, seed: int = 11, shard_tokens: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """The chosen texts with their repeats, shards and places, and the shares: two frames."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    sizes = count_tokens(docs, text, (key, source), tokenizer).where(f"n_tokens > 0 and `{source}` is not null").withColumnRenamed(source, "source")
    settings = [r for r in mixes.select("mix_name", "name", "weight", "max_repeats", "sampling").collect() if r.mix_name is not None and r.name is not None]  # settings, not data
    tokens = {r.source: r.t for r in sizes.join(F.broadcast(mixes.select(F.col("name").alias("source")).distinct()), "source").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # one row a configured source
    by_mix: dict[str, dict[str, tuple[float, int]]] = {}
    sampling: dict[tuple[str, str], str] = {}
    for r in settings:
        by_mix.setdefault(r.mix_name, {})[r.name] = (float(r.weight or 0.0), int(r.max_repeats or 0))
        sampling[r.mix_name, r.name] = r.sampling or "random"
    rows = []
    for name, weights in by_mix.items():
        _, quota = plan_quotas(weights, tokens)
        for s, q in quota.items():
            full = int(q // tokens[s])
            if full >= weights[s][1]:
                full, rest = weights[s][1], 0.0
            else:
                rest = q - full * tokens[s]
            rows.append((name, s, full, float(rest), sampling[name, s] == "sequential", zlib.crc32(f"{seed}/{name}/{s}".encode())))
    shape = f"mix_name string, shard int, position long, {key} {kind}, source string, repeat_no int, n_tokens long"
    if not rows:
        empty = spark.createDataFrame([], shape)
        return empty, shares(empty, mixes)
    quotas = spark.createDataFrame(rows, "mix_name string, source string, full int, rest double, in_order boolean, salt long")
    # candidates of each mix in its own order: by key, or by a seeded hash of it
    cand = sizes.join(F.broadcast(quotas), "source").withColumn("_k", F.when(F.col("in_order") & F.lit(kind in ("bigint", "int")), F.col(key).cast("long") if kind in ("bigint", "int") else F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "salt", key)))
    cand = cand.join(F.broadcast(sizes_cuts(cand, sizes.count())), ["mix_name", "source"]).withColumn("_b", F.expr("size(filter(cuts, c -> c < _k))")).drop("cuts")
    w = Window.partitionBy("mix_name", "source", "_b").orderBy("_k", key)
    cand = materialize(cand.withColumn("_cum", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w)), "candidates")
    up = Window.partitionBy("mix_name", "source").orderBy("_b")
    prefix = cand.groupBy("mix_name", "source", "_b").agg(F.sum("n_tokens").alias("_t"), F.count("*").alias("_n")).select("mix_name", "source", "_b", (F.sum("_t").over(up) - F.col("_t")).alias("_t0"), (F.sum("_n").over(up) - F.col("_n")).alias("_n0"))
    ordered = cand.join(prefix, ["mix_name", "source", "_b"]).withColumn("_sum", F.col("_cum") + F.col("_t0")).withColumn("_rank", F.col("_rn") - 1 + F.col("_n0"))
    # a text is in the last, partial pass while its middle lies before the quota's end
    ordered = ordered.withColumn("_times", F.col("full") + (F.col("_sum") - F.col("n_tokens") / 2.0 < F.col("rest")).cast("int")).where("_times > 0")
    ordered = materialize(ordered.select("mix_name", "source", key, "n_tokens", "_rank", "_times", "salt"), "chosen")
    passes = ordered.select("mix_name", "source", F.explode(F.expr("sequence(1, _times)")).alias("repeat_no"), "n_tokens").groupBy("mix_name", "source", "repeat_no").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()  # settings x repeats rows
    rng = np.random.default_rng(seed)
    cells = []
    for name in sorted({r.mix_name for r in passes}):
        own = sorted((r for r in passes if r.mix_name == name), key=lambda r: (r.source, r.repeat_no))
        shards = min(MOST_SHARDS, max(1, round(sum(r.t for r in own) / shard_tokens)))
        size = [max(1, -(-r.n // MOST_BLOCKS)) for r in own]
        n_blocks = np.array([-(-r.n // b) for r, b in zip(own, size)], np.int64)
        leaf = split(n_blocks, shards, rng)
        for j, (r, b) in enumerate(zip(own, size)):
            perm = rng.permutation(int(n_blocks[j]))
            of = np.empty(len(perm), np.int64)
            of[perm] = np.repeat(np.arange(shards), leaf[:, j])  # disjoint runs of permuted blocks
            cells.append((name, r.source, r.repeat_no, b, of.tolist()))
    # one row a source and pass, of at most MOST_BLOCKS shard numbers
    blocks = spark.createDataFrame(cells, "mix_name string, source string, repeat_no int, _size long, _shards array<int>")
    out = (
        ordered.withColumn("repeat_no", F.explode(F.expr("sequence(1, _times)"))).join(F.broadcast(blocks), ["mix_name", "source", "repeat_no"])
        .withColumn("shard", F.expr("_shards[int(_rank div _size)]"))
        .withColumn("position", F.row_number().over(Window.partitionBy("mix_name", "shard").orderBy(F.xxhash64(F.lit(seed), key, "repeat_no", "shard"), key, "repeat_no")).cast("long") - 1)
        .select("mix_name", "shard", "position", key, "source", "repeat_no", "n_tokens")
    )
    return out, shares(out, mixes)


def sizes_cuts(cand: DataFrame, rows: int) -> DataFrame:
    """Quantiles of the order key for each mix and source: the edges of its buckets."""
    n = min(BUCKETS[1], max(BUCKETS[0], rows // BUCKET_ROWS))
    at = [i / n for i in range(1, n)]
    return cand.groupBy("mix_name", "source").agg(F.percentile_approx("_k", at, 10 * n).alias("cuts"))


def shares(chosen: DataFrame, mixes: DataFrame) -> DataFrame:
    """Target and actual share of each source of each mix, with texts, rows and the most repeats."""
    w = Window.partitionBy("mix_name")
    target = mixes.where("mix_name is not null and name is not null").select("mix_name", F.col("name").alias("source"), "max_repeats", F.coalesce("weight", F.lit(0.0)).alias("weight")).withColumn("target_share", F.when(F.sum("weight").over(w) > 0, F.col("weight") / F.sum("weight").over(w)).otherwise(0.0)).drop("weight")
    got = chosen.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"), F.sum((F.col("repeat_no") == 1).cast("long")).alias("n_docs"), F.max("repeat_no").alias("most_repeats"))
    out = target.join(got, ["mix_name", "source"], "left").fillna(0, ["n_tokens", "n_rows", "n_docs", "most_repeats"])
    return out.withColumn("actual_share", F.round(F.when(F.sum("n_tokens").over(w) > 0, F.col("n_tokens") / F.sum("n_tokens").over(w)).otherwise(0.0), 6)).withColumn("target_share", F.round("target_share", 6))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_sources"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_sources"))[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
