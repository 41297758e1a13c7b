"""Filling containers of fixed capacity (problem 7).

The configuration LP over the histogram of lengths (a configuration is a multiset of
lengths that fits) is solved by multiplicative weights until every text is covered:
each round, an unbounded knapsack by dynamic programming values every room at the
prices of the lengths; configurations worth nearly the best are taken while their
texts last, and the prices of covered lengths fall beside those that are left.  Each
round's prices give a dual bound.  Rounded, the configurations get whole
multiplicities; lengths left over are put together by best fit, again as
configurations with multiplicities.
All that depends on the histogram only, whose size the capacity bounds.  Texts then
take the slots of their length by rank, ranks being counted in blocks so that a
length shared by a third of all texts is spread over many tasks.

Defined results: null and empty texts have no tokens and are put nowhere.  A text
longer than the capacity is cut into pieces of the capacity and one rest; no other
text is cut.  Repeated rows are placed once each.  A pack of null or non-positive
capacity gets no containers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.tokens import TOKENIZER, count_tokens
from millrace.runtime import materialize


def worths(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The highest value within each room up to the capacity: unbounded knapsack, one vector step a length.

    Along each residue class of a length, taking it k times is a running maximum of best[c] - (c // length) * value.
    """
    best = np.zeros(capacity + 1)
    for ell, v in zip(lengths.tolist(), values.tolist()):
        rows = -(-(capacity + 1) // ell)
        if rows == 2:  # it fits once
            best[ell:] = np.maximum(best[ell:], best[: capacity + 1 - ell] + v)
        elif rows > 2:
            grid = np.full(rows * ell, -np.inf)
            grid[: capacity + 1] = best
            grid = grid.reshape(rows, ell)
            gain = v * np.arange(rows)[:, None]
            best = (np.maximum.accumulate(grid - gain, axis=0) + gain).ravel()[: capacity + 1]
    return np.maximum.accumulate(best)


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths within the capacity with the highest value."""
    best = worths(lengths, values, capacity)
    out: dict[int, int] = {}
    c = capacity
    while True:
        fit = lengths <= c
        if not fit.any() or best[c] <= 1e-12:
            return out
        cand = best[c - lengths[fit]] + values[fit]
        k = int(np.argmax(cand))
        if cand[k] < best[c] - 1e-9:
            c -= 1  # best[c] came from a smaller capacity
            continue
        ell = int(lengths[fit][k])
        out[ell] = out.get(ell, 0) + 1
        c -= ell


@dataclass(frozen=True)
class Params:
    """Rounds of the LP at most; rate: how fast prices of covered lengths fall; gap: share of the best worth that a configuration may
    lack in the first round, and twice that two rounds later; shares: of the tokens that the LP's configurations are tried for."""

    rounds: int = 120
    rate: float = 3.0
    gap: float = 0.002
    shares: tuple[float, ...] = (1.0, 0.98, 0.95, 0.9, 0.8, 0.6, 0.3, 0.0)


Config = tuple[tuple[int, int], ...]  # (length, times), ascending


def fill(first: int, lengths: np.ndarray, price: np.ndarray, best: np.ndarray, fits: np.ndarray, left: np.ndarray, open_: np.ndarray, least: float) -> dict[int, int]:
    """The configuration of the highest price with the length at ``first`` and texts that are left, by place; empty if it is worth less than ``least``.

    ``best``: of every room; ``fits``: the first place that fits a room; ``open_``: prices, -inf where no text is left. Of equal
    ones the longest is taken, so that the short ones, which fit anywhere, last.
    """
    config: dict[int, int] = {}
    worth, room, k = 0.0, len(best) - 1, first
    while True:
        config[k] = config.get(k, 0) + 1
        worth, room = worth + price[k], room - int(lengths[k])
        if config[k] >= left[k]:
            open_[k] = -np.inf
        i = int(fits[room])
        if i == len(lengths) or worth + best[room] < least:
            break
        cand = best[room - lengths[i:]] + open_[i:]
        top = cand.max()
        if top <= 0:
            break
        k = i + int((cand > top - 1e-9).argmax())
    for k in config:
        open_[k] = price[k]
    return config if worth >= least else {}


def relax(whole: dict[int, int], capacity: int, p: Params = Params()) -> tuple[dict[Config, float], float]:
    """The configuration LP by multiplicative weights: multiplicities that cover every text, in the order found, and a dual bound on the containers.

    A length's price starts at its share of the capacity and falls exponentially with the share of its texts covered so far,
    so that what is still uncovered gets dearer beside it. Each round, the knapsack values every room at the prices; for each
    length, from the longest, the best configuration that has it is taken as often as texts are left, as long as it is worth
    the best of all but for a share. The share doubles in two rounds, so that within some twenty all is covered. The value of the
    best configuration of all lengths scales the prices to a feasible dual, whose objective bounds every packing from below.
    """
    lengths = np.array(sorted(whole, reverse=True))
    n = np.array([whole[e] for e in lengths.tolist()], float)
    left = n.copy()
    used: dict[Config, float] = {}
    bound = 0.0
    for r in range(p.rounds):
        at = np.flatnonzero(left > 0)
        if not len(at):
            break
        prices = lengths / capacity * np.exp(-p.rate * (1 - left / n))
        own, price, free = lengths[at], prices[at], left[at]
        best = worths(own, price, capacity)
        bound = max(bound, float((n * prices).sum() / (best if len(at) == len(n) else worths(lengths, prices, capacity))[capacity]))
        least = best[capacity] * (1 - p.gap * 2 ** (r / 2))
        open_, fits = price.copy(), np.searchsorted(-own, -np.arange(capacity + 1))
        for i in range(len(own)):
            while free[i] > 0 and price[i] + best[capacity - own[i]] >= least and (config := fill(i, own, price, best, fits, free, open_, least)):
                amount = float(min(free[k] // m for k, m in config.items()))
                key = tuple(sorted((int(own[k]), m) for k, m in config.items()))
                used[key] = used.get(key, 0.0) + amount
                for k, m in config.items():
                    free[k] -= m * amount
                    if free[k] <= 0:
                        open_[k] = -np.inf
        left[at] = free
    return used, max(bound, float((n * lengths).sum() / capacity))


def best_fit(rest: dict[int, int], capacity: int) -> dict[Config, int]:
    """Longest first, each container filled with the longest that still fits; equal containers at once."""
    plan: dict[Config, int] = {}
    order = sorted((e for e, n in rest.items() if n), reverse=True)
    arr = np.array(order, int)
    n_left = np.array([rest[e] for e in order], int)
    while len(arr):
        config: dict[int, int] = {}
        room, i = capacity, 0
        while room > 0:
            i = max(i, int(np.searchsorted(-arr, -room)))  # the longest that fits
            while i < len(arr) and n_left[i] - config.get(int(arr[i]), 0) <= 0:
                i += 1
            if i >= len(arr):
                break
            e = int(arr[i])
            k = min(room // e, int(n_left[i]) - config.get(e, 0))
            config[e] = config.get(e, 0) + k
            room -= k * e
            i += 1
        at = {e: int(np.searchsorted(-arr, -e)) for e in config}
        m = min(int(n_left[at[e]]) // k for e, k in config.items())
        key = tuple(sorted(config.items()))
        plan[key] = plan.get(key, 0) + m
        for e, k in config.items():
            n_left[at[e]] -= k * m
        keep = n_left > 0
        arr, n_left = arr[keep], n_left[keep]
    return plan


def round_down(used: dict[Config, float], whole: dict[int, int], capacity: int, share: float = 1.0) -> dict[Config, int]:
    """Whole multiplicities of the LP's configurations, in the order found, for a share of the tokens; then what is left by best fit."""
    plan: dict[Config, int] = {}
    rest = dict(whole)
    most = share * sum(e * n for e, n in whole.items())
    for key, x in used.items():
        if most <= 0:
            break
        m = min([int(x + 0.5), *(rest[e] // k for e, k in key)])  # never uses a length more often than it is there
        if m > 0:
            plan[key] = m
            for e, k in key:
                rest[e] -= k * m
                most -= e * k * m
    for key, m in best_fit(rest, capacity).items():
        plan[key] = plan.get(key, 0) + m
    return plan


def solve(histogram: dict[int, int], capacity: int, p: Params = Params()) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """Configurations with multiplicities that use up the histogram exactly: (multiplicity, length -> times), and the least
    number of containers that any packing needs (the LP's dual bound). The LP's last configurations hold what its first ones
    left; where best fit packs that better, they are given up, as few as that takes."""
    whole = {int(e): int(n) for e, n in histogram.items() if 0 < e <= capacity and n > 0}
    if not whole:
        return [], 0
    used, bound = relax(whole, capacity, p)
    least = int(np.ceil(bound - 1e-6))
    plan: dict[Config, int] = {}
    for share in p.shares:
        other = round_down(used, whole, capacity, share)
        if not plan or sum(other.values()) < sum(plan.values()):
            plan = other
        if sum(plan.values()) <= least:  # no packing needs fewer
            break
    return [(m, dict(key)) for key, m in plan.items()], least


Slots = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by length: first rank, first container, texts a container, tokens used


def slots(plan: list[tuple[int, dict[int, int]]]) -> Slots:
    """Where the texts of each length go, by rank among those of their length."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for m, config in plan:
        used = sum(e * k for e, k in config.items())
        for e, k in config.items():
            out.setdefault(e, []).append((taken.get(e, 0), first, k, used))
            taken[e] = taken.get(e, 0) + m * k
        first += m
    return {e: tuple(np.array(x, np.int64) for x in zip(*rows)) for e, rows in out.items()}


def pack(docs: DataFrame, limits: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, p: Params = Params(), block: int = 50_000) -> DataFrame:
    """pack_name, capacity_tokens, container_id, key, piece_no, start_token, n_tokens, used_tokens for each text or piece."""
    spark = docs.sparkSession
    sizes = count_tokens(docs, text, (key,), tokenizer).where("n_tokens > 0")
    packs = [(r.pack_name, int(r.capacity_tokens)) for r in limits.select("pack_name", "capacity_tokens").distinct().collect() if r.capacity_tokens and r.capacity_tokens > 0]  # settings, not data
    if not packs:
        return spark.createDataFrame([], f"pack_name string, capacity_tokens int, container_id long, {key} {docs.schema[key].dataType.simpleString()}, piece_no int, start_token long, n_tokens long, used_tokens long")
    by_pack = sizes.select(key, F.col("n_tokens").alias("_whole"), F.explode(F.array(*(F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity_tokens")) for n, c in packs))).alias("_p")).select(key, "_whole", "_p.*")
    c = F.col("capacity_tokens").cast("long")
    pieces = by_pack.select("*", F.posexplode(F.expr("sequence(0L, (_whole - 1) div capacity_tokens)"))).select(
        "pack_name", "capacity_tokens", key, F.col("pos").alias("piece_no"), (F.col("col") * c).alias("start_token"), F.least(c, F.col("_whole") - F.col("col") * c).alias("n_tokens")
    )
    n_docs = sizes.count()
    n_blocks = max(1, -(-n_docs // block))
    pieces = materialize(pieces.withColumn("_block", F.pmod(F.xxhash64(key, "piece_no"), F.lit(n_blocks)).cast("int")), "pieces")
    counts = pieces.groupBy("pack_name", "n_tokens", "_block").agg(F.count("*").alias("n"))
    w = Window.partitionBy("pack_name", "n_tokens").orderBy("_block")
    offsets = materialize(counts.withColumn("_before", F.sum("n").over(w) - F.col("n")), "offsets")
    histogram: dict[str, dict[int, int]] = {}
    for r in offsets.groupBy("pack_name", "n_tokens").agg(F.sum("n").alias("n")).collect():  # at most capacity_tokens rows a pack
        histogram.setdefault(r.pack_name, {})[r.n_tokens] = r.n
    place = {name: slots(solve(histogram.get(name, {}), cap, p)[0]) for name, cap in packs}
    shared = spark.sparkContext.broadcast(place)
    ranked = pieces.withColumn("_rn", F.row_number().over(Window.partitionBy("pack_name", "n_tokens", "_block").orderBy(key, "piece_no")))
    # rows of the same length in several blocks: the prefix of their block comes from a table of lengths by blocks
    ranked = ranked.join(offsets.drop("n"), ["pack_name", "n_tokens", "_block"]).withColumn("_rank", F.col("_rn") - 1 + F.col("_before"))
    kind = docs.schema[key].dataType.simpleString()

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = shared.value
        for b in batches:
            container = np.zeros(len(b), np.int64)
            used = np.zeros(len(b), np.int64)
            rank = b["_rank"].to_numpy()
            for (name, ell), at in b.groupby(["pack_name", "n_tokens"]).indices.items():
                start, first, k, u = where[name][int(ell)]
                j = np.searchsorted(start, rank[at], side="right") - 1
                container[at] = first[j] + (rank[at] - start[j]) // k[j]
                used[at] = u[j]
            yield b.drop(columns="_rank").assign(container_id=container, used_tokens=used)[["pack_name", "capacity_tokens", "container_id", key, "piece_no", "start_token", "n_tokens", "used_tokens"]]

    return ranked.select("pack_name", "capacity_tokens", key, "piece_no", "start_token", "n_tokens", "_rank").mapInPandas(
        put, f"pack_name string, capacity_tokens int, container_id long, {key} {kind}, piece_no int, start_token long, n_tokens long, used_tokens long"
    )


def containers(contents: DataFrame) -> DataFrame:
    """One row a container: its texts, tokens and fill."""
    return contents.groupBy("pack_name", "container_id").agg(
        F.first("capacity_tokens").alias("capacity_tokens"), F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_tokens") / F.first("capacity_tokens"), 6).alias("fill")
    )


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(p7_pack(spark, sf_dir))


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers a pack, the least number that any packing needs by volume, and the mean fill."""
    return (
        p7_pack(spark, sf_dir).groupBy("pack_name").agg(F.first("capacity_tokens").alias("capacity_tokens"), (F.max("container_id") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
    )


QUERIES = {"p7_pack": p7_pack, "p7_containers": p7_containers, "p7_summary": p7_summary}
