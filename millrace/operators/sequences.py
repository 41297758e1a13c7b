"""Packing and batching of sequences (PK3, BT1, BT2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.rank import ranked
from millrace.runtime import materialize

RUN = 65_536  # sequences of a bucket after which batching starts anew, so that no task folds an unbounded run


def first_fit_decreasing(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """Where sequences go by need, longest first, each into the first pack with room: need -> (first rank, first pack, a pack).

    Packs with equal room side by side are handled as one run, so the work depends on the lengths, not on the sequences.
    """
    runs: list[list[int]] = []  # room, packs
    out: dict[int, list[tuple[int, int, int]]] = {}
    for need in sorted(histogram, reverse=True):
        left, rank, first = histogram[need], 0, 0
        places, after = [], []
        for room, packs in runs:
            each = min(room // need, left) if left else 0
            if not each:
                after.append([room, packs])
            else:
                full = min(packs, left // each)
                places.append((rank, first, each))
                after.append([room - each * need, full])
                rank, left = rank + full * each, left - full * each
                rest = packs - full
                if rest and left:  # a last pack that isn't filled up
                    places.append((rank, first + full, left))
                    after.append([room - left * need, 1])
                    rank, left, rest = rank + left, 0, rest - 1
                if rest:
                    after.append([room, rest])
            first += packs
        if left:
            size = max(capacity, need)
            each = min(size // need, left)
            full, rest = divmod(left, each)
            places.append((rank, first, each))
            after.append([size - each * need, full])
            if rest:
                places.append((rank + full * each, first + full, rest))
                after.append([size - rest * need, 1])
        runs = []
        for room, packs in after:
            if runs and runs[-1][0] == room:
                runs[-1][1] += packs
            else:
                runs.append([room, packs])
        out[need] = places
    return out


def pack_first_fit(df: DataFrame, key: str, size: str, capacity: int, block: int = 100_000) -> DataFrame:
    """PK3: pack, key, size: longest first, each sequence (and its end mark) into the first pack with room; of equal ones the
    least key first; a longer one gets a pack of its own.

    The packing is worked out on the histogram of lengths; sequences take the places of their length by rank, which is
    counted in blocks, so a hot length is spread over many tasks.
    """
    kind = df.schema[key].dataType.simpleString()
    x = ranked(df.select(key, size).withColumn("_need", F.least(F.col(size), F.lit(1 << 40)) + 1), [F.asc("_need"), F.asc(key)], "_at")
    x = materialize(x, "sequences")
    counts = x.groupBy("_need").agg(F.count("*").alias("n"), F.min("_at").alias("_from")).collect()  # one row a length
    places = first_fit_decreasing({r["_need"]: r.n for r in counts}, capacity)
    where = {n: tuple(np.array(v, np.int64) for v in zip(*p)) for n, p in places.items()}
    start = {r["_need"]: r["_from"] for r in counts}
    shared = df.sparkSession.sparkContext.broadcast((where, start))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first = shared.value
        for b in batches:
            pack = np.zeros(len(b), np.int64)
            for need, rows in b.groupby("_need").indices.items():
                rank0, pack0, each = at[need]
                r = b["_at"].to_numpy()[rows] - first[need]
                j = np.searchsorted(rank0, r, side="right") - 1
                pack[rows] = pack0[j] + (r - rank0[j]) // each[j]
            yield pd.DataFrame({"pack": pack, key: b[key], size: b[size]})

    return x.mapInPandas(put, f"pack long, {key} {kind}, {size} long")


def token_batches(df: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """BT1, BT2: length buckets 128 to 8192 by powers of two; in key order, a batch closes before its longest length times its
    rows passes the budget, and at each RUN sequences of a bucket."""
    bucket = F.least(F.greatest(F.lit(7), F.ceil(F.log2(F.greatest(F.col(size), F.lit(1))))), F.lit(13)).cast("int")
    x = ranked(df.select(key, size).withColumn("bucket", bucket), ["bucket", key], "_at")
    own = x.groupBy("bucket").agg(F.min("_at").alias("_from"))  # one row a bucket
    x = x.join(F.broadcast(own), "bucket").withColumn("run", F.expr(f"(_at - _from) div {RUN}"))
    kind = df.schema[key].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, batch, rows, longest = [], 0, 0, 0
        for k, n_, g, b in pdf.sort_values(key)[[key, size, "run", "bucket"]].itertuples(index=False):
            if rows and max(longest, n_) * (rows + 1) > budget:
                batch, rows, longest = batch + 1, 0, 0
            rows, longest = rows + 1, max(longest, n_)
            out.append((b, g, batch, k, n_))
        return pd.DataFrame(out, columns=["bucket", "run", "batch", key, size])

    return x.groupBy("bucket", "run").applyInPandas(fold, f"bucket int, run long, batch int, {key} {kind}, {size} long")
