"""Near-duplicate records with small edits (problem 4).

An exact join in the metric space of Jaccard distance over distinct runs of words.
Records with the same set of runs form one class, and only one member of each class
is joined.  Space is cut in two levels:

* First level.  With all runs in one global order (rarest first by a count-min
  sketch of the whole collection), two sets within the distance share one of the
  first ``n - ceil(t n) + 1`` runs of each.  Each of those runs seeds a region, and a
  set belongs to the regions of all of its first runs.
* Second level.  A region of more than ``leaf`` sets is joined recursively: pivots are
  drawn, each set goes to the cell of its nearest pivot p, and by the triangle
  inequality also into each cell q with d(x, q) - d(x, p) <= 2 r, since only there can
  a partner within r be.  Cells above the leaf size are cut again by new pivots; a
  cell that doesn't shrink any more is joined block by block.

Candidates from small regions pass a length and a position bound, and every
candidate is checked by exact intersection, so pairs are exact at any size.

Why not pivots alone: unrelated texts lie at distances between 0.9 and 1 of each
other and of every pivot, so with r = 0.3 windows cover nearly every cell: on 400 sets of
the tables at 0.1, a set went into 99.3 % of the cells of 16 pivots, 97.3 % of 64 and
88.8 % of 256. So pivots join only what the first level leaves in one region.

Defined results: the body is the first of the columns that is neither null nor empty;
records without one are in no pair and form groups of their own.  Bodies of fewer words than a
run have no runs and are similar only to identical bodies.  Repeated record ids
count as one record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.runtime import materialize, spread

WORD = re.compile(r"\w+")
SKETCH_BITS = 22
SLICES = 64
GATHER = 512  # partitions whose slices one task adds up first


def body(columns: list[str]) -> F.Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in columns))


def runs_of(text: str, width: int, cache: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` consecutive words."""
    words = WORD.findall(text.lower())
    if len(words) < width:
        return np.zeros(0, np.int64)
    if len(cache) > 500_000:
        cache.clear()
    ids = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    a = np.array(ids, np.uint64)
    n = len(a) - width + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ a[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def sets(df: DataFrame, key: str, columns: list[str], width: int) -> DataFrame:
    """key, n, digest of the set (of the body if it has no runs), runs."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for b in batches:
            got = [runs_of(t, width, cache) for t in b["_body"]]
            dig = [xxhash.xxh3_128_hexdigest(x.tobytes()) if len(x) else "b" + xxhash.xxh3_128_hexdigest(t.encode("utf-8", "surrogatepass")) for x, t in zip(got, b["_body"])]
            yield pd.DataFrame({key: b[key], "n": [len(x) for x in got], "digest": dig, "runs": got})

    src = df.select(key, body(columns).alias("_body")).where("_body is not null")
    return spread(src).mapInPandas(run, f"`{key}` {kind}, n int, digest string, runs array<long>")


def sketch(runs: DataFrame) -> np.ndarray:
    """Count-min row of how many sets hold a run, by the run's low bits: a fixed number of counts, whatever the data.

    A partition's counts are sent in two bytes (more than 65,535 are as good as that many: only the order counts), and are
    added up in two levels, so that no task gathers a slice of every partition.
    """
    size = 1 << SKETCH_BITS

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(size, np.int32)
        for b in batches:
            for x in b["runs"]:
                np.add.at(c, np.asarray(x, np.int64) & (size - 1), 1)
        small = np.minimum(c, 65535).astype(np.uint16)
        yield pd.DataFrame({"slice": range(SLICES), "group": TaskContext.get().partitionId() // GATHER, "c": [x.tobytes() for x in np.split(small, SLICES)]})

    def add(kind: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(size // SLICES, np.int64)
            for x in pdf["c"]:
                total += np.frombuffer(x, kind)
            return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "group": [pdf["group"].iloc[0]], "c": [np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()]})

        return one

    shape = "slice int, group int, c binary"
    some = runs.mapInPandas(part, shape).groupBy("slice", "group").applyInPandas(add(np.uint16), shape)
    rows = some.groupBy("slice").applyInPandas(add(np.int32), shape).collect()
    out = np.zeros((SLICES, size // SLICES), np.int32)
    for r in rows:
        out[r.slice] = np.frombuffer(r.c, np.int32)
    return out.ravel()


def _prefixes(sets_: DataFrame, key: str, counts: np.ndarray, t: float) -> DataFrame:
    """One row for each of a set's first runs in the global order: run, key, n, pos."""
    kind = sets_.schema[key].dataType.simpleString()
    shared = sets_.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        mask = len(c) - 1
        for b in batches:
            out_k, out_r, out_n, out_p = [], [], [], []
            for k, x in zip(b[key], b["runs"]):
                x = np.asarray(x)
                n = len(x)
                m = n - int(np.ceil(t * n - 1e-9)) + 1
                order = np.lexsort((x, c[x & mask]))[:m]
                out_r.append(x[order])
                out_k += [k] * m
                out_n += [n] * m
                out_p += range(m)
            yield pd.DataFrame({"run": np.concatenate(out_r) if out_r else np.zeros(0, np.int64), key: out_k, "n": out_n, "pos": out_p})

    return sets_.mapInPandas(run, f"run long, `{key}` {kind}, n int, pos int")


def _regions(rows: DataFrame, key: str, t: float, leaf: int) -> DataFrame:
    """Walk of the regions, after one shuffle by run: a, b, pa, pb, na, nb of the pairs of regions of up to ``leaf`` sets that
    the length and position bounds let through, and run, a (b null) of the sets of larger regions.

    A partition is sorted by run and streamed, so a region is never held beyond ``leaf`` sets.
    """
    kind = rows.schema[key].dataType.simpleString()

    def pairs(g: dict[str, np.ndarray]) -> pd.DataFrame:
        run, k, n, pos = g["run"], g["k"], g["n"], g["pos"]
        out = []
        for d in range(1, leaf):
            i = np.flatnonzero(run[d:] == run[:-d])
            if not len(i):
                break
            j = i + d
            less = np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * t - 1e-9
            need = np.ceil((n[i] + n[j]) * (t / (1 + t)) - 1e-9)
            ok = less & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) & (k[i] != k[j])
            i, j = i[ok], j[ok]
            swap = k[i] > k[j]
            x, y = np.where(swap, j, i), np.where(swap, i, j)
            out.append(pd.DataFrame({"run": pd.array([None] * len(x), "Int64"), "a": k[x], "b": k[y], "pa": pos[x], "pb": pos[y], "na": n[x], "nb": n[y]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["run", "a", "b", "pa", "pb", "na", "nb"])

    def large(run: np.ndarray, k: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"run": pd.array(run, "Int64"), "a": k, "b": pd.Series([None] * len(k), dtype="object"), "pa": 0, "pb": 0, "na": 0, "nb": 0})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] | None = None
        over: int | None = None  # the run of a large region that is being streamed
        for b in batches:
            g = {"run": b["run"].to_numpy(), "k": b[key].to_numpy(), "n": b["n"].to_numpy(), "pos": b["pos"].to_numpy()}
            if held is not None:
                g = {c: np.concatenate([held[c], g[c]]) for c in g}
            run = g["run"]
            if over is not None:
                m = int(np.searchsorted(run, over, "right"))
                if m:
                    yield large(run[:m], g["k"][:m])
                    g = {c: v[m:] for c, v in g.items()}
                    run = g["run"]
                if len(run):
                    over = None
            if not len(run):
                held = None
                continue
            starts = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1]
            size = np.diff(np.r_[starts, len(run)])
            each = np.repeat(size, size)
            last = starts[-1]
            whole = np.arange(len(run)) < last
            big = each > leaf
            if (big & whole).any():
                yield large(run[big & whole], g["k"][big & whole])
            take = whole & ~big & (each > 1)
            if take.any():
                yield pairs({c: v[take] for c, v in g.items()})
            if size[-1] > leaf:
                yield large(run[last:], g["k"][last:])
                over, held = int(run[last]), None
            else:
                held = {c: v[last:] for c, v in g.items()}
        if held is not None and len(held["run"]) > 1:
            yield pairs(held)

    near = rows.repartition("run").sortWithinPartitions("run")
    return near.mapInPandas(walk, f"run long, a {kind}, b {kind}, pa int, pb int, na int, nb int")


def _bounded(met: DataFrame, t: float) -> DataFrame:
    """Candidate pairs: those whose shared first runs, and what may follow the last of them, reach the overlap that t asks for."""
    g = met.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    need = F.ceil((F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-9)
    return g.where(F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1 >= need).select("a", "b")


def distance(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard distance of two sorted arrays without repeats."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 1.0 - both / (len(x) + len(y) - both)


def _leaf_pairs(keys: list, arrays: list[np.ndarray], t: float) -> list[tuple]:
    order = sorted(range(len(keys)), key=lambda i: len(arrays[i]))
    out = []
    for u, i in enumerate(order):
        for j in order[u + 1 :]:
            if len(arrays[i]) < t * len(arrays[j]) - 1e-9:
                break
            if distance(arrays[i], arrays[j]) <= 1 - t + 1e-9:
                out.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
    return out


def metric_join(cells: DataFrame, key: str, t: float, leaf: int = 256, pivots: int = 16, depth: int = 6) -> DataFrame:
    """Pairs within distance 1 - t inside of each cell: ``cells`` holds cell, key, runs.

    Cells above ``leaf`` are cut by pivots, again and again; the windows keep every pair together in some cell.
    """
    kind = cells.schema[key].dataType.simpleString()
    r = 1 - t

    def join_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _leaf_pairs(list(pdf[key]), [np.asarray(x) for x in pdf["runs"]], t)
        return pd.DataFrame(got, columns=["a", "b"])

    out = None
    for level in range(depth + 1):
        size = cells.groupBy("cell").agg(F.count("*").alias("_size"))
        sized = materialize(cells.join(size, "cell"), "cells")
        small = sized.where(F.col("_size") <= leaf).groupBy("cell").applyInPandas(join_leaf, f"a {kind}, b {kind}")
        out = small if out is None else out.unionByName(small)
        big = sized.where(F.col("_size") > leaf)
        if big.isEmpty():
            return out.distinct()
        if level == depth:
            return out.unionByName(_by_blocks(big, key, t, leaf)).distinct()
        # pivots of each cell: the sets of the lowest seeded hashes, a few a cell
        drawn = big.select("cell", F.struct(F.xxhash64(F.lit(level), key).alias("h"), F.col("runs").alias("runs")).alias("p"))
        chosen = _lowest(drawn, pivots)
        joined = big.drop("_size").join(chosen, "cell")

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for c, k, x, ps in zip(b["cell"], b[key], b["runs"], b["pivots"]):
                    x = np.asarray(x)
                    d = np.array([distance(x, np.asarray(p)) for p in ps])
                    near = d.min()
                    rows += [(f"{c}/{i}", k, x) for i in np.flatnonzero(d - near <= 2 * r + 1e-9)]
                yield pd.DataFrame(rows, columns=["cell", key, "runs"])

        nxt = materialize(joined.mapInPandas(assign, f"cell string, `{key}` {kind}, runs array<long>"), "voronoi")
        # a cut that only multiplies the rows (all sets about as far from all pivots) gives way to blocks
        grown = nxt.groupBy(F.expr("substring_index(cell, '/', -1)").alias("x"), F.expr("regexp_replace(cell, '/[^/]*$', '')").alias("cell")).agg(F.count("*").alias("m")).groupBy("cell").agg(F.max("m").alias("m"))
        stuck = grown.join(size, "cell").where("m > 0.8 * _size").select("cell")
        out = out.unionByName(_by_blocks(big.join(stuck, "cell", "left_semi"), key, t, leaf))
        cells = nxt.withColumn("_c", F.expr("regexp_replace(cell, '/[^/]*$', '')")).join(stuck.withColumnRenamed("cell", "_c"), "_c", "left_anti").drop("_c")
    return out.distinct()


def _lowest(drawn: DataFrame, pivots: int) -> DataFrame:
    """The runs of the ``pivots`` sets of lowest hash of each cell, by salted partial choices."""
    part = Window.partitionBy("cell", "_salt").orderBy("p.h")
    some = drawn.withColumn("_salt", F.pmod(F.col("p.h"), F.lit(64))).withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= pivots)
    last = some.withColumn("_rn", F.row_number().over(Window.partitionBy("cell").orderBy("p.h"))).where(F.col("_rn") <= pivots)
    return last.groupBy("cell").agg(F.collect_list("p.runs").alias("pivots"))


def _by_blocks(big: DataFrame, key: str, t: float, leaf: int) -> DataFrame:
    """Cells that pivots can't cut: sets sorted by size into blocks, and each pair of blocks whose sizes are near enough is one task."""
    kind = big.schema[key].dataType.simpleString()
    sized = big.withColumn("_n", F.size("runs"))
    w = Window.partitionBy("cell", "_band").orderBy("_n", key)
    band = F.floor(F.log(F.col("_n").cast("double")) / F.lit(-np.log(t))).cast("int")
    rows = sized.withColumn("_band", band).withColumn("_block", F.floor((F.row_number().over(w) - 1) / leaf).cast("int"))
    ends = rows.groupBy("cell", "_band").agg(F.max("_block").alias("_most"))
    own = rows.select("cell", "_band", "_block", key, "runs")
    # partners of a set lie in its own or a neighbouring band of sizes
    meet = ends.select("cell", F.col("_band").alias("_b1"), F.col("_most").alias("_m1")).join(ends.select("cell", F.col("_band").alias("_b2"), F.col("_most").alias("_m2")), "cell").where("_b2 - _b1 in (0, 1)")
    tasks = meet.select("cell", "_b1", "_b2", F.explode(F.expr("sequence(0, _m1)")).alias("_k1"), "_m2").select("cell", "_b1", "_b2", "_k1", F.explode(F.expr("sequence(0, _m2)")).alias("_k2")).where("_b1 < _b2 or _k1 <= _k2")
    tasks = tasks.withColumn("_task", F.xxhash64("cell", "_b1", "_b2", "_k1", "_k2"))
    left = tasks.select("_task", "cell", F.col("_b1").alias("_band"), F.col("_k1").alias("_block"), F.lit(0).alias("_side"))
    right = tasks.where("_b1 <> _b2 or _k1 <> _k2").select("_task", "cell", F.col("_b2").alias("_band"), F.col("_k2").alias("_block"), F.lit(1).alias("_side"))
    spread_rows = left.unionByName(right).join(own, ["cell", "_band", "_block"]).select("_task", key, "runs")

    def join_task(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_leaf_pairs(list(pdf[key]), [np.asarray(x) for x in pdf["runs"]], t), columns=["a", "b"])

    return spread_rows.groupBy("_task").applyInPandas(join_task, f"a {kind}, b {kind}")


def similar_sets(reps: DataFrame, key: str, t: float, leaf: int = 256) -> DataFrame:
    """Pairs a < b of sets with Jaccard similarity of at least ``t``: a, b, similarity."""
    kind = reps.schema[key].dataType.simpleString()
    counts = sketch(reps)
    met = materialize(_regions(_prefixes(reps, key, counts, t), key, t, leaf), "regions")
    cand = _bounded(met, t)
    large = met.where("b is null").select(F.col("run").cast("string").alias("cell"), F.col("a").alias(key))
    if not large.isEmpty():
        cand = cand.unionByName(metric_join(large.join(reps.select(key, "runs"), key), key, t, leaf)).distinct()
    x = reps.select(F.col(key).alias("a"), F.col("runs").alias("_ra"), F.col("n").alias("_na"))
    y = reps.select(F.col(key).alias("b"), F.col("runs").alias("_rb"), F.col("n").alias("_nb"))
    both = cand.join(x, "a").join(y, "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [1.0 - distance(np.asarray(p), np.asarray(q)) for p, q in zip(b["_ra"], b["_rb"])]
            out = pd.DataFrame({"a": b["a"], "b": b["b"], "similarity": s})
            yield out[out["similarity"] >= t - 1e-9]

    return both.select("a", "b", "_ra", "_rb").mapInPandas(check, f"a {kind}, b {kind}, similarity double")


def classes(df: DataFrame, key: str, columns: list[str], width: int = 3) -> tuple[DataFrame, DataFrame]:
    """Members (key, class) and representatives (key, n, runs); a class's id is its least key."""
    all_sets = materialize(sets(df, key, columns, width), "sets")
    ids = all_sets.groupBy("digest").agg(F.min(key).alias("class"), F.count("*").alias("_copies"))
    # sets that stand alone need no join; only copies do (a hot copy group is split by AQE's skew join)
    members = materialize(all_sets.select(key, "digest").join(ids, "digest").select(key, "class"), "members").distinct()
    reps = all_sets.join(ids.select(F.col("class").alias(key), "digest"), [key, "digest"], "left_semi").where("n > 0").select(key, "n", "runs").dropDuplicates([key])
    return members, materialize(reps, "reps")


def similar_records(df: DataFrame, key: str = "rec_id", columns: list[str] | None = None, width: int = 5, t: float = 0.8, leaf: int = 256) -> tuple[DataFrame, DataFrame]:
    """Members (key, class) and pairs of classes (a, b, similarity)."""
    members, reps = classes(df, key, columns or ["text"], width)
    return members, materialize(similar_sets(reps, key, t, leaf), "links")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its least node): alternating large-star and small-star steps until the edges stay the same."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(small, "star")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def record_pairs(members: DataFrame, links: DataFrame, key: str = "rec_id") -> DataFrame:
    """All pairs of records (rec_a < rec_b): those of linked classes and those within a class."""
    a = members.select(F.col(key).alias("_x"), F.col("class").alias("a"))
    b = members.select(F.col(key).alias("_y"), F.col("class").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select("_x", "_y")
    within = a.join(b.withColumnRenamed("b", "a"), "a").where("_x < _y").select("_x", "_y")
    return across.unionByName(within).select(F.least("_x", "_y").alias("rec_a"), F.greatest("_x", "_y").alias("rec_b"))


COLUMNS = ["text", "content", "code"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_pairs(*similar_records(table(spark, sf_dir, "near_dedup"), "rec_id", COLUMNS, 3, 0.7))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its class of equal sets, its group of linked classes, and its class's number of links."""
    docs = table(spark, sf_dir, "near_dedup")
    members, links = similar_records(docs, "rec_id", COLUMNS, 3, 0.7)
    comp = components(members.select(F.col("class").alias("node")).distinct(), links)
    deg = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("n_links"))
    got = members.join(comp.select(F.col("node").alias("class"), F.col("component").alias("group_id")), "class").join(deg, "class", "left")
    return docs.select("rec_id").distinct().join(got, "rec_id", "left").select("rec_id", F.coalesce("class", "rec_id").alias("class_id"), F.coalesce("group_id", "rec_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
