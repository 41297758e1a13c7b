"""MinHash with banded LSH, substring and combined deduplication, code blocks (DD3, DD5, DD6, DD8 to DD10, DD12 to DD14, DD16, DD18)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.corpus import greedy_keep
from millrace.runtime import materialize, spread

PRIME = (1 << 31) - 1
BITS = 27  # log2 of the bits that runs looked for are marked in
FEW = 1 << 20  # keys that are broadcast at most
CHARS = 1 << 24  # characters of texts that are broadcast at most
BASE = 0x9E3779B97F4A7C15  # of the polynomial hash of runs, modulo 2^64
MIX = (1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # a run's three bits are the top ones of its hash times these


def char_shingles(text: str, width: int = 6) -> set[str]:
    """DD6: runs of ``width`` characters; the text itself if it is shorter."""
    return {text[i : i + width] for i in range(len(text) - width + 1)} if len(text) >= width else {text}


def coefficients(n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, n, dtype=np.int64), rng.integers(0, PRIME, n, dtype=np.int64)


def signature(shingles: set[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """DD8: the least (a h + b) mod 2^31 - 1 over a text's shingles for each pair of coefficients; h is CRC-32, the same everywhere."""
    h = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in shingles), np.int64, len(shingles)) % PRIME
    out = np.full(len(a), PRIME, np.int64)
    for at in range(0, len(h), 4096):  # a h stays below 2^62
        out = np.minimum(out, ((a[:, None] * h[None, at : at + 4096] + b[:, None]) % PRIME).min(1))
    return out


def _crc_tables(n: int) -> tuple[np.ndarray, int]:
    """CRC-32 of n bytes is the exclusive or of a table's entry for each place and a constant, as it is affine in the bytes."""
    zero = zlib.crc32(bytes(n))
    return np.array([[zlib.crc32(bytes(i) + bytes([b]) + bytes(n - 1 - i)) ^ zero for b in range(256)] for i in range(n)], np.uint32), zero


def different(x: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Signer:
    """``signature`` of a text's ``char_shingles``, for all runs at once and without division.

    With A = floor(a 2^64 / p) and B = floor(b 2^64 / p) + 2^31 + 2, A h + B modulo 2^64 is v 2^64 / p plus less than a third of
    2^64 / p, where v = (a h + b) mod p: it has the order of v, and v is read off its least.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, width: int = 6):
        self.a, self.b, self.width = a, b, width
        self.scale = np.array([(int(x) << 64) // PRIME for x in a], np.uint64)[:, None]
        self.shift = np.array([(int(x) << 64) // PRIME + (1 << 31) + 2 for x in b], np.uint64)[:, None]
        self.tables: dict[int, tuple[np.ndarray, int]] = {}

    def _crc(self, raw: np.ndarray, at: np.ndarray | None, count: int, n: int) -> np.ndarray:
        """Of the n bytes from each of the places, or from the first ``count`` ones."""
        if n not in self.tables:
            self.tables[n] = _crc_tables(n)
        table, zero = self.tables[n]
        out = np.full(count, zero, np.uint32)
        for i in range(n):
            out ^= table[i].take(raw[i : i + count] if at is None else raw.take(at + i))
        return out

    def hashes(self, text: str) -> np.ndarray:
        """The different CRC-32 modulo 2^31 - 1 of the text's runs."""
        count = len(text) - self.width + 1
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.intp)
        if len(raw) == len(text):
            h = self._crc(raw, None, count, self.width)
        else:  # runs of the same number of bytes together
            first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            size = first[self.width :] - first[: -self.width]
            h = np.empty(count, np.uint32)
            for n in np.flatnonzero(np.bincount(size)).tolist():
                own = np.flatnonzero(size == n)
                h[own] = self._crc(raw, first[own], len(own), n)
        return different(h).astype(np.uint64) % np.uint64(PRIME)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < self.width:
            return signature(char_shingles(text, self.width), self.a, self.b)
        h = self.hashes(text)
        low = np.full(len(self.a), ~np.uint64(0))
        for at in range(0, len(h), 1024):  # blocks that stay in the cache
            x = h[at : at + 1024] * self.scale
            x += self.shift
            np.minimum(low, x.min(1), out=low)
        high, rest = low >> np.uint64(33), low & np.uint64((1 << 33) - 1)  # floor(low p / 2^64), p = 2^31 - 1
        return (high - ((rest << np.uint64(31)) < low)).astype(np.int64)


def different_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """k, t: each different text that is neither null nor empty, with its least key.

    Digests and keys tell which row of a text that occurs again stays, and are sent to the rows. Only texts that one key has
    twice are shuffled, unless very many texts occur again.
    """
    d = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    busy = d.groupBy("h", "k").agg(F.count("*").alias("m")).groupBy("h").agg(F.sum("m").alias("c"), (F.max("m") > 1).alias("twice")).where("c > 1")
    busy = materialize(busy.select("h", "twice"), "copies")
    n, twice = busy.agg(F.count("*"), F.max("twice")).first()

    def first(x: DataFrame) -> DataFrame:
        return materialize(x.groupBy(F.sha2("t", 256).alias("s")).agg(F.min(F.struct("k", "t")).alias("x")).select("x.*"), "texts")

    if n > FEW:
        return first(d)
    if not n:
        return d.select("k", "t")
    stay = d.join(F.broadcast(busy.where("not twice")), "h", "left_semi").groupBy("h", F.unhex(F.sha2("t", 256)).alias("s")).agg(F.min("k").alias("k"))
    stay = busy.select("h").join(materialize(stay.select("h", "k"), "stay"), "h", "left").groupBy("h").agg(F.collect_list("k").alias("ks"))
    out = d.join(F.broadcast(materialize(stay, "least")), "h", "left").where("ks is null or array_contains(ks, k)").select("k", "t")
    return out.unionByName(first(d.join(F.broadcast(busy.where("twice")), "h", "left_semi"))) if twice else out


def with_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``; up to ``FEW`` keys, they are sent to the rows."""
    keys = materialize(keys.distinct(), "keys")
    return df.join(F.broadcast(keys) if keys.count() <= FEW else keys, key, "left_semi")


def signatures(df: DataFrame, key: str, text: str, n: int = 128, width: int = 6, least: int = 50) -> DataFrame:
    """key and sig of each different text of at least ``least`` characters: texts are compared once, by their least key."""
    kind = df.schema[key].dataType.simpleString()
    first = different_texts(df.where(F.length(text) >= least), key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sign = Signer(*coefficients(n), width)
        for p in batches:
            yield pd.DataFrame({key: p["k"], "sig": [sign(t).astype(np.int32) for t in p["t"]]})

    return spread(first).mapInPandas(run, f"`{key}` {kind}, sig array<int>")


def signature_similarity(a: Column, b: Column) -> Column:
    """DD12: share of equal places."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def lsh_pairs(sigs: DataFrame, key: str, bands: int = 16, t: float = 0.8) -> DataFrame:
    """DD9, DD10: a, b, similarity of signatures that share a band and agree in a share of at least ``t``.

    Only (band hash, key) is shuffled for candidates. Buckets of one signature join nothing.
    """
    n = sigs.select(F.max(F.size("sig"))).first()[0] or bands
    rows = n // bands
    flat = sigs.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, F.lit(rows))))).alias("band", "h")).select(key, "h")
    busy = flat.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    flat = materialize(flat.join(busy, "h"), "bands")
    a, b = flat.select("h", F.col(key).alias("a")), flat.select("h", F.col(key).alias("b"))
    cand = a.join(b, "h").where("a < b").select("a", "b").distinct()
    cand = materialize(cand, "candidates")
    own = with_keys(sigs, cand.select(F.explode(F.array("a", "b")).alias(key)), key)
    x = cand.join(own.select(F.col(key).alias("a"), F.col("sig").alias("_x")), "a").join(own.select(F.col(key).alias("b"), F.col("sig").alias("_y")), "b")
    return x.select("a", "b", signature_similarity(F.col("_x"), F.col("_y")).alias("similarity")).where(F.col("similarity") >= t)


def minhash_dedup(df: DataFrame, key: str, text: str, t: float = 0.8) -> DataFrame:
    """DD1, DD10, DD18: key and method (unique, exact, near): in key order, copies of an earlier text are exact, texts similar
    to a kept earlier one near. Null texts are unique."""
    d = materialize(df.select(key, F.sha2(text, 256).alias("h")), "digests")
    first = d.where("h is not null").groupBy("h").agg(F.min(key).alias("first"))
    sigs = materialize(signatures(df, key, text), "signatures")
    pairs = lsh_pairs(sigs, key, t=t)
    kept = greedy_keep(sigs.select(key), pairs, key).withColumn("_kept", F.lit(True))
    x = d.join(first, "h", "left").join(sigs.select(key, F.lit(True).alias("_sig")), key, "left").join(kept, key, "left")
    return x.select(key, F.when(F.col("first") != F.col(key), "exact").when(F.col("_sig") & F.col("_kept").isNull(), "near").otherwise("unique").alias("method"))


class Runs:
    """Polynomial hashes modulo 2^64 of runs of characters, from prefix sums: two operations a run of any width."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x & ((1 << 64) - 1), np.uint64))]) for x in (BASE, pow(BASE, -1, 1 << 64)))

    def one(self, run: str) -> int:
        c = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.powers(len(c))
        return int((c * self.up[: len(c)]).sum(dtype=np.uint64))

    def prefix(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.powers(len(c))
        out = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(c * self.up[: len(c)], out=out[1:])
        return out

    def all(self, prefix: np.ndarray, width: int) -> np.ndarray:
        x = prefix[width:] - prefix[:-width]
        x *= self.down[: len(x)]
        return x


def probe_width(n: int) -> int:
    """The largest power of four within n."""
    return 1 << ((n.bit_length() - 1) & ~1)


def substring_pairs(df: DataFrame, key: str, text: str, most: float = 0.5, chunk: int = 1 << 15) -> DataFrame:
    """DD13: a, b where the text of a stands in the longer one of b and is under ``most`` of its length; equal texts count once.

    A text that stands in another has all its runs of characters there, so a text is looked for by the run in its middle, whose
    width is the largest power of four within its length, among the runs of the others that some text looks for; what is found
    is compared in full. Only hashes of runs are shuffled; the shorter texts of the pairs that are left are sent to the longer ones,
    unless there are too many of them: then both are shuffled.
    """
    kind = df.schema[key].dataType.simpleString()
    first = different_texts(df, key, text)

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs()
        for p in batches:
            n = [len(t) for t in p["t"]]
            w = [probe_width(x) for x in n]
            h = [runs.one(t[(x - y) // 2 : (x - y) // 2 + y]) for t, x, y in zip(p["t"], n, w)]
            h = np.array(h, np.uint64)
            at = np.stack([(h * np.uint64(m)) >> np.uint64(64 - BITS) for m in MIX], 1).astype(np.int32)
            yield pd.DataFrame({"a": p["k"], "h": h.view(np.int64), "n": np.array(n, np.int32), "w": np.array(w, np.int32), "at": list(at)})

    want = materialize(spread(first).mapInPandas(probes, f"a {kind}, h long, n int, w int, at array<int>"), "probes")
    widths = sorted(r.w for r in want.select("w").distinct().collect())  # a power of four each
    # bits of the runs that are looked for: a fixed 16 MB at most, and what isn't set there never leaves its task
    log = min(BITS, max(18, (64 * want.count()).bit_length()))
    at = want.select(F.explode("at").alias("x")).select(F.shiftright("x", BITS - log).alias("x"))
    pages = at.groupBy(F.expr("x div 32768").alias("page")).agg(F.bitmap_construct_agg(F.col("x") % 32768).alias("bits")).collect()
    bits = np.zeros((1 << log) // 8, np.uint8)
    for r in pages:
        bits[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, set_ = Runs(), shared.value

        def marked(h: np.ndarray) -> np.ndarray:
            x = (h >> np.uint64(64 - log)).view(np.int64)
            return np.flatnonzero(set_[x >> 3] >> (x & 7).astype(np.uint8) & 1)

        for p in batches:
            texts, keys = p["t"].tolist(), p["k"].to_numpy()
            size = np.array([len(t) for t in texts], np.int64)
            order = np.argsort(-size, kind="stable")  # longest first: wide runs are sought in long texts only
            parts = np.unique(np.searchsorted(np.cumsum(size[order]), np.arange(0, size.sum() + chunk, chunk), side="right"))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in zip(parts, [*parts[1:], len(order)]):
                own = order[i:j]
                if not len(own):
                    continue
                end = np.cumsum(size[own])
                prefix = runs.prefix("".join([texts[k] for k in own]))
                for w in widths:
                    if w >= size[own[0]] * most:
                        break
                    h = runs.all(prefix, w)
                    hit = marked(h)
                    for m in MIX[1:]:
                        hit = hit[marked(h[hit] * np.uint64(m))]
                    k = np.searchsorted(end, hit, side="right")
                    k, hit = (x[(hit + w <= end[k]) & (w < size[own[k]] * most)] for x in (k, hit))
                    if len(hit):
                        run = different(h[hit])
                        found = different(k * len(run) + np.searchsorted(run, h[hit]))
                        out.append((own[found // len(run)], run[found % len(run)]))
            row, h = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            yield pd.DataFrame({"b": keys[row], "n": size[row].astype(np.int32), "h": h.view(np.int64)})

    have = spread(first).mapInPandas(grams, f"b {kind}, n int, h long")
    cand = have.alias("l").join(want.alias("s"), F.expr(f"l.h = s.h and s.n < l.n * {most!r}D")).select("a", "b").distinct()
    cand = materialize(cand, "candidates")
    short = with_keys(first.select(F.col("k").alias("a"), F.col("t").alias("_s")), cand.select("a"), "a")
    long_ = first.select(F.col("k").alias("b"), F.col("t").alias("_l"))
    if (want.join(cand, "a", "left_semi").agg(F.sum("n")).first()[0] or 0) > CHARS:
        x = cand.join(short, "a").join(with_keys(long_, cand.select("b"), "b"), "b")
    else:
        x = (long_.join(F.broadcast(cand), "b") if cand.count() <= FEW else cand.join(with_keys(long_, cand.select("b"), "b"), "b")).join(F.broadcast(short), "a")
    return x.where((F.length("_s") < F.length("_l") * most) & F.col("_l").contains(F.col("_s"))).select("a", "b")


def substring_survivors(df: DataFrame, key: str, text: str, among: DataFrame | None = None) -> DataFrame:
    """DD13: keys kept, longest first: a text goes if it stands in a kept longer one. ``among``: keys that alone take part, of different texts.

    Standing in is transitive, so what is in any longer text is also in one that is kept, except where the bound on lengths
    breaks the chain; then the longer text in between has gone and the rounds of ``greedy_keep`` decide.
    """
    pairs = substring_pairs(df, key, text)
    order = F.format_string("%012d|%s", F.lit(10**12) - F.length(text), F.lpad(F.col(key).cast("string"), 20, "0"))  # longest first, then by key
    names = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), order.alias("o"))
    names = materialize(names.join(among.select(F.col(key).alias("k")), "k", "left_semi") if among is not None else names, "order")
    x = pairs.join(names.select(F.col("k").alias("a"), F.col("o").alias("_a")), "a").join(names.select(F.col("k").alias("b"), F.col("o").alias("_b")), "b")
    return greedy_keep(names, x.select(F.col("_a").alias("a"), F.col("_b").alias("b")), "o").join(names, "o").select(F.col("k").alias(key))


def code_blocks(c: Column, lines: int = 10) -> Column:
    """DD16: the first lines that are neither blank nor comments, with white space squeezed."""
    own = F.filter(F.split(c, "\n", -1), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    return F.array_join(F.transform(F.slice(own, 1, lines), lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), "\n")
