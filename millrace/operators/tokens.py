"""Token ids with a public byte-level BPE, and statistics of vocabularies (TK1, TK2, TK4 to TK7, TK11 to TK25, SNK3, SNK4).

Vocabularies are read, never trained. The rank file is a parameter; a bare name is looked up among the installed public ones.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import spread

TOKENIZER, OTHER = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
# The pattern that texts are cut by before merging, case ignored, and the special tokens.
PIECES = r"(?i)('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"
SPECIALS = ["<|pad|>", "<|unk|>", "<|startoftext|>", "<|endoftext|>"]
KEYWORDS = {
    "python": "def class import from return if elif else for while try except finally with as lambda yield pass break continue and or not in is None True False global nonlocal assert raise async await",
    "javascript": "function const let var return if else for while do switch case break continue new this class extends import export default try catch finally throw async await typeof instanceof null undefined true false",
    "rust": "fn let mut pub struct enum impl trait use mod match if else for while loop return self Self const static ref move async await where true false",
    "go": "func package import return if else for range switch case default break continue type struct interface map chan go defer var const nil true false",
    "java": "public private protected class interface extends implements static final void return if else for while do switch case break continue new this super try catch finally throw throws import package null true false",
    "sql": "SELECT FROM WHERE JOIN ON GROUP BY ORDER INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE ALTER DROP AND OR NOT NULL AS",
}


def rank_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def ranks(name: str) -> dict[bytes, int]:
    with open(rank_path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def encoding(name: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})


def alphabet() -> dict[int, str]:
    """TK2: a printable sign for each byte: itself if it is one, else the next sign from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def specials(name: str = TOKENIZER) -> dict[str, int]:
    """TK7: ids of the special tokens: those after the last rank."""
    return {t: len(ranks(name)) + i for i, t in enumerate(SPECIALS)}


def pieces(c: Column) -> Column:
    """TK1: JVM-side."""
    return F.regexp_extract_all(c, F.lit(PIECES), F.lit(1))


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = TOKENIZER, bos: bool = False, eos: bool = False, to: str = "tokens") -> DataFrame:
    """TK4, TK5: ``keep`` columns and token ids, with the ids of start and end if asked; null texts have null tokens."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    ids = specials(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        head, tail = [ids["<|startoftext|>"]] * bos, [ids["<|endoftext|>"]] * eos
        for b in batches:
            out = b[list(keep)].copy()
            out[to] = [head + enc.encode_ordinary(t) + tail if isinstance(t, str) else None for t in b[text]]
            yield out

    return spread(df.select(*dict.fromkeys([*keep, text]))).mapInPandas(run, f"{shape}, {to} array<int>")


def decode(df: DataFrame, tokens: str = "tokens", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = TOKENIZER, to: str = "text") -> DataFrame:
    """TK6: special ids are skipped, bytes that are no UTF-8 replaced."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        most = len(ranks(tokenizer))
        for b in batches:
            out = b[list(keep)].copy()
            out[to] = [None if x is None else enc.decode_bytes([int(i) for i in x if i < most]).decode("utf-8", "replace") for x in b[tokens]]
            yield out

    return df.select(*keep, tokens).mapInPandas(run, f"{shape}, {to} string")


def vocabulary(spark: SparkSession, tokenizer: str = TOKENIZER) -> DataFrame:
    """TK7: id, token (in the printable alphabet), n_bytes and kind (byte, merged, special)."""
    a = alphabet()
    rows = [(i, "".join(a[b] for b in t), len(t), "byte" if len(t) == 1 else "merged") for t, i in ranks(tokenizer).items()]
    return spark.createDataFrame(rows + [(i, t, len(t), "special") for t, i in specials(tokenizer).items()], "id int, token string, n_bytes int, kind string")


def merges(tokenizer: str) -> list[tuple[bytes, bytes]]:
    """The merges of a rank file: each longer token from the two parts that its own merging ends with."""
    known = ranks(tokenizer)
    out = []
    for token, rank in sorted(known.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: known.get(parts[i] + parts[i + 1], 1 << 60) if known.get(parts[i] + parts[i + 1], 1 << 60) < rank else 1 << 60)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out.append((parts[0], parts[1]))
    return out


def save(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> None:
    """SNK4: vocab.json, merges.txt and config.json, each a folder with one text file."""
    a = alphabet()
    vocab = {"".join(a[b] for b in t): i for t, i in ranks(tokenizer).items()} | specials(tokenizer)
    lines = [" ".join("".join(a[b] for b in p) for p in pair) for pair in merges(tokenizer)]
    config = {"vocab_size": len(vocab), "special_tokens": specials(tokenizer)}
    for name, text in (("vocab.json", json.dumps(vocab, ensure_ascii=False)), ("merges.txt", "\n".join(lines)), ("config.json", json.dumps(config))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def frequencies(encoded: DataFrame, tokens: str = "tokens") -> DataFrame:
    """TK15: id and n, combined before the shuffle."""
    return encoded.select(F.explode(tokens).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def prune(vocab: DataFrame, usage: DataFrame, least: int) -> DataFrame:
    """TK11: tokens that are used less than ``least`` times (but used) go, special and single bytes stay; new ids are dense.

    A vocabulary is small whatever the corpus, so its ids are counted in one task.
    """
    from pyspark.sql import Window

    x = vocab.join(usage, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kept = x.where((F.col("kind") != "merged") | (F.col("n") == 0) | (F.col("n") >= least))
    return kept.select("id", "token", "kind", "n", (F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("new_id"))


def blocks(encoded: DataFrame, key: str, size: int, eos: int, pad: int = 0) -> DataFrame:
    """PK1: the stream of all tokens in key order, an end mark after each text, cut into blocks; the rest is dropped.

    block, tokens. A stream shorter than a block gives one, padded.
    """
    from millrace.operators.rank import ranked

    x = encoded.where("tokens is not null").select(key, F.concat("tokens", F.array(F.lit(eos))).alias("tokens")).withColumn("_n", F.size("tokens").cast("long"))
    at = ranked(x, [key], "_rank", {"_off": "_n"})
    total = x.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # each text gives the pieces that fall into its blocks; a block's pieces are put together in order
    parts = at.select("_off", "tokens", "_n", F.explode(F.sequence(F.expr(f"_off div {size}"), F.expr(f"(_off + _n - 1) div {size}"))).alias("block"))
    lo, hi = F.greatest(F.col("block") * size - F.col("_off"), F.lit(0)), F.least((F.col("block") + 1) * size - F.col("_off"), F.col("_n"))
    cut = parts.select("block", F.struct("_off", F.slice("tokens", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("t")).alias("p"))
    whole = cut.groupBy("block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"])).alias("tokens"))
    if total < size:
        return whole.select("block", F.concat("tokens", F.array_repeat(F.lit(pad), F.lit(size) - F.size("tokens"))).alias("tokens"))
    return whole.where(F.size("tokens") == size)


def document_slices(tokens: Column, size: int, eos: int) -> Column:
    """PK2: slices of at most ``size`` tokens, the end mark on the last one if there is room."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: F.when((i + size >= F.size(tokens)) & (F.size(tokens) - i < size), F.concat(F.slice(tokens, i + 1, F.lit(size)), F.array(F.lit(eos)))).otherwise(F.slice(tokens, i + 1, F.lit(size))))


def curriculum_length(step: Column, total: int, least: int, most: int) -> Column:
    """PK4: the greatest length at a step, growing evenly."""
    return F.floor(F.lit(least) + (most - least) * F.least(step, F.lit(total)) / total).cast("int")


def padded(tokens: Column, size: Column, pad: int = 0) -> Column:
    """BT3: struct of tokens filled up to ``size`` and their mask."""
    more = F.greatest(size - F.size(tokens), F.lit(0)).cast("int")
    return F.struct(F.concat(tokens, F.array_repeat(F.lit(pad), more)).alias("tokens"), F.concat(F.transform(tokens, lambda _: F.lit(1)), F.array_repeat(F.lit(0), more)).alias("mask"))


def identifier_parts(c: Column) -> Column:
    """TK22: an identifier's words, cut at underscores and at changes of case, in lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)")), F.lower)
