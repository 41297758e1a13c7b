"""Queries on token ids of a public vocabulary: encoding, statistics, pruning, packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.bind import bind
from millrace.operators import tokens as K
from millrace.runtime import materialize


def t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def _encoded(s, d, keep=("doc_id",), tokenizer=K.TOKENIZER):
    return K.encode(t(s, d).where("text is not null"), "text", keep, tokenizer)


def q_encode_roundtrip(s, d):
    """TK4 to TK6: texts encoded with start and end marks and decoded again."""
    x = K.encode(t(s, d), "text", ("doc_id",), bos=True, eos=True)
    return K.decode(x).select("doc_id", F.md5("text").alias("text_md5"))


def q_pieces(s, d):
    """TK1: pieces before merging; together they are the text."""
    x = bind(t(s, d).where("text is not null"), ["doc_id", "text"], p=K.pieces(F.col("text")))
    return x.select("doc_id", (F.array_join("p", "") == F.col("text")).alias("whole"), (F.size("p") > 0).alias("some"))


def q_tokens_by_lang(s, d):
    """TK17, TK23, AG1, VA3: by language and in all: tokens, characters a token, tokens a thousand characters, and findings."""
    x = _encoded(s, d, ("doc_id", "lang", "text")).select("lang", F.size("tokens").alias("n"), F.length("text").alias("c"), F.size(T.words(F.col("text"))).alias("w"))
    g = x.rollup("lang").agg(F.grouping("lang").alias("is_total"), F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum("c").alias("chars"), F.sum("w").alias("words"))
    ratio = F.col("chars") / F.nullif(F.col("tokens"), F.lit(0))
    return g.select("lang", F.col("is_total").cast("int").alias("is_total"), "docs", "tokens", F.round(ratio, 6).alias("chars_per_token"), F.round(F.lit(1000) / ratio, 6).alias("tokens_per_1k"), F.round(F.col("tokens") / F.nullif(F.col("words"), F.lit(0)), 6).alias("tokens_per_word"), F.when(ratio < 1, "warning").otherwise("ok").alias("finding"))


def q_token_frequency(s, d):
    """TK15: how often each id is used."""
    return K.frequencies(_encoded(s, d)).select("id", "n")


def q_token_curve(s, d):
    """TK15, TK21: the hundred most frequent ids with their cumulative share of all tokens."""
    f = materialize(K.frequencies(_encoded(s, d)), "frequencies")
    top = f.orderBy(F.desc("n"), "id").limit(100)  # the curve's points are the report
    w = Window.orderBy(F.desc("n"), "id")
    return top.crossJoin(F.broadcast(f.agg(F.sum("n").alias("total")))).select("id", F.row_number().over(w).cast("long").alias("rank"), F.round(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total"), 6).alias("share"))


def q_token_prune(s, d):
    """TK11, TK12: what is left of the vocabulary without tokens used once to four times, and usage by kind."""
    x = K.prune(K.vocabulary(s), K.frequencies(_encoded(s, d)), 5)
    return x.groupBy("kind").agg(F.count("*").alias("kept"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), F.max("new_id").alias("last_id"))


def q_vocab_composition(s, d):
    """TK13, TK16, TK25: tokens by kind with lengths; ids run from 0 without gaps."""
    v = K.vocabulary(s)
    ids = v.agg(((F.max("id") == F.count("*") - 1) & (F.countDistinct("id") == F.count("*"))).alias("dense"))
    return v.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("n_bytes"), 6).alias("mean_bytes"), F.min("n_bytes").alias("least"), F.max("n_bytes").alias("most")).crossJoin(F.broadcast(ids))


def q_vocab_coverage(s, d):
    """TK14: share of the pieces that are tokens of the vocabulary, by language."""
    a = K.alphabet()
    v = K.vocabulary(s).where("kind <> 'special'").select("token")
    # a piece in the printable alphabet: spaces and line ends have signs of their own, ASCII letters are themselves
    x = t(s, d).where("text is not null").select("lang", F.explode(K.pieces(F.col("text"))).alias("p")).groupBy("lang", "p").agg(F.count("*").alias("n"))
    plain = x.where(F.col("p").rlike("^[\\x20-\\x7e]+$")).withColumn("token", F.replace("p", F.lit(" "), F.lit(a[32])))
    hit = plain.join(F.broadcast(v.withColumn("known", F.lit(True))), "token", "left")
    return hit.groupBy("lang").agg(F.sum("n").alias("pieces"), F.round(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"))


def q_tokenizer_compare(s, d):
    """TK18: two vocabularies on the same texts, by source."""
    a, b = (_encoded(s, d, ("doc_id", "source"), k).groupBy("source").agg(F.sum(F.size("tokens")).alias(n)) for k, n in ((K.TOKENIZER, "tokens_a"), (K.OTHER, "tokens_b")))
    return a.join(b, F.equal_null(a["source"], b["source"])).select(a["source"], "tokens_a", "tokens_b", F.round(F.col("tokens_b") / F.col("tokens_a"), 6).alias("ratio"))


def q_tokenize_file(s, d, most: int = 1024):
    """TK24, SNK3: ids with marks; texts over the most are skipped, or cut where a window is asked for."""
    x = K.encode(t(s, d).where("text is not null"), "text", ("doc_id",), bos=True, eos=True)
    n = F.size("tokens")
    return x.select("doc_id", n.cast("long").alias("n"), (n <= most).alias("kept"), F.size(F.slice("tokens", 1, most)).cast("long").alias("n_cut"))


def q_token_blocks(s, d, size: int = 512):
    """PK1: blocks of the stream of all ids, with a digest of each."""
    x = K.blocks(_encoded(s, d), "doc_id", size, K.specials()["<|endoftext|>"])
    return x.select("block", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("ids_md5"))


def q_document_slices(s, d, size: int = 256):
    """PK2, BT3: slices of each text, padded, with their mask."""
    x = _encoded(s, d).select("doc_id", F.posexplode(K.document_slices(F.col("tokens"), size, K.specials()["<|endoftext|>"])).alias("slice", "ids"))
    x = bind(x, ["doc_id", "slice"], p=K.padded(F.col("ids"), F.lit(size)))
    return x.select("doc_id", F.col("slice").cast("long").alias("slice"), F.size("p.tokens").cast("long").alias("n"), F.aggregate("p.mask", F.lit(0), lambda a, b: a + b).cast("long").alias("n_real"))


def q_curriculum_lengths(s, d):
    """PK4: the greatest length at each step."""
    return t(s, d, "events").select("event_id", K.curriculum_length(F.col("event_id"), 10_000, 128, 2048).cast("long").alias("most"))


def q_length_classes(s, d):
    """BT1: sequences by the first of the bounds 128 to 8192 that holds them."""
    n = F.size(T.words(F.col("text")))
    b = F.lit(None).cast("int")
    for k in (8192, 4096, 2048, 1024, 512, 256, 128):
        b = F.when(n <= k, k).otherwise(b)
    return t(s, d).where("text is not null").groupBy(F.coalesce(b, F.lit(8192)).cast("long").alias("bound")).agg(F.count("*").alias("n"))


def _among(words):
    return lambda x: x.isin(*words)


def q_code_words(s, d):
    """TK22: keywords of six languages and different identifiers in each document."""
    x = bind(t(s, d).where("text is not null"), ["doc_id"], w=F.regexp_extract_all("text", F.lit("([\\p{L}_][\\p{L}\\p{N}_]*)")))
    n = {k: F.size(F.filter("w", _among(ks.split()))) for k, ks in K.KEYWORDS.items()}
    return x.select("doc_id", *(c.cast("long").alias(f"n_{k}") for k, c in n.items()), F.size(F.array_distinct("w")).cast("long").alias("identifiers"))


def q_identifier_parts(s, d):
    """TK22: identifiers of mixed case or with underscores, cut into words."""
    x = t(s, d).select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]+(?:[A-Z][a-z]+|_[a-z]+)+)"))).alias("ident")).distinct()
    return x.select("ident", F.array_join(K.identifier_parts(F.col("ident")), " ").alias("parts"))


def q_corpus_figures(s, d):
    """TK19: documents, words, different words and bigrams."""
    x = bind(t(s, d).where("text is not null"), ["doc_id", "text"], w=T.words(F.col("text")))
    x = bind(x, ["doc_id", "text", "w"], g=F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    one = x.agg(F.count("*").alias("docs"), F.sum(F.size("w")).alias("words"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))
    kinds = x.select(F.explode("w").alias("w")).distinct().agg(F.count("*").alias("unique_words"))
    pairs = x.select(F.explode("g").alias("g")).distinct().agg(F.count("*").alias("unique_bigrams"))
    return one.crossJoin(kinds).crossJoin(pairs)  # one row each


def q_top_bigrams(s, d):
    """TK20: the thousand most frequent bigrams."""
    x = bind(t(s, d).where("text is not null"), [], w=T.words(F.col("text")))
    g = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return x.select(F.explode(g).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(1000)


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_G = f"(select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) as g from (select {_W} as w from documents where text is not null))"
ORACLES = {
    "q_encode_roundtrip": "select doc_id, md5(text) as text_md5 from documents",
    "q_pieces": "select doc_id, true as whole, text <> '' as some from documents where text is not null",
    "q_curriculum_lengths": "select event_id, floor(128 + 1920 * least(event_id, 10000) / 10000)::bigint as most from events",
    "q_length_classes": f"select case when n <= 128 then 128 when n <= 256 then 256 when n <= 512 then 512 when n <= 1024 then 1024 when n <= 2048 then 2048 when n <= 4096 then 4096 else 8192 end::bigint as bound, count(*) as n from (select len({_W}) as n from documents where text is not null) group by 1",
    "q_code_words": "with a as (select doc_id, regexp_extract_all(text, '[\\p{L}_][\\p{L}\\p{N}_]*') as w from documents where text is not null) select doc_id, " + ", ".join(f"len(list_filter(w, lambda x: x in ({', '.join(repr(k) for k in ks.split())}))) as n_{lang}" for lang, ks in K.KEYWORDS.items()) + ", len(list_distinct(w)) as identifiers from a",
    "q_identifier_parts": "with a as (select distinct unnest(regexp_extract_all(text, '[a-z]+(?:[A-Z][a-z]+|_[a-z]+)+')) as ident from documents) select ident, array_to_string(list_transform(regexp_extract_all(ident, '[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x)), ' ') as parts from a",
    "q_corpus_figures": f"select (select count(*) from documents where text is not null) as docs, (select sum(len({_W}))::bigint from documents) as words, (select round(avg(length(text)), 4) from documents) as mean_chars, (select count(distinct w) from (select unnest({_W}) as w from documents)) as unique_words, (select count(distinct g) from {_G}) as unique_bigrams",
    "q_top_bigrams": f"select g as bigram, count(*) as n from {_G} group by g order by n desc, g limit 1000",
}
