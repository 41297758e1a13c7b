"""Queries on whole corpora: duplicates, balance, mixtures, splits, statistics, vocabulary."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.bind import bind
from millrace.operators import corpus as C
from millrace.operators.rank import ranked, ranked_within
from millrace.sources.shards import with_shards


def t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def q_exact_dedup(s, d):
    return C.exact_duplicates(t(s, d), "doc_id", T.squeeze(F.col("text")))


def q_raw_dedup(s, d):
    x = t(s, d, "near_dedup").select("rec_id", T.document_text("text", "content", "code").alias("body"))
    return C.exact_duplicates(x, "rec_id", F.col("body"))


def q_prefix_dedup(s, d):
    x = t(s, d).where(F.col("text").isNotNull()).groupBy(F.md5(F.substring("text", 1, 1000)).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return x.select("doc_id", "n")


def q_dedup_report(s, d):
    return q_exact_dedup(s, d).agg(F.count("*").alias("total"), F.sum(F.col("is_duplicate").cast("long")).alias("duplicates"), F.countDistinct("duplicate_of").alias("unique_docs"))


def q_near_dup_pairs(s, d):
    x = C.jaccard_pairs(t(s, d), "doc_id", "text")
    return x.select("a", "b", F.round("similarity", 6).alias("similarity"))


def q_near_dup_classes(s, d):
    """For each document with text, the document that stands for its shingle set in q_near_dup_pairs."""
    return C.shingle_classes(t(s, d), "doc_id", "text")


def q_near_dup_survivors(s, d):
    """Documents kept; copies of a representative, and null and empty texts, are not."""
    sets = C.shingle_sets(t(s, d), "doc_id", "text")
    return C.greedy_keep(sets, C.similar_sets(sets, "doc_id"), "doc_id")


def q_line_dedup(s, d):
    x = t(s, d).select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.length("line") >= 20)
    return x.groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("n")).where("n > 1")


def q_train_val_overlap(s, d):
    x = t(s, d).select("text", (F.col("doc_id") % 10 == 9).alias("val"))
    val = x.where("val").select("text").distinct()
    return x.where(~F.col("val")).join(val, "text", "left_semi").agg(F.count("*").alias("n_shared"))


def q_balance_down(s, d):
    x = C.first_n(t(s, d).select("doc_id", "lang"), "lang", [C.seeded("doc_id"), F.col("doc_id")], 20)
    return x.select("doc_id", "lang")


def q_balance_up(s, d):
    return C.upsample(t(s, d).where("source is not null").select("doc_id", "source"), "source", "doc_id", 300)


def q_quota(s, d):
    quota = F.when(F.col("lang") == "en", 50).when(F.col("lang") == "python", 10)
    x = t(s, d).select("doc_id", "lang")
    return C.first_n(x.where(quota.isNotNull()), "lang", [F.col("doc_id")], quota).unionByName(x.where(quota.isNull()))  # the others have no limit


def q_min_class(s, d):
    x = t(s, d).where("source is not null").select("doc_id", "source")
    least = x.groupBy("source").count().agg(F.least(F.min("count"), F.lit(10000)).alias("_k"))
    return C.first_n(x.crossJoin(F.broadcast(least)), "source", [F.col("doc_id")], F.col("_k")).select("doc_id", "source")


def q_temperature_weights(s, d):
    """MIX1: each source's own temperature (its repeats) first, then one for all."""
    own = t(s, d, "mix_sources").where("weight > 0").withColumn("weight", F.pow("weight", 1.0 / F.greatest("max_repeats", F.lit(1))))
    x = C.temperature_weights(own, 2.0)
    return x.select("mix_name", "name", F.round("mixed", 6).alias("mixed"))


def q_curriculum_asof(s, d):
    e = t(s, d, "events").select("event_id", "ts")
    sched = t(s, d, "events").where("event_id % 500 = 0").select(F.col("ts").alias("since"), F.col("value").alias("v")).groupBy("since").agg(F.max("v").alias("v"))
    return C.as_of(e, sched, "ts", "since", "v").select("event_id", F.round("v", 6).alias("v"))


def q_loss_reweight(s, d):
    """MIX3: a user's weight (k of props) times exp(0.001 mean of their last 100 losses)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(1.0))
    return t(s, d, "events").select("event_id", F.round(k * F.exp(F.avg("value").over(w) * 0.001), 6).alias("weight"))


def q_mixture_sample(s, d):
    n = t(s, d).groupBy(F.col("source").alias("name")).count()
    quota = t(s, d, "mix_sources").where("mix_name = 'base'").join(n, "name").select("name", F.least(F.floor(F.col("weight") * 500), F.col("count")).alias("k"))
    x = t(s, d).select("doc_id", F.col("source").alias("name")).join(F.broadcast(quota), "name")
    return C.first_n(x, "name", [C.seeded("doc_id"), F.col("doc_id")], F.col("k")).select("doc_id", "name")


def q_shards(s, d, n_shards: int = 7):
    return with_shards(t(s, d).select("doc_id"), ["doc_id"], shards=n_shards).select("doc_id", F.col("shard").cast("long").alias("shard"))


def q_split_random(s, d):
    x = ranked(t(s, d).select("doc_id", C.seeded("doc_id").alias("h")), ["h", "doc_id"], "rn").crossJoin(F.broadcast(t(s, d).agg(F.floor(F.count("*") * 0.05).alias("k"))))
    return x.select("doc_id", F.when(F.col("rn") < F.col("k"), "val").otherwise("train").alias("split"))


def q_split_stride(s, d):
    x = ranked_within(t(s, d).select("doc_id", "lang"), "lang", ["doc_id"], "rn")
    return x.select("doc_id", F.when(F.col("rn") % 10 == 9, "val").otherwise("train").alias("split"))


def q_length_buckets(s, d):
    n = F.length("text")
    b = F.when(n < 100, "<100").when(n < 500, "100-500").when(n < 1000, "500-1000").when(n < 5000, "1000-5000").otherwise(">5000")
    return t(s, d).where("text is not null").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def q_length_cumulative(s, d):
    n = F.length("text")
    return t(s, d).agg(*(F.sum((n >= k).cast("long")).alias(f"at_least_{k}") for k in (0, 100, 500, 1000, 5000, 10000, 50000)))


def q_dataset_stats(s, d):
    return t(s, d).where("text is not null").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"), F.countDistinct("lang").alias("langs"), F.round(F.avg(F.length("text")), 4).alias("avg_len"))


def q_length_percentiles(s, d):
    return C.index_percentile(t(s, d).where("text is not null").select(F.length("text").cast("long").alias("n")), "n", [0.25, 0.5, 0.75, 0.95, 0.99])


def q_report_rollup(s, d):
    return t(s, d).rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).withColumn("source", F.coalesce("source", F.lit("-"))).withColumn("lang", F.coalesce("lang", F.lit("-"))).groupBy("source", "lang").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


def _words(s, d):
    return t(s, d).select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))


def q_word_freq(s, d):
    return _words(s, d).groupBy("w").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def q_bigrams(s, d):
    x, w = bind(t(s, d).where("text is not null"), [], w=T.words(F.col("text"))), F.col("w")
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return x.select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


def q_corpus_stats(s, d):
    return _words(s, d).agg(F.count("*").alias("words"), F.countDistinct("w").alias("unique_words"), F.round(F.avg(F.length("w")), 6).alias("avg_word"))


def q_top_words(s, d):
    return _words(s, d).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1000)


def q_coverage_curve(s, d):
    f = _words(s, d).groupBy("w").agg(F.count("*").alias("n"))
    top = f.orderBy(F.desc("n"), "w").limit(100)  # the curve's first hundred points are the report
    w = Window.orderBy(F.desc("n"), "w")
    return top.select("w", F.row_number().over(w).cast("long").alias("rank"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum")).crossJoin(F.broadcast(f.agg(F.sum("n").alias("total")))).select("w", "rank", F.round(F.col("cum") / F.col("total"), 6).alias("share"))


def q_vocab_prune(s, d):
    f = _words(s, d).groupBy("w").agg(F.count("*").alias("n")).where("n >= 10")
    return ranked(f, [F.desc("n"), F.asc("w")], "new_id")


def q_identifiers(s, d):
    x = t(s, d).select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]+(?:[A-Z][a-z]+)+)"))).alias("ident")).distinct()
    return x.select("ident", F.array_join(F.transform(F.regexp_extract_all("ident", F.lit("([A-Z]?[a-z]+)")), F.lower), " ").alias("parts"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_W = "select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as w from documents"
_RANK = "md5(doc_id::varchar || '|42')"
_EX = "with a as (select doc_id, sha256(trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g'))) as h from documents), x as (select doc_id, case when h is null then doc_id else min(doc_id) over (partition by h) end as duplicate_of from a)"
_SH = """with a as (select doc_id, string_split(trim(regexp_replace(lower(text), '[\\s\\x0b]+', ' ', 'g')), ' ') as w from documents where text is not null and trim(text) <> ''),
 b as (select doc_id, list_sort(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end)) as s from a),
 c as (select min(doc_id) as doc_id, s from b group by s), f as (select doc_id, unnest(s) as g, len(s) as n from c),
 p as (select x.doc_id as a, y.doc_id as b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) as similarity from f x join f y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2 having count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.8)"""
ORACLES = {
    "q_exact_dedup": f"{_EX} select doc_id, duplicate_of, duplicate_of <> doc_id as is_duplicate from x",
    "q_dedup_report": f"{_EX} select count(*) as total, sum((duplicate_of <> doc_id)::bigint)::bigint as duplicates, count(distinct duplicate_of) as unique_docs from x",
    "q_raw_dedup": "with a as (select rec_id, coalesce(nullif(text, ''), nullif(content, ''), nullif(code, '')) as b from near_dedup), x as (select rec_id, case when b is null then rec_id else min(rec_id) over (partition by b) end as duplicate_of from a) select rec_id, duplicate_of, duplicate_of <> rec_id as is_duplicate from x",
    "q_prefix_dedup": "select min(doc_id) as doc_id, count(*) as n from documents where text is not null group by substring(text, 1, 1000)",
    "q_near_dup_pairs": f"{_SH} select a, b, round(similarity, 6) as similarity from p",
    "q_line_dedup": "select md5(line) as line_md5, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) where length(line) >= 20 group by line having count(*) > 1",
    "q_train_val_overlap": "select count(*) as n_shared from documents where doc_id % 10 <> 9 and text in (select text from documents where doc_id % 10 = 9 and text is not null)",
    "q_balance_down": f"select doc_id, lang from documents qualify row_number() over (partition by lang order by {_RANK}, doc_id) <= 20",
    "q_balance_up": "with a as (select doc_id, source, row_number() over (partition by source order by doc_id) as rn, count(*) over (partition by source) as n from documents where source is not null) select doc_id, source, unnest(range(greatest(300 // n + (rn <= 300 % n)::bigint, 1))) as copy from a",
    "q_quota": "select doc_id, lang from documents qualify row_number() over (partition by lang order by doc_id) <= case lang when 'en' then 50 when 'python' then 10 else 1099511627776 end",
    "q_min_class": "with k as (select least(min(n), 10000) as k from (select count(*) as n from documents where source is not null group by source)) select doc_id, source from documents, k where source is not null qualify row_number() over (partition by source order by doc_id) <= k",
    "q_temperature_weights": "with a as (select *, pow(pow(weight, 1.0::double / greatest(max_repeats, 1)), 0.5) as p from mix_sources where weight > 0) select mix_name, name, round(least(0.9, greatest(0.01, p / sum(p) over (partition by mix_name))), 6) as mixed from a",
    "q_curriculum_asof": "with s as (select ts as since, max(value) as v from events where event_id % 500 = 0 group by ts) select event_id, round(v, 6) as v from events e asof left join s on e.ts >= s.since",
    "q_loss_reweight": "select event_id, round(coalesce(json_extract(props, '$.k')::double, 1.0) * exp(avg(value) over (partition by user_id order by ts, event_id rows between 99 preceding and current row) * 0.001), 6) as weight from events",
    "q_mixture_sample": f"with k as (select m.name, least(floor(weight * 500), n)::bigint as k from mix_sources m join (select source, count(*) as n from documents group by source) c on c.source = m.name where mix_name = 'base') select doc_id, name from documents join k on source = name qualify row_number() over (partition by name order by {_RANK}, doc_id) <= any_value(k) over (partition by name)",
    "q_shards": "with a as (select doc_id, row_number() over (order by doc_id) - 1 as rn, count(*) over () // 7 as size from documents) select doc_id, least(rn // greatest(size, 1), 6) as shard from a",
    "q_split_random": f"with a as (select doc_id, row_number() over (order by {_RANK}, doc_id) as rn, floor(count(*) over () * 0.05) as k from documents) select doc_id, case when rn <= k then 'val' else 'train' end as split from a",
    "q_split_stride": "select doc_id, case when (row_number() over (partition by lang order by doc_id) - 1) % 10 = 9 then 'val' else 'train' end as split from documents",
    "q_length_buckets": "select case when length(text) < 100 then '<100' when length(text) < 500 then '100-500' when length(text) < 1000 then '500-1000' when length(text) < 5000 then '1000-5000' else '>5000' end as bucket, count(*) as n from documents where text is not null group by 1",
    "q_length_cumulative": "select " + ", ".join(f"sum((length(text) >= {k})::bigint)::bigint as at_least_{k}" for k in (0, 100, 500, 1000, 5000, 10000, 50000)) + " from documents",
    "q_dataset_stats": "select count(*) as docs, sum(strlen(text))::bigint as bytes, sum(length(text))::bigint as chars, count(distinct lang) as langs, round(avg(length(text)), 4) as avg_len from documents where text is not null",
    "q_length_percentiles": "with a as (select length(text) as n, row_number() over (order by length(text)) - 1 as rn, count(*) over () as c from documents where text is not null) select min(n) as least, " + ", ".join(f"max(case when rn = floor(c * {p}) then n end) as p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95, 0.99)) + ", max(n) as most, round(avg(n), 6) as mean from a",
    "q_report_rollup": "select coalesce(source, '-') as source, coalesce(lang, '-') as lang, sum(n)::bigint as n, sum(chars)::bigint as chars from (select source, lang, count(*) as n, sum(n_chars) as chars from documents group by rollup(source, lang)) group by 1, 2",
    "q_word_freq": f"select w, count(*) as n, count(distinct doc_id) as docs from ({_W}) group by w",
    "q_bigrams": "with a as (select regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from documents), b as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) as bigram from a) select bigram, count(*) as n from b group by bigram",
    "q_corpus_stats": f"select count(*) as words, count(distinct w) as unique_words, round(avg(length(w)), 6) as avg_word from ({_W})",
    "q_top_words": f"select w, count(*) as n from ({_W}) group by w order by n desc, w limit 1000",
    "q_coverage_curve": f"with f as (select w, count(*) as n from ({_W}) group by w), g as (select w, row_number() over (order by n desc, w) as rank, sum(n) over (order by n desc, w rows unbounded preceding) as cum, sum(n) over () as total from f) select w, rank, round(cum / total, 6) as share from g where rank <= 100",
    "q_vocab_prune": f"with f as (select w, count(*) as n from ({_W}) group by w having count(*) >= 10) select w, n, row_number() over (order by n desc, w) - 1 as new_id from f",
    "q_identifiers": "with a as (select distinct unnest(regexp_extract_all(text, '[a-z]+(?:[A-Z][a-z]+)+')) as ident from documents) select ident, array_to_string(list_transform(regexp_extract_all(ident, '[A-Z]?[a-z]+'), lambda x: lower(x)), ' ') as parts from a",
}
