"""Queries that go through files: shards, raw records, corpora, dumps, logs, manifests, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.bind import bind
from millrace.sources import files, manifest, shards
from millrace.runtime import shared_dir


def t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def folder(s, name):
    return f"{shared_dir(s)}/millrace/{name}-{uuid.uuid4().hex}"


def q_shard_roundtrip(s, d):
    """SNK1, SRC1 to SRC4: documents as gzip shards of 300 in key order, read back by shard."""
    to = folder(s, "shards")
    shards.write_shards(t(s, d).select("doc_id", "text", "source"), to, "docs", ["doc_id"], 300)
    x = shards.read_shards(s, to, "doc_id long, text string, source string", "docs")
    return x.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum(F.length("text")).alias("chars"))


def q_shard_order(s, d):
    """SRC2: shards in a seeded order, and whether their indices are continuous."""
    to = folder(s, "shards")
    shards.write_shards(t(s, d, "orders").select("o_orderkey"), to, "orders", ["o_orderkey"], 2000, False)
    known = [i for i, _ in shards.discover(s, to, "orders")]
    x = shards.read_shards(s, to, "o_orderkey long", "orders", 42).groupBy("place", "shard").agg(F.count("*").alias("n"))
    return x.select(F.col("place").cast("long").alias("place"), F.col("shard").cast("long").alias("shard"), "n", F.lit(shards.is_continuous(known)).alias("continuous"))


def q_shard_checksums(s, d):
    """SNK1, VA2: the SHA-256 of each shard's lines; every third is expected wrongly, and one is expected that isn't there."""
    to = folder(s, "shards")
    got = shards.write_shards(t(s, d, "customer").select("c_custkey", "c_mktsegment"), to, "customers", ["c_custkey"], 100)
    want = got.select("shard", F.when(F.col("shard") % 3 == 0, "x").otherwise(F.col("sha256")).alias("sha256")).where("shard <> 1").unionByName(s.createDataFrame([(-1, "x")], "shard int, sha256 string"))
    x = shards.validate_checksums(shards.read_lines(s, to, "customers"), want).join(got, "shard", "left")
    return x.select(F.col("shard").cast("long").alias("shard"), "status", "records", "sha256")


def q_create_shards(s, d):
    """SNK2: seven equal slices, the last of which takes the rest."""
    x = shards.with_shards(t(s, d).select("doc_id"), ["doc_id"], shards=7)
    return x.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def q_shard_statistics(s, d):
    """AG7: lines, records and characters by shard, and that each file takes space."""
    to = folder(s, "shards")
    shards.write_shards(t(s, d, "part").select("p_partkey", "p_name"), to, "parts", ["p_partkey"], 500)
    return shards.statistics(s, to, "parts").select(F.col("shard").cast("long").alias("shard"), "lines", "records", "text_bytes", (F.col("bytes") > 0).alias("has_bytes"))


def q_raw_union(s, d):
    """SRC6: documents as JSON lines, JSON and Parquet in one folder, read together."""
    to, x = folder(s, "raw"), t(s, d).select("doc_id", "text", "source")
    x.where("doc_id % 3 = 0").write.json(f"{to}/a")
    x.where("doc_id % 3 = 1").drop("source").write.parquet(f"{to}/b/c")
    x.where("doc_id % 3 = 2").write.option("compression", "gzip").json(f"{to}/d")
    return files.raw_records(s, to).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def q_corpus_lines(s, d):
    """SRC5, SRC7: lines that hold a text as an object, as a string or raw, and what a corpus makes of them."""
    c = T.squeeze(F.col("text"))
    literal = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    k = F.col("doc_id") % 4
    plain = F.regexp_replace(c, "[\\x00-\\x1f\\x7f]", "")
    value = F.when(k == 0, F.to_json(F.struct(c.alias("text")))).when(k == 1, F.to_json(F.struct(c.alias("content")))).when(k == 2, F.regexp_replace(literal, "[\\x00-\\x1f\\x7f]", "")).otherwise(F.concat(F.lit("# "), plain))
    x = bind(t(s, d).where("text is not null"), ["doc_id"], value=value)
    got = x.select("doc_id", files.json_line_text(F.col("value")).alias("got")).where("trim(got) <> ''")
    return got.select("doc_id", F.md5("got").alias("got_md5"))


def q_wiki_pages(s, d):
    """SRC10: documents as an XML dump in which some pages redirect or are special."""
    to, k = folder(s, "wiki"), F.col("doc_id") % 10
    plain = T.squeeze(F.regexp_replace("text", "[^\\x20-\\x7e\\n]", " "))
    page = t(s, d).where("text is not null").select(F.concat(F.when(k == 3, "Special:").otherwise("Page "), F.col("doc_id").cast("string")).alias("title"), F.when(k == 4, "Page 1").alias("redirect"), F.struct(F.concat(F.lit("= "), plain).alias("text")).alias("revision"))
    page.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(to)
    return files.wiki_dump(s, to).select("title", F.md5(T.squeeze(F.col("text"))).alias("text_md5"))


def q_acquired(s, d):
    """SRC11: by source, what length bounds and marks let through."""
    x = files.acquired(t(s, d), "text", 50, 10_000)
    return x.groupBy("source").agg(F.count("*").alias("n"), F.min(F.length("text")).cast("long").alias("least"), F.max(F.length("text")).cast("long").alias("most"))


def q_metadata_defaults(s, d):
    """SRC13: records projected on the fields of an image list, with defaults."""
    x = files.with_defaults(t(s, d, "near_dedup"), id=("rec_id", -1), caption=("text", ""), url=("repo_name", "unknown"), license=("license", "none"))
    return x.groupBy("license", "url").agg(F.count("*").alias("n"), F.sum((F.col("caption") == "").cast("long")).alias("n_blank"))


def q_metric_logs(s, d):
    """SRC14, SRC15: events as CSV and JSON logs; the last hundred steps and the best one."""
    to = folder(s, "log")
    x = t(s, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"), F.col("event_type").alias("kind"))
    x.write.option("header", "true").csv(f"{to}/csv")
    x.write.json(f"{to}/json")
    schema = "step long, loss double, kind string"
    last = files.last_steps(files.metric_log(s, f"{to}/csv", schema, "csv"), 100).select(F.lit("last").alias("what"), "step", F.round("loss", 6).alias("loss"))
    best = files.best_step(files.metric_log(s, f"{to}/json", schema)).select(F.lit("best").alias("what"), "step", F.round("loss", 6).alias("loss"))
    return last.unionByName(best)


def q_validate_jsonl(s, d):
    """VA1: documents as lines, some blank, broken, no objects, without the field or too short or long."""
    k = F.col("doc_id") % 12
    c = F.regexp_replace("text", "[\\x00-\\x1f\\x7f]", " ")
    value = F.when(k == 1, "").when(k == 2, F.lit('{"text": ')).when(k == 3, F.lit("[1, 2]")).when(k == 4, F.to_json(F.struct(c.alias("body")))).when(k == 5, F.lit('{"text": "short"}')).when(k == 6, F.concat(F.lit('{"text": "'), F.repeat(F.lit("x"), 2001), F.lit('"}'))).otherwise(F.to_json(F.struct(F.lit("a text of some length").alias("text"))))
    lines = t(s, d).where("text is not null").select((F.col("doc_id") % 5).cast("int").alias("shard"), F.col("doc_id").cast("long").alias("line_no"), value.alias("line"))
    return shards.validate_jsonl(lines, least=10, most=2000).select(F.col("shard").cast("long").alias("shard"), "line_no", "finding", "severity")


def q_manifest_totals(s, d):
    """MF1, SNK5, AG9: a manifest for each source, read back and added up by stage."""
    to = folder(s, "manifests")
    rows = t(s, d).where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).orderBy("source").collect()  # one row a source
    docs = [manifest.STAGES[len(r.source) % 3] for r in rows]
    both = [{"name": r.source, "version": "1", "stage": st, "statistics": {"records": r.n, "bytes": r.b or 0}} for r, st in zip(rows, docs)]
    x = s.createDataFrame([(__import__("json").dumps({**m, "hash": manifest.manifest_hash(m)}),) for m in both], "value string")
    x.write.text(to)
    lines = s.read.text(to).select(*(F.get_json_object("value", f"$.{k}").alias(k) for k in ("name", "stage")), *(F.get_json_object("value", f"$.statistics.{k}").cast("long").alias(k) for k in ("records", "bytes")))
    return manifest.totals(lines).select(F.coalesce("stage", F.lit("all")).alias("stage"), "datasets", "records", "bytes")


def q_thresholds(s, d):
    """VA4: statistics of the documents against limits."""
    x = t(s, d).agg(F.avg(F.length("text")).alias("mean_chars"), F.max(F.length("text")).alias("max_chars"), F.avg(F.col("text").isNull().cast("double")).alias("null_share"), F.count("*").alias("docs"))
    return manifest.check_thresholds(x, {"mean_chars": (2000, 9000), "max_chars": 1000, "null_share": 0.5, "docs": (1, 1 << 40), "absent": 1}).select("metric", F.round("value", 4).alias("value"), "finding")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_SQ = r"trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g'))"
_ORD = "select row_number() over (order by o_orderkey) - 1 as rn from orders"
ORACLES = {
    "q_shard_roundtrip": "with a as (select *, (row_number() over (order by doc_id) - 1) // 300 as shard from documents) select shard, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id, sum(length(text))::bigint as chars from a group by shard",
    "q_shard_order": f"with a as (select rn // 2000 as shard, count(*) as n from ({_ORD}) group by 1) select row_number() over (order by md5(shard || '|42')) - 1 as place, shard, n, true as continuous from a",
    "q_shard_checksums": """with a as (select (row_number() over (order by c_custkey) - 1) // 100 as shard, c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' as line from customer), b as (select shard, count(*) as records, sha256(string_agg(line || chr(10), '' order by c_custkey)) as sha256 from a group by shard)
 select shard, case when shard = 1 then 'unexpected' when shard % 3 = 0 then 'mismatch' else 'ok' end as status, records, sha256 from b union all select -1, 'missing', null, null""",
    "q_create_shards": "with a as (select doc_id, row_number() over (order by doc_id) - 1 as rn, count(*) over () // 7 as size from documents) select least(rn // greatest(size, 1), 6) as shard, count(*) as n, min(doc_id) as first_id from a group by 1",
    "q_shard_statistics": """with a as (select (row_number() over (order by p_partkey) - 1) // 500 as shard, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}' as line from part) select shard, count(*) as lines, count(*) as records, sum(strlen(line) + 1)::bigint as text_bytes, true as has_bytes from a group by shard""",
    "q_raw_union": "select case when doc_id % 3 <> 1 then source end as source, count(*) as n, sum(length(text))::bigint as chars from documents group by 1",
    "q_corpus_lines": f"with a as (select doc_id, case when doc_id % 4 < 2 then {_SQ} when doc_id % 4 = 2 then regexp_replace({_SQ}, '[\\x00-\\x1f\\x7f]', '', 'g') else '# ' || regexp_replace({_SQ}, '[\\x00-\\x1f\\x7f]', '', 'g') end as x from documents where text is not null) select doc_id, md5(x) as got_md5 from a where trim(x) <> ''",
    "q_wiki_pages": "select 'Page ' || doc_id as title, md5(trim(regexp_replace('= ' || trim(regexp_replace(regexp_replace(text, '[^\\x20-\\x7e\\n]', ' ', 'g'), '[\\s\\x0b]+', ' ', 'g')), '[\\s\\x0b]+', ' ', 'g'))) as text_md5 from documents where text is not null and doc_id % 10 not in (3, 4)",
    "q_acquired": "select source, count(*) as n, min(length(text)) as least, max(length(text)) as most from documents where length(text) between 50 and 10000 and not contains(text, '<|file') and not contains(text, '<|repository') group by source",
    "q_metadata_defaults": "select coalesce(license, 'none') as license, coalesce(repo_name, 'unknown') as url, count(*) as n, sum((coalesce(text, '') = '')::bigint)::bigint as n_blank from near_dedup group by 1, 2",
    "q_metric_logs": "(select 'last' as what, event_id as step, round(value, 6) as loss from events order by event_id desc limit 100) union all (select 'best', event_id, round(value, 6) from events order by value, event_id limit 1)",
    "q_validate_jsonl": "select doc_id % 5 as shard, doc_id as line_no, case doc_id % 12 when 1 then 'blank' when 2 then 'bad_json' when 3 then 'not_object' when 4 then 'missing' when 5 then 'short' else 'long' end as finding, case doc_id % 12 when 1 then 'warning' when 5 then 'warning' when 6 then 'info' else 'error' end as severity from documents where text is not null and doc_id % 12 between 1 and 6",
    "q_manifest_totals": "with a as (select source, case length(source) % 3 when 0 then 'raw' when 1 then 'cleaned' else 'processed' end as stage, count(*) as n, sum(strlen(text)) as b from documents where source is not null group by source) select coalesce(stage, 'all') as stage, count(*) as datasets, sum(n)::bigint as records, sum(b)::bigint as bytes from a group by rollup(stage)",
    "q_thresholds": "with a as (select avg(length(text)) as m, max(length(text))::double as x from documents) select * from (select 'mean_chars' as metric, round(m, 4) as value, case when m > 9000 then 'above' when m < 2000 then 'below' end as finding from a union all select 'max_chars', round(x, 4), case when x > 1000 then 'above' end from a) where finding is not null",
}
