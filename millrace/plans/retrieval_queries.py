"""Queries on vectors, chunks, chats, code, events and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval as R
from millrace.functions.bind import bind
from millrace.operators.corpus import first_n
from millrace.operators.rank import ranked
from millrace.operators.sequences import pack_first_fit, token_batches
from millrace.runtime import materialize
from millrace.streaming import jobs


def t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def _knn(s, d, metric):
    e = t(s, d, "embeddings")
    x = R.knn(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, metric)
    return x.select("query", "neighbour", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def q_knn_cosine(s, d):
    return _knn(s, d, "cosine").drop("rank")


def q_knn_euclid(s, d):
    return _knn(s, d, "euclidean").drop("rank")


def q_knn_dot(s, d):
    return _knn(s, d, "dot").drop("rank")


def q_knn_label_purity(s, d):
    e = t(s, d, "embeddings").select("vec_id", "label")
    x = _knn(s, d, "cosine").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("nl")), "neighbour")
    return x.groupBy("ql").agg(F.round(F.avg((F.col("ql") == F.col("nl")).cast("double")), 6).alias("purity"))


def q_hash_embedding(s, d):
    x = t(s, d).where("text is not null").select("doc_id", R.hash_embedding(F.col("text")).alias("e"))
    return x.select("doc_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.col("e")[31].alias("e31"))


def q_token_chunks(s, d):
    x = R.token_chunks(bind(t(s, d).where("text is not null"), ["doc_id"], w=T.words(F.col("text"))), ["doc_id"], "w", 128, 116, 32)
    return x.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("w_md5"))


def q_rerank_keyword(s, d):
    q = F.array(*map(F.lit, ["retry", "queue", "lock", "parser", "restart"]))
    w = T.words(F.col("text"))
    return t(s, d).where("text is not null").select("doc_id", F.round(R.overlap_score(q, w), 6).alias("overlap"), F.round(R.length_score(F.lit(40), F.length("text")), 6).alias("length_score"))


def q_hybrid_fusion(s, d):
    """RT2: for every query id, 0.7 of the semantic and 0.3 of the keyword score, either of which may be missing.

    A query's keywords are the five rarest words of its document that stand in others too; the ten documents with most of
    them are its keyword hits. Words of a document meet documents through their postings, so rare words keep that small.
    """
    sem = _knn(s, d, "cosine").select("query", F.col("neighbour").alias("doc_id"), F.col("score").alias("sem"))
    words = materialize(t(s, d).select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w")), "postings")
    freq = words.groupBy("w").agg(F.count("*").alias("f")).where("f > 1")
    own = words.where("doc_id % 20 = 0").join(freq, "w").select(F.col("doc_id").alias("query"), "w", "f")
    key = first_n(own, "query", [F.col("f"), F.col("w")], 5).select("query", "w")
    n = key.groupBy("query").agg(F.count("*").alias("n"))
    hits = key.join(words, "w").where("doc_id <> query").groupBy("query", "doc_id").agg(F.count("*").alias("c")).join(n, "query").select("query", "doc_id", (F.col("c") / F.col("n")).alias("kw"))
    kw = first_n(hits, "query", [F.desc("kw"), F.col("doc_id")], 10)
    x = sem.join(kw, ["query", "doc_id"], "full_outer")
    return x.select("query", "doc_id", F.round(F.coalesce("sem", F.lit(0.0)) * 0.7 + F.coalesce("kw", F.lit(0.0)) * 0.3, 6).alias("fused"))


def q_context_budget(s, d):
    x = R.within_budget(t(s, d).where("source is not null").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 5000)
    return x.select("doc_id", "source", "running")


def q_section_toc(s, d):
    x = t(s, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike("^#{1,6} "))
    return x.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)).cast("long").alias("level"), F.regexp_replace("line", "^#{1,6} +", "").alias("title"))


def q_line_search(s, d):
    x = t(s, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike("\\b(return|retry)\\b"))
    return x.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n"))


# Rules of the line review, with severity and cost.
RULES = [
    ("bare_except", "except:", "warning", 5), ("eval", "eval\\(", "warning", 5), ("exec", "exec\\(", "warning", 5), ("os_system", "os\\.system\\(", "warning", 5), ("subprocess_call", "subprocess\\.call\\([^,)]+\\)", "info", 1),
    ("print_concat", "print\\(.+\\+", "info", 1), ("star_import", "from \\S+ import \\*", "warning", 5), ("todo", "todo", "info", 1), ("fixme", "fixme", "info", 1), ("eq_none", "== None", "warning", 5), ("ne_none", "!= None", "warning", 5),
    ("password", "password\\s*=\\s*[\"']", "warning", 5), ("api_key", "api[_-]?key\\s*=\\s*[\"']", "warning", 5), ("secret", "secret\\s*=\\s*[\"']", "warning", 5), ("nested_loops", "for .+ in .+:\\s+for .+ in", "info", 1), ("append_concat", "\\.append\\(.+\\+", "info", 1),
]


def q_review_rules(s, d):
    lines = t(s, d).where("text is not null").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    hits = [F.sum(F.col("line").rlike("(?i)" + p).cast("long")).alias(n) for n, p, _, _ in RULES]
    x = lines.groupBy("doc_id").agg(*hits)
    cost = sum((F.col(n) * k for n, _, _, k in RULES), F.lit(0))
    return x.select("doc_id", *(F.col(n) for n, *_ in RULES), F.greatest(F.lit(0), 100 - cost).cast("long").alias("score"))


def q_imports(s, d):
    x = t(s, d).where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?m)^(?:from|import)\\s+([\\w.]+)"), F.lit(1))).alias("module"))
    return x.groupBy("module").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def q_chat_validate(s, d):
    n = F.coalesce(F.length("instruction"), F.lit(0)) + F.coalesce(F.length("response"), F.lit(0))
    reason = F.when(F.coalesce(F.trim("instruction"), F.lit("")) == "", "no_user").when(F.coalesce(F.trim("response"), F.lit("")) == "", "no_assistant").when(n < 10, "too_short").when(n > 8192, "too_long").otherwise("ok")
    return t(s, d, "coding_chat").groupBy(F.coalesce("source", F.lit("-")).alias("source"), reason.alias("reason")).agg(F.count("*").alias("n"))


def q_chat_format(s, d):
    x = t(s, d, "coding_chat").where("response is not null").select("chat_id", "received_at", F.concat(F.lit("USER: "), F.trim("instruction"), F.lit("\n\nASSISTANT: "), F.trim("response")).alias("f"))
    return x.groupBy("chat_id").agg(F.md5(F.max_by("f", F.struct("received_at", "f"))).alias("f_md5"))


def q_chat_dedup(s, d):
    x = t(s, d, "coding_chat").select("chat_id", F.md5(F.concat(F.col("instruction"), F.lit("|"), F.coalesce("response", F.lit("")))).alias("h"))
    return x.groupBy("h").agg(F.min("chat_id").alias("chat_id"), F.countDistinct("chat_id").alias("n")).select("chat_id", "n")


def q_chat_context(s, d):
    """CH11: the last ten instructions of each asker. The hot asker is cut to ten by a combined top-k, not sorted whole."""
    x = t(s, d, "coding_chat").where("asker_id is not null").select("asker_id", "created_at", "chat_id").distinct()
    salted = Window.partitionBy("asker_id", "salt").orderBy(F.desc("created_at"), F.desc("chat_id"))
    some = x.withColumn("salt", F.pmod(F.xxhash64("chat_id"), F.lit(32))).withColumn("rn", F.row_number().over(salted)).where("rn <= 10")
    return some.withColumn("rn", F.row_number().over(Window.partitionBy("asker_id").orderBy(F.desc("created_at"), F.desc("chat_id")))).where("rn <= 10").select("asker_id", "chat_id", F.col("rn").cast("long").alias("rn"))


def q_chat_last(s, d):
    return t(s, d, "coding_chat").where("asker_id is not null").groupBy("asker_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))


def q_rolling_metrics(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return t(s, d, "events").select("event_id", F.round(F.avg("value").over(w), 8).alias("mean100"), F.round(F.max("value").over(w), 6).alias("max100"))


def q_sessions(s, d):
    x = t(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    g = x.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.unix_timestamp(F.col("w.start")).alias("started"), "n", "total")


def q_provider_stats(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("requests"), F.sum((F.col("value") > 50).cast("long")).alias("errors"), F.round(F.avg("value"), 6).alias("avg_value"), F.min_by("event_id", F.struct("value", "event_id")).alias("best"))


def q_perplexity_stats(s, d):
    loss = F.col("value") / 100
    return t(s, d, "events").groupBy("event_type").agg(F.round(F.exp(F.avg(loss)), 6).alias("ppl"), F.round(F.stddev_pop(loss), 6).alias("std"), F.round(F.min(loss), 6).alias("least"), F.round(F.max(loss), 6).alias("most"))


def q_win_rate(s, d):
    """EV7: users compared pair by pair on their mean value, i < j, from ranks rather than from all pairs."""
    m = t(s, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("m"))
    g = m.groupBy("m").agg(F.count("*").alias("c"))
    total = m.agg(F.count("*").alias("n"))
    below = ranked(g, ["m"], "_r", {"below": "c"}).crossJoin(F.broadcast(total))
    return m.join(below, "m").select("user_id", F.round(F.col("below") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("win_rate"))


def q_json_props(s, d):
    x = t(s, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return x.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.countDistinct("k").alias("n_k"))


def q_fixed_blocks(s, d, size: int = 64):
    """PK1: the stream of word lengths of all documents in key order, cut into blocks of 64; the rest is dropped."""
    x = bind(t(s, d).where("text is not null"), ["doc_id"], w=T.words(F.col("text"))).withColumn("n", (F.size("w") + 1).cast("long"))
    off = ranked(x, ["doc_id"], "_r", {"off": "n"})
    flat = off.select("off", F.posexplode(F.concat("w", F.array(F.lit("<eos>")))).alias("i", "tok")).select((F.col("off") + F.col("i")).alias("pos"), "tok")
    b = flat.groupBy(F.floor(F.col("pos") / size).alias("block")).agg(F.count("*").alias("n"), F.sum(F.length("tok")).alias("chars"), F.sum((F.col("tok") == "<eos>").cast("long")).alias("ends"))
    return b.where(F.col("n") == size).select("block", "chars", "ends")


def q_pack_first_fit(s, d):
    return pack_first_fit(t(s, d).where("text is not null").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n")), "doc_id", "n", 512)


def q_batches(s, d):
    return token_batches(t(s, d).where("text is not null").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n")), "doc_id", "n", 4096)


def q_star_join_agg(s, d):
    c, o, l, n, r = (t(s, d, x) for x in ("customer", "orders", "lineitem", "nation", "region"))
    x = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


def q_pricing_summary(s, d):
    l = t(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def q_top_customers(s, d):
    o = t(s, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return o.join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "spent").orderBy(F.desc("spent"), "c_custkey").limit(20)


def q_unordered_customers(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def q_stream_wordcount(s, d):
    return jobs.word_count(s, f"{d}/documents.parquet")


def q_stream_tumbling(s, d):
    return jobs.tumbling(s, f"{d}/events.parquet")


def q_stream_dedup(s, d):
    return jobs.dedup(s, f"{d}/documents.parquet")


def q_stream_sliding(s, d):
    return jobs.tumbling(s, f"{d}/events.parquet", "2 hours", slide="1 hour")


def q_stream_sessions(s, d):
    return jobs.sessions(s, f"{d}/events.parquet")


def q_stream_counters(s, d):
    return jobs.corpus_counters(s, f"{d}/documents.parquet")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_E = "select a.vec_id as query, b.vec_id as neighbour, {e} as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 qualify row_number() over (partition by a.vec_id order by round({e}, 9) desc, b.vec_id) <= 10"
_COS, _DOT, _EUC = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "(-list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_Q = "['retry', 'queue', 'lock', 'parser', 'restart']"
_RR = f"select doc_id, round(len(list_intersect({_Q}, {_W})) / 5, 6) as overlap, round(case when length(text) < 40 then length(text) / 40 when length(text) > 400 then 0.5 else 1.0 end::double, 6) as length_score from documents where text is not null"
ORACLES = {
    "q_knn_cosine": f"select query, neighbour, round(score, 5) as score from ({_E.format(e=_COS)})",
    "q_knn_dot": f"select query, neighbour, round(score, 5) as score from ({_E.format(e=_DOT)})",
    "q_knn_euclid": f"select query, neighbour, round(score, 5) as score from ({_E.format(e=_EUC)})",
    "q_knn_label_purity": f"select q.label as ql, round(avg((q.label = n.label)::int), 6) as purity from ({_E.format(e=_COS)}) k join embeddings q on q.vec_id = k.query join embeddings n on n.vec_id = k.neighbour group by 1",
    "q_hash_embedding": "with a as (select doc_id, list_transform(range(0, 384), lambda i: (('0x' || substr(sha256(text), ((i % 32) * 2 + 1)::int, 2))::int - 128) / 128.0) as e from documents where text is not null) select doc_id, round(list_sum(e), 6) as total, e[32] as e31 from a",
    "q_token_chunks": f"""with a as (select doc_id, {_W} as w from documents where text is not null), b as (select doc_id, w, len(w) as n, list_filter(range(0, greatest(len(w), 1), 116), lambda i: i = 0 or len(w) - i >= 8) as st from a),
 c as (select doc_id, w, n, st, unnest(range(1, len(st) + 1)) as k from b), e as (select doc_id, k - 1 as chunk, case when k = len(st) and n - st[k] < 136 then w[st[k]+1:n] else w[st[k]+1:st[k]+128] end as ws from c) select doc_id, chunk, len(ws) as n, md5(array_to_string(ws, ' ')) as w_md5 from e""",
    "q_rerank_keyword": _RR,
    "q_hybrid_fusion": f"""with sem as (select query, neighbour as doc_id, round(score, 5) as sem from ({_E.format(e=_COS)})), words as (select distinct doc_id, unnest({_W}) as w from documents), freq as (select w, count(*) as f from words group by w having count(*) > 1),
 k as (select doc_id as query, w from words join freq using (w) where doc_id % 20 = 0 qualify row_number() over (partition by doc_id order by f, w) <= 5), n as (select query, count(*) as n from k group by query),
 h as (select query, doc_id, count(*) as c from k join words using (w) where doc_id <> query group by 1, 2), kw as (select query, doc_id, c / n as kw from h join n using (query) qualify row_number() over (partition by query order by c / n desc, doc_id) <= 10)
 select query, doc_id, round(coalesce(sem, 0.0) * 0.7 + coalesce(kw, 0.0) * 0.3, 6) as fused from sem full outer join kw using (query, doc_id)""",
    "q_context_budget": "select doc_id, source, running from (select doc_id, source, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding)::bigint as running from documents where source is not null) where running <= 5000",
    "q_section_toc": "with a as (select doc_id, string_split(text, chr(10)) as ls from documents), b as (select doc_id, unnest(range(1, len(ls) + 1)) as i, ls from a) select doc_id, i - 1 as line_no, length(regexp_extract(ls[i], '^(#{1,6}) ', 1)) as level, regexp_replace(ls[i], '^#{1,6} +', '') as title from b where regexp_matches(ls[i], '^#{1,6} ')",
    "q_line_search": "with a as (select doc_id, string_split(text, chr(10)) as ls from documents), b as (select doc_id, unnest(range(1, len(ls) + 1)) as i, ls from a) select doc_id, i - 1 as line_no, length(ls[i]) as n from b where regexp_matches(ls[i], '\\b(return|retry)\\b')",
    "q_review_rules": "with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null), x as (select doc_id, " + ", ".join(f"""sum(regexp_matches(line, '(?i){p.replace("'", "''")}')::bigint)::bigint as "{n}" """ for n, p, _, _ in RULES) + " from l group by doc_id) select *, greatest(0, 100 - (" + " + ".join(f'"{n}" * {k}' for n, _, _, k in RULES) + "))::bigint as score from x",
    "q_imports": "with a as (select doc_id, unnest(regexp_extract_all(text, '(?m)^(?:from|import)\\s+([\\w.]+)', 1)) as module from documents) select module, count(*) as n, count(distinct doc_id) as docs from a group by module",
    "q_chat_validate": "select coalesce(source, '-') as source, case when coalesce(trim(instruction), '') = '' then 'no_user' when coalesce(trim(response), '') = '' then 'no_assistant' when n < 10 then 'too_short' when n > 8192 then 'too_long' else 'ok' end as reason, count(*) as n from (select *, coalesce(length(instruction), 0) + coalesce(length(response), 0) as n from coding_chat) group by 1, 2",
    "q_chat_format": "with a as (select chat_id, received_at, 'USER: ' || trim(instruction) || chr(10) || chr(10) || 'ASSISTANT: ' || trim(response) as f from coding_chat where response is not null) select chat_id, md5(f) as f_md5 from a where f is not null qualify row_number() over (partition by chat_id order by received_at desc, f desc) = 1",
    "q_chat_dedup": "select min(chat_id) as chat_id, count(distinct chat_id) as n from coding_chat group by instruction || '|' || coalesce(response, '')",
    "q_chat_context": "with a as (select distinct asker_id, created_at, chat_id from coding_chat where asker_id is not null) select asker_id, chat_id, row_number() over (partition by asker_id order by created_at desc nulls last, chat_id desc) as rn from a qualify rn <= 10",
    "q_chat_last": "select asker_id, count(*) as n, max(created_at) as last_at from coding_chat where asker_id is not null group by asker_id",
    "q_rolling_metrics": "select event_id, round(avg(value) over w, 8) as mean100, round(max(value) over w, 6) as max100 from events window w as (partition by user_id order by ts, event_id rows between 99 preceding and current row)",
    "q_sessions": "with a as (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 1 hour then 1 when lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as new from events), b as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from a) select user_id, floor(epoch(min(ts)))::bigint as started, count(*) as n, round(sum(value), 4) as total from b group by user_id, sid",
    "q_provider_stats": "select event_type, count(*) as requests, sum((value > 50)::bigint)::bigint as errors, round(avg(value), 6) as avg_value, arg_min(event_id, row(value, event_id)) as best from events group by event_type",
    "q_perplexity_stats": "select event_type, round(exp(avg(value / 100)), 6) as ppl, round(stddev_pop(value / 100), 6) as std, round(min(value / 100), 6) as least, round(max(value / 100), 6) as most from events group by event_type",
    "q_win_rate": "with m as (select user_id, round(avg(value), 6) as m from events group by user_id) select user_id, round((rank() over (order by m) - 1) / greatest(count(*) over () - 1, 1), 6) as win_rate from m",
    "q_json_props": "select event_type, sum(k)::bigint as sum_k, count(distinct k) as n_k from (select event_type, json_extract(props, '$.k')::bigint as k from events) group by event_type",
    "q_fixed_blocks": f"with a as (select doc_id, list_append({_W}, '<eos>') as w from documents where text is not null), b as (select w, sum(len(w)) over (order by doc_id) - len(w) as off from a), c as (select off, w, unnest(range(1, len(w) + 1)) as i from b) select ((off + i - 1) // 64)::bigint as block, sum(length(w[i]))::bigint as chars, sum((w[i] = '<eos>')::bigint)::bigint as ends from c group by 1 having count(*) = 64",
    "q_star_join_agg": "select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as n_orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
    "q_pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "q_top_customers": "select c_custkey, c_name, round(sum(o_totalprice), 2) as spent from orders join customer on o_custkey = c_custkey group by 1, 2 order by spent desc, c_custkey limit 20",
    "q_unordered_customers": "select c_mktsegment, count(*) as n from customer where c_custkey not in (select o_custkey from orders) group by 1",
    "q_stream_wordcount": "select w, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as w from documents) group by w",
    "q_stream_tumbling": "select event_type, epoch(time_bucket(interval 1 hour, ts))::bigint as started, count(*) as n from events group by 1, 2",
    "q_stream_sliding": "select event_type, (epoch(time_bucket(interval 1 hour, ts)) - k)::bigint as started, count(*) as n from events, (values (0), (3600)) t(k) group by 1, 2",
    "q_stream_sessions": "with a as (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 1 hour then 1 when lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as new from events), b as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from a) select user_id, floor(epoch(min(ts)))::bigint as started, count(*) as n from b group by user_id, sid",
    "q_stream_counters": "select source, count(*) as docs, sum(length(text))::bigint as chars, sum(strlen(text))::bigint as bytes from documents group by source",
    "q_stream_dedup": "select count(*) as n_texts from (select distinct md5(text) from documents where text is not null)",
}
