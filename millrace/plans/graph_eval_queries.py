"""Queries of chunks and symbols, repositories, evaluation, reranking, memories and mixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.bind import bind
from millrace.operators import chunks as C
from millrace.operators import corpus as O
from millrace.operators import evaluation as E
from millrace.operators import repo as G
from millrace.operators import retrieval as R


def t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


# --- chunks and symbols -----------------------------------------------------------------------------------------------


def q_sentence_chunks(s, d):
    """RG2."""
    x = C.by_text(t(s, d), "doc_id", "text", C.sentence_chunks, C.CHUNK)
    return x.select("doc_id", "chunk", "start_at", F.length("text").cast("long").alias("n"))


def q_window_chunks(s, d):
    """RG5."""
    x = C.by_text(t(s, d), "doc_id", "text", C.window_chunks, C.CHUNK)
    return x.select("doc_id", "chunk", "start_at", F.length("text").cast("long").alias("n"))


def q_paragraph_chunks(s, d):
    """RG3."""
    x = bind(t(s, d).where("text is not null"), ["doc_id"], p=C.paragraph_chunks(F.col("text")))
    return x.select("doc_id", F.posexplode("p").alias("chunk", "p")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "p.start_at", F.md5("p.text").alias("text_md5"))


def q_code_chunks(s, d):
    """RG4."""
    x = bind(t(s, d).where("text is not null"), ["doc_id"], b=C.code_chunks(F.col("text")))
    return x.select("doc_id", F.posexplode("b").alias("chunk", "b")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("b").alias("text_md5"))


def q_sections(s, d):
    """RG6."""
    x = C.by_text(t(s, d), "doc_id", "text", C.sections, "section long, level long, title string, body string")
    return x.select("doc_id", "section", "level", "title", F.length("body").cast("long").alias("n_body"))


def q_symbols(s, d):
    """RG7, RG8: functions and classes of the documents that parse as Python."""
    return C.by_text(t(s, d), "doc_id", "text", C.symbols, "kind string, name string, first_line long, last_line long, parent string")


def q_symbol_usages(s, d):
    """RG11: how often a name is defined, called and referred to."""
    x = C.by_text(t(s, d), "doc_id", "text", C.usages, "name string, line long, use string")
    return x.groupBy("name", "use").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def q_functions(s, d):
    """CD5, RG9: names of functions in code documents by the language of their label."""
    x = t(s, d).where("text is not null")
    parts = [x.where(F.col("lang") == k).select("doc_id", F.posexplode(_first_group(p)).alias("at", "name")) for k, p in C.FUNCTIONS.items()]
    out = parts[0]
    for y in parts[1:]:
        out = out.unionByName(y)
    return out.select("doc_id", F.col("at").cast("long").alias("at"), F.when(F.col("name") == "", "anonymous").otherwise(F.col("name")).alias("name"))


def _first_group(p):
    n = p.replace("(?:", "").replace("\\(", "").count("(")
    found = [F.regexp_extract_all("text", F.lit(p), F.lit(i + 1)) for i in range(n)]
    out = found[0]
    for f in found[1:]:
        out = F.zip_with(out, f, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
    return out


def q_function_offsets(s, d):
    """CD5: names with offsets, Python code."""
    return C.by_text(t(s, d).where("lang = 'python'"), "doc_id", "text", C.functions_in("python"), "name string, offset long")


# --- repositories -----------------------------------------------------------------------------------------------------


def _files(s, d):
    """Documents as files of repositories of ten, each importing up to four others by name."""
    return t(s, d).where("text is not null").select(F.concat(F.lit("r"), F.expr("doc_id div 10")).alias("repo"), F.format_string("pkg/d%d/f%d.py", F.col("doc_id") % 7, "doc_id").alias("path"), "doc_id", "text", "_language")


OFFSETS = (1, 3, -1, 2)


def _found(s, d):
    own = F.array(*(F.struct(F.lit(i).alias("place"), F.format_string("pkg.f%d", F.col("doc_id") + k).alias("module")) for i, k in enumerate(OFFSETS)))
    return _files(s, d).select("repo", "path", F.inline(own))


def q_imports_all(s, d):
    """CD1: imports of all languages, by the label."""
    x = t(s, d).where("text is not null").select("doc_id", "lang", F.explode(G.imports(F.col("text"), F.col("lang"))).alias("module"))
    return x.groupBy("lang", "module").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def q_dependencies(s, d):
    """CD2."""
    return G.resolve(_files(s, d), _found(s, d)).select("repo", "src", "dst")


def q_dependents(s, d):
    """CD6: how many files import each file, and pairs that import each other."""
    e = G.resolve(_files(s, d), _found(s, d))
    n = e.select("repo", "src", "dst").distinct().groupBy("repo", F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    c = G.two_cycles(e)
    both = c.select("repo", F.col("src").alias("path")).unionByName(c.select("repo", F.col("dst").alias("path"))).groupBy("repo", "path").agg(F.count("*").alias("mutual"))
    return n.join(both, ["repo", "path"], "left").select("repo", "path", "n", F.coalesce("mutual", F.lit(0)).alias("mutual"))


def q_contexts(s, d):
    """CD3, CD4: files put together along their imports, with headers."""
    f = _files(s, d)
    x = G.contexts(f, G.resolve(f, _found(s, d))).join(f, ["repo", "path"])
    h = x.select("repo", "context", "place", F.length(G.with_header(F.col("path"), F.col("_language"), F.col("text"))).alias("n"))
    return h.groupBy("repo", F.col("context").cast("long").alias("context")).agg(F.count("*").alias("files"), F.sum("n").alias("chars"))


def q_layers(s, d):
    """CD6: files by layer of their imports; those on cycles have none."""
    f = _files(s, d)
    e = G.resolve(f, _found(s, d).where("place <> 2 or path like '%7.py'"))  # one file of ten imports the one before it too
    return G.layers(f, e).groupBy("layer").agg(F.count("*").alias("n"))


def q_project_report(s, d):
    """CD7: files, characters, lines, languages and the largest file of each repository."""
    f = _files(s, d).withColumn("lines", F.size(F.split("text", "\n", -1))).withColumn("n", F.length("text"))
    return f.groupBy("repo").agg(F.count("*").alias("files"), F.sum("n").alias("chars"), F.sum("lines").alias("lines"), F.countDistinct("_language").alias("languages"), F.max_by("path", F.struct("n", "path")).alias("largest"))


# --- evaluation -------------------------------------------------------------------------------------------------------


def _answers(s, d):
    return t(s, d, "coding_chat").where("instruction is not null and response is not null").groupBy("chat_id").agg(F.max(F.struct("received_at", "instruction", "response")).alias("x")).select("chat_id", "x.instruction", "x.response")


def q_chat_metrics(s, d):
    """EV3: the instruction stands in for the reference too."""
    x = bind(_answers(s, d), ["chat_id", "response"], p=E.word_set(F.col("instruction")), r=E.word_set(F.col("response")))
    x = x.select("chat_id", E.jaccard(F.col("r"), F.col("p")).alias("sim"), E.fluency(F.col("response")).alias("flu"), E.relevance(F.col("p"), F.col("r")).alias("rel"))
    return x.select("chat_id", F.round("sim", 6).alias("similarity"), F.round("flu", 6).alias("fluency"), F.round("rel", 6).alias("relevance"), F.round((F.col("sim") + F.col("flu") + F.col("rel")) / 3, 6).alias("overall"))


def q_instruction_metrics(s, d):
    """EV5: by kind of task: forms kept, steps, and whether the first numbers of instruction and response agree."""
    i, r = F.col("instruction"), F.col("response")
    x = _answers(s, d).select(E.category(i).alias("category"), E.complies(r, "markdown").alias("md"), E.complies(r, "json").alias("js"), E.steps(r).alias("steps"), ((E.first_number(r) != "") & (E.first_number(r) == E.first_number(i))).alias("same"), F.length(E.answer(r, "markdown")).alias("n"))
    return x.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.col("md").cast("long")).alias("n_markdown"), F.sum(F.col("js").cast("long")).alias("n_json"), F.sum("steps").cast("long").alias("steps"), F.sum((F.col("steps") >= 3).cast("long")).alias("n_enough"), F.sum(F.col("same").cast("long")).alias("n_same"), F.sum("n").alias("answer_chars"))


def q_pass_at_k(s, d):
    """EV4: tries are a user's events, passed from a value of 50."""
    x = E.pass_at_k(t(s, d, "events"), "user_id", F.col("value") > 50, 3)
    return x.select("user_id", "n", "c", F.round("pass_at_k", 6).alias("pass_at_3"))


def q_window_perplexity(s, d):
    """EV2: windows of 20 of a user's losses (value / 20) every 10."""
    x = E.window_perplexity(t(s, d, "events").withColumn("loss", F.col("value") / 20), "user_id", ["ts", "event_id"], "loss", 20, 10)
    return x.select("user_id", F.col("window").cast("long").alias("window"), F.round("perplexity", 4).alias("perplexity"))


def q_agent_runs(s, d):
    """EV6: share passed, mean steps and duration of runs (a user's events of one type)."""
    x = t(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("steps"), (F.max("value") > 90).alias("passed"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    return x.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.round(F.avg("steps"), 6).alias("mean_steps"), F.round(F.avg(F.col("us") / 1e6), 2).alias("mean_seconds"))


def q_pairwise_wins(s, d):
    """EV7: event types compared on the users that have both."""
    return E.pairwise(t(s, d, "events"), "user_id", "event_type", "value").select("a", "b", "wins_a", "wins_b", "n", F.round("rate_a", 6).alias("rate_a"))


def q_weighted_loss(s, d):
    """EV8: loss weighted by tokens (k of props), accuracy and spread by type."""
    x = t(s, d, "events").select("event_type", (F.col("value") / 100).alias("loss"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))
    m = F.sum(F.col("loss") * F.col("k")) / F.sum("k")
    return x.groupBy("event_type").agg(F.round(m, 6).alias("loss"), F.round(F.exp(m), 6).alias("perplexity"), F.round(F.avg((F.col("loss") < 0.5).cast("double")), 6).alias("accuracy"), F.round(F.stddev_pop("loss"), 6).alias("spread"))


def q_rolling_training(s, d):
    """WN1: rolling means over the last 100 steps of six metrics and throughput, by user."""
    e = t(s, d, "events").select("user_id", "ts", "event_id", (F.col("value") / 100).alias("loss"), (F.col("event_id") % 13 / 1e4).alias("lr"), (F.col("value") * 10).alias("tokens"), (F.col("event_id") % 7 + 1.0).alias("seconds"), (F.col("event_id") % 17 * 1.0).alias("memory"), (F.col("event_id") % 101 * 1.0).alias("utilization"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return e.select("event_id", *(F.round(F.avg(c).over(w), 10).alias(c) for c in ("loss", "lr", "tokens", "seconds", "memory", "utilization")), F.round(F.sum("tokens").over(w) / F.sum("seconds").over(w), 8).alias("throughput"))


def q_utilization_alerts(s, d):
    """WN2: mean of the last 60, with an alert from 60 of 100 here."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-59, 0)
    x = t(s, d, "events").select("user_id", F.round(F.avg("value").over(w), 6).alias("m"))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("m") >= 60).cast("long")).alias("alerts"), F.max("m").alias("highest"))


def q_early_stop(s, d):
    """WN3: each user's values as the losses of a run."""
    return E.early_stop(t(s, d, "events").withColumn("loss", F.col("value") / 100), "user_id", ["ts", "event_id"], "loss")


def q_stage_profile(s, d):
    """PR1: count, total, mean, least and most time by stage; least requests and latency (WN4)."""
    return t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


def q_least_loaded(s, d):
    """WN4: the provider of the fewest requests and that of the least mean latency."""
    g = t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("m"))
    return g.agg(F.min_by("event_type", F.struct("n", "event_type")).alias("fewest_requests"), F.min_by("event_type", F.struct("m", "event_type")).alias("least_latency"))


# --- retrieval and memories -------------------------------------------------------------------------------------------


def q_retrieve(s, d):
    """RT1: twenty nearest, those of a score of 0.2 or more, of them ten."""
    e = t(s, d, "embeddings")
    x = R.knn(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 20).where(F.round("score", 9) >= 0.2).where("rank <= 10")
    return x.select("query", "neighbour", F.round("score", 5).alias("score"))


def q_rerank_combined(s, d):
    """RR1 to RR5: neighbours of each query reranked by weighted, aligned scores."""
    e = t(s, d, "embeddings")
    near = R.knn(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    text = t(s, d).where("text is not null").select("doc_id", "text")
    q = bind(text.where("doc_id % 20 = 0"), [F.col("doc_id").alias("query")], qw=F.array_distinct(T.words(F.col("text"))), qn=F.length("text"))
    n = bind(text, [F.col("doc_id").alias("neighbour")], dw=F.array_distinct(T.words(F.col("text"))), dn=F.length("text"))
    x = near.join(q, "query").join(n, "neighbour")
    parts = {"keyword": R.overlap_score(F.col("qw"), F.col("dw")), "embedding": F.col("score"), "length": R.length_score(F.col("qn"), F.col("dn")), "position": 1.0 / F.col("rank")}
    x = x.select("query", "neighbour", *(c.alias(k) for k, c in parts.items()))
    return x.select("query", "neighbour", F.round(F.col("keyword") * 0.3 + F.col("embedding") * 0.4 + F.col("length") * 0.1 + F.col("position") * 0.2, 5).alias("combined"))


def q_filtered_search(s, d):
    """VS3: nearest of the same label, from vectors of the right dimension."""
    e = t(s, d, "embeddings").where(F.size("embedding") == 64)
    x = R.knn(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 100)
    a, b = e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("nl"))
    w = Window.partitionBy("query").orderBy("rank")
    return x.join(a, "query").join(b, "neighbour").where("ql = nl").withColumn("r", F.row_number().over(w)).where("r <= 3").select("query", "neighbour", F.round("score", 5).alias("score"))


def q_cross_modal(s, d):
    """VS4: vectors of even labels met with those of odd ones, normalised, by cosine."""
    e = t(s, d, "embeddings")
    x = R.knn(e.where("label % 2 = 1"), e.where("label % 2 = 0 and vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return x.select("query", "neighbour", F.round("score", 5).alias("score"))


def q_concepts(s, d):
    """SM1: repositories as concepts, in relation by sharing a source and licence; both directions of an edge."""
    n = t(s, d, "near_dedup").where("repo_name is not null").select(F.col("repo_name").alias("name"), "license", "source").distinct()
    edge = n.where("license is not null").groupBy("license").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b")
    both = edge.select(F.col("a").alias("name"), F.col("b").alias("related")).unionByName(edge.select(F.col("b").alias("name"), F.col("a").alias("related"))).distinct()
    return both.where(F.lower("related").contains("a"))


def q_memories(s, d):
    """SM2, SM3: the most recent and the most frequent document of each source, and those that speak of a queue."""
    x = t(s, d).where("source is not null")
    return x.groupBy("source").agg(F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("latest"), F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("earliest"), F.sum(F.lower("text").contains("queue").cast("long")).alias("n_queue"))


# --- mixtures, balance, splits ----------------------------------------------------------------------------------------


def q_weighted_choice(s, d):
    """MIX4: each document draws a source by weight of the base mix."""
    w = t(s, d, "mix_sources").where("mix_name = 'base'").select("name", "weight")
    return E.weighted_choice(t(s, d).select("doc_id"), E.uniform(F.col("doc_id")), w, "name", "weight").select("doc_id", "name")


def q_weighted_sample(s, d):
    """MIX5: a fifth of the documents, by the square root of their length."""
    x = t(s, d).where("n_chars > 0").select("doc_id", F.round(E.weighted_order(E.uniform(F.col("doc_id")), F.sqrt("n_chars")), 12).alias("o"))
    n = x.count() // 5
    return x.orderBy("o", "doc_id").limit(n).select("doc_id")


def q_mixtures(s, d):
    """MIX6, MIX7: all mixes: of each source its part of 500 by weight, in a seeded order."""
    n = t(s, d).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("mix_name")
    quota = t(s, d, "mix_sources").where("weight > 0").withColumn("share", F.col("weight") / F.sum("weight").over(w)).join(n, "name").select("mix_name", "name", F.least(F.floor(F.round(F.col("share") * 500, 9)), F.col("n")).cast("long").alias("k"))
    x = t(s, d).select("doc_id", F.col("source").alias("name")).join(F.broadcast(quota), "name")
    x = x.withColumn("_g", F.concat_ws("|", "mix_name", "name"))
    return O.first_n(x, "_g", [O.seeded("doc_id"), F.col("doc_id")], F.col("k")).select("mix_name", "name", "doc_id")


def q_balance_target(s, d):
    """BAL4, BAL6: two tables put together and cut to int(400 ratio) a language; other languages are left out."""
    ratio = F.create_map(*[F.lit(x) for k, v in (("en", 0.5), ("python", 0.25), ("de", 0.1)) for x in (k, v)])
    both = t(s, d).select(F.col("doc_id").alias("id"), "lang", F.lit("documents").alias("tab")).unionByName(t(s, d).select((F.col("doc_id") + 10_000_000).alias("id"), "lang", F.lit("again").alias("tab")))
    x = both.where(ratio[F.col("lang")].isNotNull())
    return O.first_n(x, "lang", [F.col("id")], F.floor(ratio[F.col("lang")] * 400)).select("id", "lang", "tab")


def q_balance_last(s, d):
    """BAL2: the last twenty of each source (BAL5)."""
    x = t(s, d).where("source is not null").select("doc_id", "source")
    return O.first_n(x, "source", [F.desc("doc_id")], 20).select("doc_id", "source")


def q_split_ordered(s, d):
    """SPL3: the first 95 % by key are for training."""
    from millrace.operators.rank import ranked

    x = ranked(t(s, d).select("doc_id"), ["doc_id"], "rn")
    n = t(s, d).count()
    return x.select("doc_id", F.when(F.col("rn") < int(0.95 * n), "train").otherwise("val").alias("split"))


def q_first_records(s, d):
    """LIM1: the first hundred documents."""
    return t(s, d).orderBy("doc_id").limit(100).select("doc_id", "n_chars")


def q_expand_examples(s, d):
    """AUG1: three variants of each instruction: with a suffix, capitalised, in lower case."""
    x = t(s, d, "coding_chat").where("instruction is not null").select("chat_id", "instruction").distinct().select("chat_id", F.col("instruction").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("v"))
    out = F.when(F.col("v") == 0, F.concat("i", F.lit(" Please explain."))).when(F.col("v") == 1, F.concat(F.upper(F.substring("i", 1, 1)), F.expr("substring(i, 2)"))).otherwise(F.lower("i"))
    return x.select("chat_id", F.col("v").cast("long").alias("variant"), F.md5(out).alias("text_md5"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_STRIP = "regexp_replace(p, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"
_DEF = r"^[^\S\n]*(?:(?:async[^\S\n]+)?(?:def|class)[^\S\n]+\w|@(?:property|staticmethod|classmethod))"
_F = "(select 'r' || (doc_id // 10) as repo, 'pkg/d' || (doc_id % 7) || '/f' || doc_id || '.py' as path, doc_id, text, _language from documents where text is not null)"
_DEP = f"(select a.repo, a.path as src, b.path as dst from (select *, unnest({list(OFFSETS)}) as k from {_F}) a join {_F} b on a.repo = b.repo and b.doc_id = a.doc_id + a.k)"
_ANS = "(select chat_id, x.i as instruction, x.r as response from (select chat_id, max(struct_pack(a := received_at, i := instruction, r := response)) as x from coding_chat where instruction is not null and response is not null group by chat_id))"
_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[\\s\\x0b]+'), lambda w: w <> ''))"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _knn(k: int, where: str = "", extra: str = "") -> str:
    return f"(select a.vec_id as query, b.vec_id as neighbour, {_COS} as score, row_number() over (partition by a.vec_id order by round({_COS}, 9) desc, b.vec_id) as rank {extra} from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 {where} qualify rank <= {k})"


def _imp() -> str:
    parts = []
    for lang, p in G.IMPORTS.items():
        n = p.replace("(?:", "").replace("\\(", "").count("(")
        g = [f"regexp_extract_all(text, {_q(p)}, {i + 1})" for i in range(n)]
        one = g[0] if n == 1 else f"list_transform(list_zip({', '.join(g)}), lambda x: coalesce({', '.join(f'nullif(x[{i + 1}], {_q("")})' for i in range(n))}))"
        parts.append(f"select doc_id, lang, unnest({one}) as module from documents where text is not null and lang = '{lang}'")
    return "(" + " union all ".join(parts) + ")"


def _fun() -> str:
    parts = []
    for lang, p in C.FUNCTIONS.items():
        n = p.replace("(?:", "").replace("\\(", "").count("(")
        g = [f"regexp_extract_all(text, {_q(p)}, {i + 1})" for i in range(n)]
        one = g[0] if n == 1 else f"list_transform(list_zip({', '.join(g)}), lambda x: coalesce({', '.join(f'nullif(x[{i + 1}], {_q("")})' for i in range(n))}))"
        parts.append(f"select doc_id, {one} as names from documents where text is not null and lang = '{lang}'")
    return "(" + " union all ".join(parts) + ")"


_CAT = "case " + " ".join("when " + " or ".join(f"contains(lower(instruction), '{w}')" for w in ws) + f" then '{k}'" for k, ws in E.TASKS.items()) + " else 'general' end"
_NUM = "regexp_extract({}, '-?\\d+\\.?\\d*', 0)"
_STEPS = r"(len(regexp_extract_all(response, '(?:\d+\.|[-*])\s*(.+)')) + len(regexp_extract_all(response, '(?i)\b(First|Second|Third|Then|Next|Finally)\s*[:.]?\s*(.+)')))"
_U = "((('0x' || substr(md5(doc_id || '|42'), 1, 8))::bigint + 0.5) / 4294967296.0)"
_RANK = "md5(doc_id::varchar || '|42')"
_MDA = r"trim(coalesce(nullif(regexp_extract(response, '(?s)```(?:json)?\s*(.*?)```', 1), ''), response))"
ORACLES = {
    "q_paragraph_chunks": f"with a as (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {_STRIP}), lambda p: p <> '') as ps from documents where text is not null), b as (select doc_id, ps, unnest(range(1, len(ps) + 1)) as i from a) select doc_id, i - 1 as chunk, coalesce(list_sum(list_transform(ps[1:i-1], lambda p: length(p) + 2)), 0)::bigint as start_at, md5(ps[i]) as text_md5 from b",
    "q_code_chunks": f"with a as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), b as (select doc_id, ls[i] as line, i, (i > 1 and regexp_matches(ls[i], {_q(_DEF)}))::int as new from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from a)), c as (select *, sum(new) over (partition by doc_id order by i) as chunk from b) select doc_id, chunk::bigint as chunk, md5(string_agg(line, chr(10) order by i)) as text_md5 from c group by doc_id, chunk",
    "q_functions": f"select doc_id, i - 1 as at, coalesce(nullif(names[i], ''), 'anonymous') as name from (select doc_id, names, unnest(range(1, len(names) + 1)) as i from {_fun()})",
    "q_imports_all": f"select lang, module, count(*) as n, count(distinct doc_id) as docs from {_imp()} where module is not null group by 1, 2",
    "q_dependencies": f"select * from {_DEP}",
    "q_dependents": f"with e as (select distinct * from {_DEP}), n as (select repo, dst as path, count(*) as n from e group by 1, 2), c as (select x.repo, x.src as path, count(*) as mutual from e x join e y on x.repo = y.repo and x.src = y.dst and x.dst = y.src and x.src <> x.dst group by 1, 2) select repo, path, n, coalesce(mutual, 0) as mutual from n left join c using (repo, path)",
    "q_project_report": f"select repo, count(*) as files, sum(length(text))::bigint as chars, sum(len(string_split(text, chr(10))))::bigint as lines, count(distinct _language) as languages, arg_max(path, struct_pack(a := length(text), b := path)) as largest from {_F} group by repo",
    "q_chat_metrics": f"with a as (select chat_id, response, {_SET.format('instruction')} as p, {_SET.format('response')} as r, list_filter(regexp_split_to_array(response, '[\\s\\x0b]+'), lambda w: w <> '') as w from {_ANS}), b as (select chat_id, case when len(p) = 0 or len(r) = 0 then 0.0 else len(list_intersect(p, r)) / len(list_distinct(list_concat(p, r))) end as sim, case when len(w) = 0 then 0.0 else (case when length(response) < 10 then 0.5 else 1.0 end) * (case when len(w) <> len(list_distinct(w)) then 0.9 else 1.0 end) end as flu, case when len(p) = 0 then 0.0 else least(1.0, len(list_intersect(p, r)) / len(p) * (case when len(list_intersect(p, {E.QUESTIONS})) > 0 then 2 else 1 end)) end as rel from a) select chat_id, round(sim, 6) as similarity, round(flu, 6)::double as fluency, round(rel, 6) as relevance, round((sim + flu + rel) / 3, 6) as overall from b",
    "q_instruction_metrics": f"with a as (select {_CAT} as category, contains(response, '```') as md, json_valid(response) as js, {_STEPS} as steps, {_NUM.format('response')} as x, {_NUM.format('instruction')} as y, length({_MDA}) as n from {_ANS}) select category, count(*) as n, sum(md::bigint)::bigint as n_markdown, sum(js::bigint)::bigint as n_json, sum(steps)::bigint as steps, sum((steps >= 3)::bigint)::bigint as n_enough, sum((x <> '' and x = y)::bigint)::bigint as n_same, sum(n)::bigint as answer_chars from a group by category",
    "q_pass_at_k": "with a as (select user_id, count(*) as n, sum((value > 50)::bigint)::bigint as c from events group by user_id) select user_id, n, c, round(case when n < 3 then case when c > 0 then 1.0 else 0.0 end when n - c < 3 then 1.0 else 1 - (n - c) / n * ((n - c - 1) / (n - 1)) * ((n - c - 2) / (n - 2)) end, 6) as pass_at_3 from a",
    "q_window_perplexity": "with a as (select user_id, value / 20 as loss, row_number() over (partition by user_id order by ts, event_id) - 1 as k from events), b as (select user_id, loss, unnest(range(greatest(0, ceil((k - 19) / 10))::bigint, k // 10 + 1)) as w from a) select user_id, w as \"window\", round(exp(avg(loss)), 4) as perplexity from b group by 1, 2",
    "q_agent_runs": "with a as (select user_id, event_type, count(*) as steps, max(value) > 90 as passed, epoch_us(max(ts)) - epoch_us(min(ts)) as us from events group by 1, 2) select event_type, count(*) as runs, round(avg(passed::int), 6) as pass_rate, round(avg(steps), 6) as mean_steps, round(avg(us / 1e6), 2) as mean_seconds from a group by 1",
    "q_pairwise_wins": "with m as (select user_id, event_type, round(avg(value), 9) as s from events group by 1, 2) select x.event_type as a, y.event_type as b, sum((x.s > y.s)::bigint)::bigint as wins_a, sum((x.s < y.s)::bigint)::bigint as wins_b, count(*) as n, round(sum((x.s > y.s)::bigint) / count(*), 6) as rate_a from m x join m y on x.user_id = y.user_id and x.event_type < y.event_type group by 1, 2",
    "q_weighted_loss": "with a as (select event_type, value / 100 as loss, coalesce(json_extract(props, '$.k')::bigint, 0) as k from events) select event_type, round(sum(loss * k) / sum(k), 6) as loss, round(exp(sum(loss * k) / sum(k)), 6) as perplexity, round(avg((loss < 0.5)::int), 6) as accuracy, round(stddev_pop(loss), 6) as spread from a group by 1",
    "q_rolling_training": "with a as (select *, value / 100 as loss, event_id % 13 / 1e4 as lr, value * 10 as tokens, event_id % 7 + 1.0 as seconds, event_id % 17 * 1.0 as memory, event_id % 101 * 1.0 as utilization from events) select event_id, " + ", ".join(f"round(avg({c}::double) over w, 10) as {c}" for c in ("loss", "lr", "tokens", "seconds", "memory", "utilization")) + ", round(sum(tokens) over w / sum(seconds::double) over w, 8) as throughput from a window w as (partition by user_id order by ts, event_id rows between 99 preceding and current row)",
    "q_utilization_alerts": "with a as (select user_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 59 preceding and current row), 6) as m from events) select user_id, count(*) as n, sum((m >= 60)::bigint)::bigint as alerts, max(m) as highest from a group by 1",
    "q_stage_profile": "select event_type, count(*) as n, round(sum(value), 3) as total, round(avg(value), 6) as mean, round(min(value), 6) as least, round(max(value), 6) as most from events group by 1",
    "q_least_loaded": "with g as (select event_type, count(*) as n, round(avg(value), 9) as m from events group by 1) select arg_min(event_type, struct_pack(a := n, b := event_type)) as fewest_requests, arg_min(event_type, struct_pack(a := m, b := event_type)) as least_latency from g",
    "q_retrieve": f"select query, neighbour, round(score, 5) as score from {_knn(20)} where round(score, 9) >= 0.2 and rank <= 10",
    "q_rerank_combined": f"with n as {_knn(10)}, w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as w, length(text) as l from documents where text is not null) select query, neighbour, round((case when len(q.w) = 0 then 0.0 else len(list_intersect(q.w, d.w)) / len(q.w) end) * 0.3 + score * 0.4 + (case when d.l < q.l then d.l / q.l when d.l > q.l * 10 then 0.5 else 1.0 end) * 0.1 + 1.0 / rank * 0.2, 5) as combined from n join w q on q.doc_id = query join w d on d.doc_id = neighbour",
    "q_filtered_search": f"select query, neighbour, round(score, 5) as score from {_knn(100, extra=', a.label as ql, b.label as nl')} where ql = nl qualify row_number() over (partition by query order by rank) <= 3",
    "q_cross_modal": f"select query, neighbour, round(score, 5) as score from {_knn(5, 'and a.label % 2 = 0 and b.label % 2 = 1')}",
    "q_concepts": "with e as (select license, min(repo_name) as a, max(repo_name) as b from near_dedup where repo_name is not null and license is not null group by 1) select distinct name, related from (select a as name, b as related from e where a <> b union all select b, a from e where a <> b) where contains(lower(related), 'a')",
    "q_memories": "select source, arg_max(doc_id, struct_pack(a := created_at, b := doc_id)) as latest, arg_min(doc_id, struct_pack(a := created_at, b := doc_id)) as earliest, sum(contains(lower(text), 'queue')::bigint)::bigint as n_queue from documents where source is not null group by 1",
    "q_weighted_choice": f"with r as (select name, (sum(weight) over (order by name) - weight) / sum(weight) over () as lo, sum(weight) over (order by name) / sum(weight) over () as hi from mix_sources where mix_name = 'base' and weight > 0) select doc_id, name from (select doc_id, {_U} as u from documents) join r on u >= lo and u < hi",
    "q_weighted_sample": f"with a as (select doc_id, round(-ln({_U}) / sqrt(n_chars), 12) as o, count(*) over () as n from documents where n_chars > 0) select doc_id from a qualify row_number() over (order by o, doc_id) <= n // 5",
    "q_mixtures": f"with k as (select mix_name, name, least(floor(round(weight / sum(weight) over (partition by mix_name) * 500, 9)), 1e15) as k0 from mix_sources where weight > 0) select mix_name, name, doc_id from documents join k on source = name qualify row_number() over (partition by mix_name, name order by {_RANK}, doc_id) <= any_value(k0) over (partition by mix_name, name)",
    "q_balance_target": "with b as (select doc_id as id, lang, 'documents' as tab from documents union all select doc_id + 10000000, lang, 'again' from documents) select id, lang, tab from b where lang in ('en', 'python', 'de') qualify row_number() over (partition by lang order by id) <= case lang when 'en' then 200 when 'python' then 100 else 40 end",
    "q_balance_last": "select doc_id, source from documents where source is not null qualify row_number() over (partition by source order by doc_id desc) <= 20",
    "q_split_ordered": "select doc_id, case when row_number() over (order by doc_id) - 1 < floor(0.95 * count(*) over ()) then 'train' else 'val' end as split from documents",
    "q_first_records": "select doc_id, n_chars from documents order by doc_id limit 100",
    "q_expand_examples": "select chat_id, v as variant, md5(case v when 0 then instruction || ' Please explain.' when 1 then upper(substr(instruction, 1, 1)) || substr(instruction, 2) else lower(instruction) end) as text_md5 from (select distinct chat_id, instruction from coding_chat where instruction is not null), (values (0), (1), (2)) t(v)",
}
