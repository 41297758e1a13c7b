"""Queries on the text of documents: cleaning, quality, toxicity, patterns, language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import quality as Q
from millrace.functions import repetition as R
from millrace.functions import text as T
from millrace.functions.bind import bind
from millrace.functions.detect import by_pattern
from millrace.functions.language import WORDS, by_words


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def r6(x):
    return F.round(x, 6)


def q_clean_documents(s, d):
    c = F.col("text")
    x = docs(s, d).select("doc_id", T.clean(c).alias("clean")).where(F.length("clean") >= 10)
    return x.select("doc_id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("n_clean"))


def q_clean_html(s, d):
    c = F.col("text")
    x = docs(s, d).select("doc_id", T.clean_html(c).alias("t")).where(F.col("t").isNotNull())
    return x.select("doc_id", F.md5("t").alias("html_md5"), F.length("t").cast("long").alias("n"))


def q_paragraphs(s, d):
    c = F.col("text")
    x = docs(s, d).select("doc_id", F.posexplode(T.paragraphs(c)).alias("pos", "p"))
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("p").alias("p_md5"), F.length("p").cast("long").alias("n"))


def q_quality_pass_by_lang(s, d):
    """The flagship: QF1 to QF6 on cleaned texts, and what passes by language as labelled."""
    x = bind(docs(s, d).where("text is not null"), ["lang"], t=T.strip_control(T.normalize_whitespace(F.col("text"))))
    t = F.col("t")
    x = x.select("lang", "t", R.char_repetition(t).alias("grams"))
    x = x.select("lang", r6(Q.weigh(Q.score_length(t), Q.score_special(t), Q.score_repetition(t, Q.line_repetition(t), F.col("grams")), Q.score_line_lengths(t), Q.score_comments(t))).alias("q"))
    return x.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum((F.col("q") >= 0.3).cast("long")).alias("n_pass"), F.round(F.sum("q"), 3).alias("sum_q"))


def q_scores(s, d):
    c = F.col("text")
    x = docs(s, d).where((c.isNotNull()) & (F.length(c) > 0))
    return x.select("doc_id", r6(Q.score_length(c)).alias("len_score"), r6(Q.score_special(c)).alias("special_score"), r6(Q.line_repetition(c)).alias("line_rep"), r6(Q.score_line_lengths(c)).alias("line_score"), r6(Q.score_comments(c)).alias("comment_score"))


def q_text_quality(s, d):
    c = F.col("text")
    x = docs(s, d).where(c.isNotNull())
    return x.select("doc_id", r6(Q.vocabulary_richness(c)).alias("ttr"), r6(Q.sentence_variation(c)).alias("variation"))


def q_quality_issues(s, d):
    c = F.col("text")
    x = docs(s, d).where((c.isNotNull()) & (F.length(c) > 0)).select(F.explode(Q.issues(c)).alias("issue"))
    return x.groupBy("issue").agg(F.count("*").alias("n"))


def q_content_score(s, d):
    c = F.col("text")
    return docs(s, d).where(c.isNotNull()).select("doc_id", Q.content_score(c).alias("content"), r6(Q.code_score(c)).alias("code"))


def q_pii_counts(s, d):
    c = F.col("text")
    return docs(s, d).where(c.isNotNull()).select("doc_id", *(v.cast("long").alias(f"n_{k}") for k, v in Q.pii_counts(c).items()))


def q_pii_redact(s, d):
    c = F.col("text")
    return docs(s, d).where(c.isNotNull()).select("doc_id", F.md5(Q.redact(c)).alias("redacted_md5"))


def q_toxicity_eval(s, d):
    x = bind(docs(s, d).where("text is not null"), ["doc_id"], low=F.lower("text"))
    x = bind(x, ["doc_id", "low"], safe=Q.safe_context(F.col("low")))
    low, safe = F.col("low"), F.col("safe")
    x = x.select("doc_id", r6(Q.hate_score(low, safe)).alias("hate"), r6(Q.nsfw_score(low, safe)).alias("nsfw"), r6(Q.attack_score(low)).alias("attack"))
    return x.withColumn("toxic", (F.col("hate") >= 0.3) | (F.col("nsfw") >= 0.5))


def q_toxicity_stats(s, d):
    c = F.col("text")
    x = q_toxicity_eval(s, d).join(docs(s, d).select("doc_id", "source"), "doc_id")
    return x.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("n_toxic"), F.round(F.max("hate"), 6).alias("max_hate"))


def q_curate_rejects(s, d):
    c = F.col("text")
    x = docs(s, d).where(c.isNotNull()).select(F.coalesce(Q.reject_reason(c), F.lit("kept")).alias("reason"))
    return x.groupBy("reason").agg(F.count("*").alias("n"))


def q_detect_lang_words(s, d):
    c = F.col("text")
    return docs(s, d).where(c.isNotNull()).select("doc_id", by_words(c).alias("detected"))


def q_detect_lang_regex(s, d):
    c = F.col("text")
    return docs(s, d).where(c.isNotNull()).select("doc_id", by_pattern(c).alias("detected"))


def q_lang_agreement(s, d):
    c = F.col("text")
    x = docs(s, d).where(c.isNotNull()).select("lang", by_words(c).alias("detected"))
    return x.groupBy("lang", "detected").agg(F.count("*").alias("n"))


def q_score_filter_stats(s, d):
    c = F.col("text")
    x = s.read.parquet(f"{d}/scored.parquet").select("source", F.coalesce(F.col("_quality.overall_quality"), F.lit(0.0)).alias("q"))
    return x.groupBy("source").agg(F.count("*").alias("total"), F.sum((F.col("q") >= 0.3).cast("long")).alias("passed"), F.round(F.avg("q"), 6).alias("avg_quality"))


def q_issue_histogram(s, d):
    c = F.col("text")
    x = s.read.parquet(f"{d}/scored.parquet").select(F.explode("_quality.issues").alias("issue"))
    return x.groupBy("issue").agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_WS = r"replace(replace(replace(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(9), '    '), chr(160), ' '), chr(65279), '')"
_CTL = rf"regexp_replace({_WS}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
_CTLN = _CTL.replace("(text,", "(nfc_normalize(text),")
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _lines(t: str) -> str:
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _len(t: str) -> str:
    return f"(case when length({t}) < 50 then length({t}) / 50 when length({t}) > 1000000 then 1000000.0 / length({t}) else 1.0 end)"


def _spec(t: str) -> str:
    r = rf"(length(regexp_replace({t}, '[\p{{L}}\p{{N}}\s\x0b]', '', 'g')) / length({t}))"
    return f"(case when length({t}) = 0 then 0.0 when {r} > 0.4 then greatest(0.0, 1 - {r}) else 1.0 end)"


def _ll(t: str) -> str:
    n, a, b = f"len({_lines(t)})", f"(len(list_filter({_lines(t)}, lambda x: length(x) > 500)) / len({_lines(t)}))", f"(len(list_filter({_lines(t)}, lambda x: length(x) < 10)) / len({_lines(t)}))"
    return f"(case when {n} = 0 then 0.0 else greatest(0.0, 1.0 - (case when {a} > 0.3 then ({a} - 0.3) * 2 else 0.0 end) - (case when {b} > 0.5 then {b} - 0.5 else 0.0 end)) end)"


_REP = "(case when len(string_split(text, chr(10))) > 10 then 1 - len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10))) else 0.0 end)"
_CR = f"(case when len({_LINES}) > 0 then len(list_filter({_LINES}, lambda x: regexp_matches(x, '^(#|//|/\\*|\\*|--|%)'))) / len({_LINES}) end)"
_CS = f"(case when {_CR} is null then 0.5 when {_CR} < 0.01 then {_CR} / 0.01 * 0.5 when {_CR} > 0.8 then 1 - {_CR} else 1.0 end)"
_COLLAPSE = r"""array_to_string(list_transform(list_filter(list_transform(range(1, len(ls) + 1), lambda i: struct_pack(x := ls[i], b := len(list_filter(range(greatest(1, i - 2), i + 1), lambda j: regexp_replace(ls[j], '[\s\x0b]', '', 'g') = '')))), lambda p: p.b < 3), lambda p: p.x), chr(10))"""
_WORDLIST = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_low = "lower(text)"


def _safe() -> str:
    one = lambda w: f"(strpos({_low}, '{w}') > 0 and regexp_matches(substring({_low}, greatest(strpos({_low}, '{w}') - 50, 1), least(strpos({_low}, '{w}') - 1, 50) + {len(w)} + 50), 'medical|health|doctor|patient'))"
    return "(" + " or ".join(one(w) for w in Q.SAFE_WORDS) + ")"


def _sum(terms) -> str:
    return "(" + " + ".join(f"({t})::int" for t in terms) + ")"


_TOX = f"""select doc_id, round((({_sum(f"contains({_low}, '{w}')" for w in Q.HATE_WORDS)} / greatest(len(list_filter(regexp_split_to_array({_low}, '[\\s\\x0b]+'), lambda w: w <> '')) / 100, 1.0)) + least(1.0, {_sum(f"regexp_matches({_low}, '{p}')" for p in Q.HARASSMENT)} / 3)) / 2 * (case when {_safe()} then 0.5 else 1.0 end), 6) as hate,
 round({_sum(f"regexp_matches({_low}, '{p}')" for p in Q.ADULT)} / 6 * (case when {_safe()} then 0.3 else 1.0 end), 6) as nsfw, round(least(1.0, {_sum(f"regexp_matches({_low}, '{p}')" for p in Q.ATTACKS)} / 2), 6) as attack from documents where text is not null"""


def _by_words_sql() -> str:
    arr = "regexp_split_to_array(lower(text), '[\\s\\x0b]+')"
    scores = ", ".join(f"struct_pack(s := len(list_filter(list_distinct({arr}), lambda w: list_contains([{', '.join(repr(x) for x in ws)}], w))), o := {-i}, l := '{k}')" for i, (k, ws) in enumerate(WORDS.items()))
    return f"(case when text = '' then 'unknown' else list_reduce([{scores}], lambda a, b: case when b.s > a.s then b else a end).l end)"


ORACLES = {
    "q_clean_html": r"""with t as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis'), '<!--.*?-->', '', 'gs'), '<[^>]+>', ' ', 'g') as t from documents where text is not null),
 u as (select doc_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') as t from t), v as (select doc_id, regexp_replace(regexp_replace(t, '[\s\x0b]+', ' ', 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') as t from u)
 select doc_id, md5(t) as html_md5, length(t) as n from v""",
    "q_clean_documents": f"""with a as (select doc_id, string_split({_CTLN}, chr(10)) as ls from documents where text is not null), b as (select doc_id, regexp_replace({_COLLAPSE}, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') as t from a)
 select doc_id, md5(t) as clean_md5, length(t) as n_clean from b where length(t) >= 10""",
    "q_paragraphs": r"""with a as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[\s\x0b]*\n'), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: x <> '') as ps from documents where text is not null),
 b as (select doc_id, unnest(range(1, len(ps) + 1)) as i, ps from a) select doc_id, i - 1 as pos, md5(ps[i]) as p_md5, length(ps[i]) as n from b""",
    "q_quality_pass_by_lang": f"""with a as (select lang, {_CTL} as t from documents where text is not null), g as (select lang, t, {_REP.replace('text', 't')} as lr, case when length(t) > 5 then 1 - len(list_distinct(list_transform(range(1, length(t) - 4), lambda i: substr(t, i::int, 5)))) / (length(t) - 5) else 0.0 end as gr from a),
 b as (select lang, round({_len('t')} * 0.15 + {_spec('t')} * 0.25 + (case when length(t) < 100 then 1.0 when greatest(lr, gr) > 0.3 then greatest(0.0, 1 - greatest(lr, gr)) else 1.0 end) * 0.30 + {_ll('t')} * 0.10 + {_CS.replace('text', 't')} * 0.20, 6) as q from g)
 select lang, count(*) as n_docs, sum((q >= 0.3)::bigint)::bigint as n_pass, round(sum(q), 3) as sum_q from b group by lang""",
    "q_scores": f"""select doc_id, round({_len('text')}, 6) as len_score, round({_spec('text')}, 6) as special_score, round({_REP}, 6) as line_rep, round({_ll('text')}, 6) as line_score, round({_CS}, 6) as comment_score from documents where text is not null and length(text) > 0""",
    "q_text_quality": rf"""with a as (select doc_id, {_WORDLIST} as w, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda x: x <> ''), lambda x: len(list_filter(regexp_split_to_array(x, '[\s\x0b]+'), lambda y: y <> ''))::double) as n from documents where text is not null)
 select doc_id, round(case when len(w) > 0 then len(list_distinct(w)) / len(w) else 0.0 end, 6) as ttr, round(case when len(n) < 2 then 0.5 when list_avg(n) = 0 then 0.0 else least(1.0, sqrt(list_avg(list_transform(n, lambda x: (x - list_avg(n)) * (x - list_avg(n))))) / list_avg(n)) end, 6) as variation from a""",
    "q_quality_issues": r"""with a as (select list_filter([case when length(text) < 50 then 'too_short' end, case when upper(text) = text and lower(text) <> text then 'all_uppercase' end, case when length(regexp_replace(text, '[\p{L}\p{N}\s\x0b]', '', 'g')) / length(text) > 0.3 then 'too_many_symbols' end, case when (length(text) - length(replace(text, chr(10)||chr(10)||chr(10), ''))) / 3 > 3 then 'excessive_newlines' end], lambda x: x is not null) as xs from documents where text is not null and length(text) > 0)
 select issue, count(*) as n from (select unnest(xs) as issue from a) group by issue""",
    "q_content_score": rf"""select doc_id, case when length(text) < 50 then 0.0 when regexp_matches(text, '(?i){Q.SPAM}') then 0.0 when len(regexp_extract_all(text, 'https?://|www\.')) / greatest(len(list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda w: w <> '')), 1) > 0.1 then 0.3 else 0.7 end::double as content,
 round(least(1.0, 0.3 + (case when contains(text, 'import ') or contains(text, 'from ') then 0.15 else 0.0 end) + (case when contains(text, 'def ') or contains(text, 'function ') or contains(text, 'func ') then 0.2 else 0.0 end) + (case when contains(text, 'class ') then 0.15 else 0.0 end) + (case when abs(length(replace(text, '{{', '')) - length(replace(text, '}}', ''))) <= 1 then 0.2 else 0.0 end))::double, 6) as code from documents where text is not null""",
    "q_pii_counts": "select doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) as n_{k}" for k, p in Q.PII.items()) + " from documents where text is not null",
    "q_toxicity_eval": f"select *, (hate >= 0.3 or nsfw >= 0.5) as toxic from ({_TOX})",
    "q_toxicity_stats": f"select source, count(*) as n, sum((hate >= 0.3 or nsfw >= 0.5)::bigint)::bigint as n_toxic, round(max(hate), 6) as max_hate from ({_TOX}) join documents using (doc_id) group by source",
    "q_curate_rejects": "select reason, count(*) as n from (select case when length(text) < 50 or length(text) > 50000 then 'length' when regexp_matches(text, '(?i)" + "|".join(Q.BAD_PATTERNS) + "') then 'quality' when regexp_matches(lower(text), '" + "|".join(Q.CURATE_TOXIC) + "') then 'toxicity' else 'kept' end as reason from documents where text is not null) group by reason",
    "q_detect_lang_words": f"select doc_id, {_by_words_sql()} as detected from documents where text is not null",
    "q_lang_agreement": f"select lang, detected, count(*) as n from (select lang, {_by_words_sql()} as detected from documents where text is not null) group by lang, detected",
    "q_score_filter_stats": "select source, count(*) as total, sum((q >= 0.3)::bigint)::bigint as passed, round(avg(q), 6) as avg_quality from (select source, coalesce(_quality.overall_quality, 0.0) as q from scored) group by source",
    "q_issue_histogram": "select issue, count(*) as n from (select unnest(_quality.issues) as issue from scored) group by issue",
}
