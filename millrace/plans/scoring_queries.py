"""Queries of full scores, filters and language detection (QF, QS, QT, QC, TOX, PII, LD, CLN operators)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.functions import detect as D
from millrace.functions import quality as Q
from millrace.functions import repetition as R
from millrace.functions import text as T
from millrace.functions.bind import bind
from millrace.plans import text_queries as TQ


def docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


def r6(x):
    return F.round(x, 6)


# --- cleaning -------------------------------------------------------------------------------------------------------


def q_unicode_form(s, d):
    """CLN3: NFC."""
    return docs(s, d).where("text is not null").select("doc_id", F.md5(T.normalize_unicode(F.col("text"))).alias("nfc_md5"))


def q_strip_tags(s, d):
    """CLN4, CLN10."""
    c = F.col("text")
    return docs(s, d).where("text is not null").select("doc_id", F.md5(T.strip_tags(c)).alias("bare_md5"), F.length(T.trim(T.strip_control(c))).cast("long").alias("n_response"))


def q_image_urls(s, d):
    """CLN12: kind of the first address in each text."""
    url = F.regexp_extract("text", "(?:https?|s3|file)://[^\\s)>\"']+|/[\\w./-]+", 0)
    return docs(s, d).where("text is not null").select("doc_id", T.url_kind(url).alias("kind"))


# --- quality --------------------------------------------------------------------------------------------------------


def _quality(s, d):
    x = bind(docs(s, d).where("text is not null and text <> ''"), ["doc_id", "lang", "text"], line_rep=Q.line_repetition(F.col("text")), gram_rep=R.char_repetition(F.col("text")))
    return x.select("doc_id", "lang", *(f(F.col("text")).alias(n) for n, f in (("len_score", Q.score_length), ("special_score", Q.score_special), ("line_score", Q.score_line_lengths), ("comment_score", Q.score_comments))), Q.score_repetition(F.col("text"), F.col("line_rep"), F.col("gram_rep")).alias("rep_score"))


def q_quality_full(s, d):
    """QF1 to QF6."""
    x = _quality(s, d).withColumn("quality", Q.weigh(*map(F.col, ("len_score", "special_score", "rep_score", "line_score", "comment_score"))))
    return x.select("doc_id", r6("rep_score").alias("rep_score"), r6("quality").alias("quality"), (F.round("quality", 9) >= 0.3).alias("passed"))


def q_quality_filter(s, d):
    """QF7: what passes, by language as labelled."""
    x = q_quality_full(s, d).where("passed").join(docs(s, d).select("doc_id", "lang"), "doc_id")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 5).alias("mean_quality"))


def _text_score(s, d):
    c = F.col("text")
    x = bind(docs(s, d).where("text is not null and length(text) >= 10"), ["doc_id", "text"], w=T.words(c))
    x = x.select("doc_id", "text", "w", R.word_penalty(F.col("w")).alias("rep"), R.top_share(F.col("w")).alias("top"), Q.sentence_variation(c).alias("sent"), F.when(F.size("w") > 0, F.size(F.array_distinct("w")) / F.size("w")).otherwise(0.0).alias("ttr"))
    score = F.when(F.size("w") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("ttr") * 0.3 + F.col("rep") * 0.3 + F.col("sent") * 0.2 + (1 - F.col("top")) * 0.2))
    return x.select("doc_id", "text", "rep", "top", score.alias("text_score"))


def q_text_score(s, d):
    """QS2, QS6."""
    return _text_score(s, d).select("doc_id", r6("rep").alias("repetition"), r6(1 - F.col("top")).alias("diversity"), r6("text_score").alias("text_score"))


def q_content_type(s, d):
    """QS4."""
    return docs(s, d).where("text is not null").select("doc_id", Q.content_type(F.col("text")).alias("content_type"))


def q_record_scores(s, d):
    """QS10: the mean of text, code and content scores, kept from 0.3."""
    c = F.col("text")
    x = _text_score(s, d).select("doc_id", ((F.col("text_score") + Q.code_score(c) + Q.content_score(c)) / 3).alias("overall"), Q.content_type(c).alias("content_type"))
    x = x.withColumn("passed", F.round("overall", 9) >= 0.3)
    return x.groupBy("content_type").agg(F.count("*").alias("total"), F.sum(F.col("passed").cast("long")).alias("n_passed"), F.sum((~F.col("passed")).cast("long")).alias("n_failed"), F.round(F.avg("overall"), 5).alias("mean_overall"))


def q_filter_by_score(s, d, field: str = "text_score", least: float = 0.5):
    """QS11: records whose nested score reaches the threshold, a missing one counting as 0."""
    x = s.read.parquet(f"{d}/scored.parquet").select("rec_id", F.coalesce(F.col(f"_quality.{field}"), F.lit(0.0)).alias("score"))
    return x.where(F.col("score") >= least).select("rec_id", r6("score").alias("score"))


def q_quality_report(s, d):
    """QS12: averages of the nested scores."""
    fields = ["text_score", "vocabulary_richness", "repetition_penalty", "sentence_variation", "diversity", "code_score", "content_score", "overall_quality"]
    return s.read.parquet(f"{d}/scored.parquet").agg(F.count("*").alias("records"), F.count("_quality").alias("scored"), *(r6(F.avg(f"_quality.{f}")).alias(f) for f in fields))


def q_perplexity_score(s, d):
    """QS8: 100 over the perplexity of a loss column, at most 1; 0.5 without a loss. The losses are events.value / 20."""
    loss = F.when(F.col("event_id") % 7 != 0, F.col("value") / 20)
    return s.read.parquet(f"{d}/events.parquet").select("event_id", r6(Q.perplexity_score(loss)).alias("score"))


def q_prep_quality(s, d):
    """QT1, QT2: quality of prepared texts and the first ground for leaving one out."""
    c = F.col("text")
    x = bind(docs(s, d).where("text is not null"), ["doc_id", "text"], w=F.filter(F.split(c, "\\s+"), lambda x: x != ""))
    x = x.select("doc_id", F.size("w").alias("n"), Q.prep_quality(c, F.col("w")).alias("quality"))
    reason = F.when(F.col("n") == 0, "empty").when(F.col("n") < 50, "too_few_words").when(F.col("n") > 100_000, "too_many_words").when(F.round("quality", 9) < 0.3, "low_quality").otherwise("valid")
    return x.select("doc_id", F.col("n").cast("long").alias("n_words"), r6("quality").alias("quality"), reason.alias("verdict"))


def q_validate_code(s, d):
    """QC1, QC2, TOX11: lines, keyword density, suspicious calls, and the complexity of each code document."""
    c = F.col("text")
    x = docs(s, d).where("text is not null and source = 'code_files'").select("doc_id", Q.code_verdict(c, D.bucket(F.col("_language"))).alias("verdict"), Q.complexity(c).cast("long").alias("complexity"))
    return x


# --- toxicity and personal information --------------------------------------------------------------------------------


def _toxicity(s, d):
    c = F.col("text")
    x = bind(docs(s, d).where("text is not null"), ["doc_id", "source", "text"], low=F.lower(c))
    x = bind(x, ["doc_id", "source", "text", "low"], safe=Q.safe_context(F.col("low")))
    low = F.col("low")
    return x.select("doc_id", "source", Q.hate_score(low, F.col("safe")).alias("hate"), Q.nsfw_score(low, F.col("safe")).alias("nsfw"), Q.attack_score(low).alias("attack"), Q.pii_score(c).alias("pii"))


def q_toxicity_full(s, d):
    """TOX2 to TOX5, PII1: flags, the highest and the mean score."""
    x = _toxicity(s, d).withColumn("pii_capped", F.least(F.lit(1.0), "pii"))
    scores = F.array("hate", "pii_capped", "nsfw", "attack")
    toxic = (F.round("hate", 9) >= 0.3) | (F.round("pii", 9) >= 0.1) | (F.round("nsfw", 9) >= 0.5)
    return x.select("doc_id", r6("pii_capped").alias("pii"), (F.round("pii", 9) >= 0.1).alias("has_pii"), (F.round("attack", 9) > 0.3).alias("is_attack"), toxic.alias("toxic"), r6(F.array_max(scores)).alias("max_score"), r6(F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / 4).alias("avg_score"))


def q_toxicity_filter(s, d):
    """TOX6, TOX7: kept unless toxic with a score of 0.5 or more; grounds counted."""
    x = q_toxicity_full(s, d).withColumn("kept", ~F.col("toxic") | (F.col("max_score") < 0.5))
    return x.groupBy("kept", "has_pii", "is_attack").agg(F.count("*").alias("n"), F.round(F.avg("max_score"), 5).alias("mean_max"))


def q_pii_stats(s, d):
    """PII2: matches of each type in the original texts, and texts changed."""
    c = F.col("text")
    x = bind(docs(s, d).where("text is not null"), ["doc_id"], **{k: v for k, v in Q.pii_counts(c).items()}, changed=(Q.redact(c) != c))
    return x.agg(*(F.sum(F.col(k)).cast("long").alias(f"n_{k}") for k in Q.PII), F.sum(F.col("changed").cast("long")).alias("n_changed"))


def q_pii_text_prep(s, d):
    """PII3: the other redaction, in the order SSN, ID, email, phone, address."""
    c = F.col("text")
    return docs(s, d).where("text is not null").select("doc_id", F.md5(Q.redact_prep(c)).alias("redacted_md5"))


def q_safety(s, d):
    """TOX9, TOX10 on answers."""
    x = s.read.parquet(f"{d}/coding_chat.parquet").where("response is not null")
    return x.groupBy("chat_id").agg(F.max("response").alias("r")).select("chat_id", Q.is_safe(F.col("r")).alias("safe"), Q.preference_safety(F.col("r")).alias("preference"))


# --- language -------------------------------------------------------------------------------------------------------


def _paths(s, d):
    """Documents with a path made of their keys; two of three have an extension that their old label gives."""
    ext = F.create_map(*[F.lit(x) for k, v in json.loads(PATHS).items() for x in (k, v)])[F.col("_language")]
    path = F.concat(F.coalesce("repo_name", F.lit("repo")), F.lit("/f"), F.col("doc_id").cast("string"), F.coalesce(F.when(F.col("doc_id") % 3 > 0, ext), F.lit("")))
    return docs(s, d).where("text is not null").select("doc_id", "text", path.alias("path"))


PATHS = '{"python": ".py", "javascript": ".mjs", "rust": ".RS", "go": ".go", "sql": ".sql", "en": ".md", "de": ".txt"}'


def q_lang_cascade(s, d):
    """LD1 to LD5."""
    x = bind(_paths(s, d), ["doc_id", "path", "text"], head=F.lower(F.substring("text", 1, 500)))
    x = bind(x, ["doc_id", "path", "text"], content=D.by_content(F.col("text")), letters=D.by_letters(F.col("head")))
    x = bind(x, ["doc_id"], r=D.cascade(*map(F.col, ("path", "text", "content", "letters"))))
    return x.select("doc_id", "r.language", r6("r.confidence").alias("confidence"), "r.method", "r.is_code")


def q_lang_patterns(s, d):
    """LD7."""
    return docs(s, d).where("text is not null").select("doc_id", D.by_pattern(F.col("text")).alias("detected"))


def q_lang_code(s, d):
    """LD8 to LD10."""
    p, c = F.col("path"), F.col("text")
    return _paths(s, d).select("doc_id", F.coalesce(D.of_code(p, c), F.lit("-")).alias("of_code"), D.curated(p, c).alias("curated"), D.bucket(D.curated(p, c)).alias("bucket"))


def q_lang_report(s, d):
    """BAL1, BAL7, FLT1: documents and characters by detected language, without unknown ones."""
    return q_lang_patterns(s, d).where("detected <> 'unknown'").join(docs(s, d), "doc_id").groupBy("detected").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

# --- SQL ------------------------------------------------------------------------------------------------------------


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_WL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_SPLIT = r"list_filter(regexp_split_to_array(text, '[\s\x0b]+'), lambda w: w <> '')"
_LINEREP = TQ._REP
_GRAM = "(case when length(text) > 5 then 1 - len(list_distinct(list_transform(range(1, length(text) - 4), lambda i: substr(text, i::int, 5)))) / (length(text) - 5) else 0.0 end)"
_REPF = "(case when length(text) < 100 then 1.0 when greatest(lr, gr) > 0.3 then greatest(0.0, 1 - greatest(lr, gr)) else 1.0 end)"
_QF = f"""(with a as (select doc_id, lang, text, {_LINEREP} as lr, {_GRAM} as gr from documents where text is not null and text <> ''), b as (select *, {_REPF} as rep from a)
 select doc_id, lang, round(rep, 6) as rep_score, {TQ._len('text')} * 0.15 + {TQ._spec('text')} * 0.25 + rep * 0.30 + {TQ._ll('text')} * 0.10 + {TQ._CS} * 0.20 as q from b)"""


def _most(n: int) -> str:
    runs = f"list_transform(range(1, len(w) - {n - 1}), lambda i: w[i:i+{n - 1}])"
    return f"(case when len(w) > {n} then 1 - list_max(map_values(list_histogram({runs}))) / (len(w) - {n}) else 0.0 end)" if False else f"(select case when len(w) > {n} then 1 - max(c) / (len(w) - {n}) else 0.0 end from (select count(*) as c from (select unnest({runs}) as g) group by g))"


_TS = f"""(with a as (select doc_id, text, {_WL} as w from documents where text is not null and length(text) >= 10),
 g as (select doc_id, n, max(c) as m from (select doc_id, n, g, count(*) as c from (select doc_id, n, unnest(list_transform(range(1, len(w) - n + 1), lambda i: array_to_string(w[i:i+n-1], ' '))) as g from a, (values (3), (5), (10)) v(n) where len(w) > n) group by doc_id, n, g) group by doc_id, n),
 p as (select doc_id, avg(1 - m / (len(w) - n)) filter (where m < len(w) - n) as rep from g join a using (doc_id) group by doc_id),
 t as (select doc_id, max(c) as top from (select doc_id, x, count(*) as c from (select doc_id, unnest(w) as x from a) group by doc_id, x) group by doc_id),
 s as (select doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')), lambda x: x <> ''), lambda x: len(list_filter(regexp_split_to_array(x, '[\\s\\x0b]+'), lambda y: y <> ''))::double) as n from a),
 v as (select doc_id, case when len(n) < 2 then 0.5 when list_avg(n) = 0 then 0.0 else least(1.0, sqrt(list_avg(list_transform(n, lambda x: (x - list_avg(n)) * (x - list_avg(n))))) / list_avg(n)) end as sent from s)
 select doc_id, a.text, coalesce(rep, 1.0) as rep, coalesce(top / len(w), 0.0) as top, case when len(w) = 0 then 0.0 else least(1.0, len(list_distinct(w)) / len(w) * 0.3 + coalesce(rep, 1.0) * 0.3 + sent * 0.2 + (1 - top / len(w)) * 0.2) end as text_score from a left join p using (doc_id) left join t using (doc_id) left join v using (doc_id))"""
_CTYPE = "(case " + " ".join(f"when {' or '.join(f'contains(text, {_q(k)})' for k in ks)} then '{lang}'" for lang, ks in Q.CODE_WORDS.items()) + " when " + " + ".join(f"contains(text, {_q(x)})::int" for x in Q.CODE_SYMBOLS) + " >= 2 then 'code' else 'text' end)"
_CODE = "least(1.0, 0.3 + (case when contains(text, 'import ') or contains(text, 'from ') then 0.15 else 0.0 end) + (case when contains(text, 'def ') or contains(text, 'function ') or contains(text, 'func ') then 0.2 else 0.0 end) + (case when contains(text, 'class ') then 0.15 else 0.0 end) + (case when abs(length(replace(text, '{', '')) - length(replace(text, '}', ''))) <= 1 then 0.2 else 0.0 end))"
_CONTENT = f"(case when length(text) < 50 then 0.0 when regexp_matches(text, '(?i){Q.SPAM}') then 0.0 when len(regexp_extract_all(text, 'https?://|www\\.')) / greatest(len({_SPLIT}), 1) > 0.1 then 0.3 else 0.7 end)"
_FIRST = "string_split(text, chr(10))[1]"
_RUN21 = f"(len(list_filter(range(1, greatest(length({_FIRST}) - 19, 1)), lambda i: substr({_FIRST}, i::int, 21) = repeat(substr({_FIRST}, i::int, 1), 21))) > 0)"
_ONE = r"regexp_replace(text, '\n$', '')"
_PREP = f"least(1.0, greatest(0.0, (1.0 - 0.2 * ((not contains({_ONE}, chr(10)) and (length({_ONE}) <= 20 or length({_ONE}) >= 10000))::int + " + " + ".join(f"regexp_matches(text, {_q('(?i)' + p)})::int" for p in Q.LOW_QUALITY) + f" + {_RUN21}::int)) * len(list_distinct({_SPLIT})) / greatest(len({_SPLIT}), 1)))"
_LANGB = "case when _language in ('python', 'javascript', 'rust') then _language else 'other' end"
_KWD = "(case lb " + " ".join(f"when '{k}' then len(regexp_extract_all(text, {_q(p)}))" for k, p in Q.DENSITY.items()) + " else length(text) // 100 end)"
_NL = "len(string_split(text, chr(10)))"
_TOX = f"""(with a as (select doc_id, source, text, {TQ._low} as low, {TQ._safe()} as safe from documents where text is not null)
 select doc_id, ({TQ._sum(f"contains(low, '{w}')" for w in Q.HATE_WORDS)} / greatest(len(list_filter(regexp_split_to_array(low, '[\\s\\x0b]+'), lambda w: w <> '')) / 100, 1.0) + least(1.0, {TQ._sum(f"regexp_matches(low, '{p}')" for p in Q.HARASSMENT)} / 3)) / 2 * (case when safe then 0.5 else 1.0 end) as hate,
 {TQ._sum(f"regexp_matches(low, '{p}')" for p in Q.ADULT)} / 6 * (case when safe then 0.3 else 1.0 end) as nsfw, least(1.0, {TQ._sum(f"regexp_matches(low, '{p}')" for p in Q.ATTACKS)} / 2) as attack,
 ({" + ".join(f"len(regexp_extract_all(text, {_q(p)}))" for p in Q.PII.values())}) / greatest(len({_SPLIT}) / 500, 1.0) as pii from a)"""
_TOXF = f"(select doc_id, round(least(1.0, pii), 6) as pii, round(pii, 9) >= 0.1 as has_pii, round(attack, 9) > 0.3 as is_attack, round(hate, 9) >= 0.3 or round(pii, 9) >= 0.1 or round(nsfw, 9) >= 0.5 as toxic, round(greatest(hate, least(1.0, pii), nsfw, attack), 6) as max_score, round((hate + least(1.0, pii) + nsfw + attack) / 4, 6) as avg_score from {_TOX})"


def _redact(pairs) -> str:
    x = "text"
    for p, to in pairs:
        x = f"regexp_replace({x}, {_q(p)}, '{to}', 'g')"
    return x


_REDACTED = _redact((p, f"[{k.upper()}]") for k, p in Q.PII.items())


def _ext_case(known: dict[str, str]) -> str:
    return "(case ext " + " ".join(f"when '{e}' then '{lang}'" for lang, exts in known.items() for e in exts.split()) + " end)"


def _first_best(scores: list[tuple[str, str]]) -> str:
    return "list_reduce([" + ", ".join(f"struct_pack(s := ({x})::double, l := '{lang}')" for lang, x in scores) + "], lambda a, b: case when b.s > a.s then b else a end)"


_PATH = "(select doc_id, text, coalesce(repo_name, 'repo') || '/f' || doc_id || coalesce(case when doc_id % 3 > 0 then case _language " + " ".join(f"when '{k}' then '{v}'" for k, v in json.loads(PATHS).items()) + " end end, '') as path from documents where text is not null)"
_EXT = f"(select *, regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) as ext from {_PATH})"
_LD3 = _first_best([(lang, "(" + " + ".join(f"regexp_matches(text, {_q(p)})::int" for p in ps) + f") / {len(ps)}") for lang, ps in D.SIGNATURES.items()])
_LD4 = _first_best([(lang, "(" + " + ".join(f"contains(substr(lower(text), 1, 500), {_q(c)})::int" for c in sorted(set(sig))) + f") / {len(set(sig))}") for lang, sig in D.LETTERS.items()])
_SHEB = "(case " + " ".join(f"when regexp_matches({_FIRST}, '^#!.*{p}') then '{lang}'" for p, lang in D.SHEBANGS) + " end)"
_CASC = f"""with a as (select doc_id, text, {_ext_case(D.EXTENSIONS)} as e, {_SHEB} as sh, {_LD3} as c, {_LD4} as g from {_EXT}),
 b as (select doc_id, e, sh, case when length(text) >= 50 and c.s >= 0.3 then c end as c, case when length(text) >= 100 then g end as g from a)
 select doc_id, coalesce(e, sh, c.l, case when g is not null and g.s < 0.2 then 'unknown' else g.l end, 'unknown') as language, round(case when e is not null then 0.95 when sh is not null then 0.9 when c is not null then c.s when g is not null then g.s else 0.0 end, 6) as confidence,
 case when e is not null then 'extension' when sh is not null then 'shebang' when c is not null then 'content' when g is not null then 'ngram' else 'none' end as method, e is not null or sh is not null or c is not null as is_code from b"""


def _count_words(p: str) -> str:
    if p.startswith("["):
        return f"len(regexp_extract_all(low, {_q(p)}))"
    ws = sorted(set(p[3:-3].split("|")))
    return f"len(list_filter(w, lambda x: x in ({', '.join(map(_q, ws))})))"


_LD7 = f"(with a as (select doc_id, lower(text) as low, {_WL} as w from documents where text is not null), b as (select doc_id, {_first_best([(k, _count_words(p)) for k, p in D.PATTERNS.items()])} as r from a) select doc_id, case when r.s > 5 then r.l else 'unknown' end as detected from b)"
_LD8 = "coalesce(" + ", ".join([_ext_case(D.CODE_EXTENSIONS), *(f"case when {' or '.join('regexp_matches(text, ' + _q('(?m)' + p) + ')' for p in ps)} then '{lang}' end" for lang, ps in D.CODE_PATTERNS.items())]) + ", '-')"
_LD9 = f"coalesce({_ext_case(D.CURATED)}, case when not regexp_matches(text, '(?m)^import\\s+\\w+') then null when contains(text, 'from typing import') then 'python' when contains(text, 'console.log') or contains(text, 'document.') then 'javascript' when contains(text, 'func ') and contains(text, 'package ') then 'go' when contains(text, 'fn ') and contains(text, 'let ') then 'rust' end, 'unknown')"
_RESP = "(select chat_id, max(response) as r from coding_chat where response is not null group by chat_id)"
_URL = "regexp_extract(text, '(?:https?|s3|file)://[^\\s)>\"'']+|/[\\w./-]+', 0)"

ORACLES = {
    "q_unicode_form": "select doc_id, md5(nfc_normalize(text)) as nfc_md5 from documents where text is not null",
    "q_strip_tags": r"select doc_id, md5(regexp_replace(text, '<[^>]+>', '', 'g')) as bare_md5, length(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) as n_response from documents where text is not null",
    "q_image_urls": f"select doc_id, case when u like 'http://%' or u like 'https://%' then 'http' when u like 's3://%' then 's3' when u like '/%' or u like 'file://%' then 'local' else 'unknown' end as kind from (select doc_id, {_URL} as u from documents where text is not null)",
    "q_quality_full": f"select doc_id, rep_score, round(q, 6) as quality, round(q, 9) >= 0.3 as passed from {_QF}",
    "q_quality_filter": f"select lang, count(*) as n, round(avg(round(q, 6)), 5) as mean_quality from {_QF} where round(q, 9) >= 0.3 group by lang",
    "q_text_score": f"select doc_id, round(rep, 6) as repetition, round(1 - top, 6) as diversity, round(text_score, 6) as text_score from {_TS}",
    "q_content_type": f"select doc_id, {_CTYPE} as content_type from documents where text is not null",
    "q_record_scores": f"with a as (select (text_score + {_CODE} + {_CONTENT}) / 3 as overall, {_CTYPE} as content_type from {_TS}) select content_type, count(*) as total, sum((round(overall, 9) >= 0.3)::bigint)::bigint as n_passed, sum((round(overall, 9) < 0.3)::bigint)::bigint as n_failed, round(avg(overall), 5) as mean_overall from a group by content_type",
    "q_filter_by_score": "select rec_id, round(coalesce(_quality.text_score, 0.0), 6) as score from scored where coalesce(_quality.text_score, 0.0) >= 0.5",
    "q_quality_report": "select count(*) as records, count(_quality) as scored, " + ", ".join(f"round(avg(_quality.{f}), 6) as {f}" for f in ("text_score", "vocabulary_richness", "repetition_penalty", "sentence_variation", "diversity", "code_score", "content_score", "overall_quality")) + " from scored",
    "q_perplexity_score": "select event_id, round(case when event_id % 7 = 0 or value is null then 0.5 else least(1.0, 100.0 / exp(value / 20)) end, 6) as score from events",
    "q_prep_quality": f"with a as (select doc_id, len({_SPLIT}) as n, {_PREP} as q from documents where text is not null) select doc_id, n as n_words, round(q, 6) as quality, case when n = 0 then 'empty' when n < 50 then 'too_few_words' when n > 100000 then 'too_many_words' when round(q, 9) < 0.3 then 'low_quality' else 'valid' end as verdict from a",
    "q_validate_code": f"with a as (select doc_id, text, {_LANGB} as lb from documents where text is not null and source = 'code_files') select doc_id, case when {_NL} < 5 then 'too_few_lines' when {_NL} > 50000 then 'too_many_lines' when {_KWD} / {_NL} < 0.3 then 'low_quality' when " + " or ".join(f"contains(lower(text), {_q(x)})" for x in Q.SUSPICIOUS) + " then 'suspicious' else 'valid' end as verdict, 1 + " + " + ".join(f"len(regexp_extract_all(text, '\\b{k}\\b'))" for k in Q.BRANCHES) + " + length(text) - length(replace(text, '?', '')) as complexity from a",
    "q_toxicity_full": f"select * from {_TOXF}",
    "q_toxicity_filter": f"select (not toxic or max_score < 0.5) as kept, has_pii, is_attack, count(*) as n, round(avg(max_score), 5) as mean_max from {_TOXF} group by 1, 2, 3",
    "q_pii_stats": "select " + ", ".join(f"sum(len(regexp_extract_all(text, {_q(p)})))::bigint as n_{k}" for k, p in Q.PII.items()) + f", sum(({_REDACTED} <> text)::bigint)::bigint as n_changed from documents where text is not null",
    "q_pii_redact": f"select doc_id, md5({_REDACTED}) as redacted_md5 from documents where text is not null",
    "q_pii_text_prep": f"select doc_id, md5({_redact(Q.PII_PREP)}) as redacted_md5 from documents where text is not null",
    "q_safety": "select chat_id, not (" + " or ".join(f"regexp_matches(r, {_q('(?i)' + p)})" for p in Q.UNSAFE) + ") as safe, case when " + " or ".join(f"contains(lower(r), {_q(x)})" for x in Q.DANGEROUS) + f" then 0.0 else 1.0 end::double as preference from {_RESP}",
    "q_lang_cascade": _CASC,
    "q_lang_patterns": f"select * from {_LD7}",
    "q_detect_lang_regex": f"select * from {_LD7}",
    "q_lang_code": f"select doc_id, {_LD8} as of_code, {_LD9} as curated, case when {_LD9} in ('python', 'javascript', 'rust') then {_LD9} else 'other' end as bucket from {_EXT}",
    "q_lang_report": f"select detected, count(*) as n, sum(n_chars)::bigint as chars from {_LD7} join documents using (doc_id) where detected <> 'unknown' group by detected",
}
