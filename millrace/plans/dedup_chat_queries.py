"""Queries of MinHash and substring deduplication and of chat records."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.bind import bind
from millrace.operators import chat as H
from millrace.operators import neardup as N


def t(s, d, name="documents"):
    return s.read.parquet(f"{d}/{name}.parquet")


def q_minhash_dedup(s, d):
    """DD8 to DD10, DD18: documents by how they were found out, in key order."""
    return N.minhash_dedup(t(s, d), "doc_id", "text").groupBy("method").agg(F.count("*").alias("n"))


def q_minhash_pairs(s, d):
    """DD6, DD8, DD9, DD12: similar bodies of near_dedup by signature."""
    x = t(s, d, "near_dedup").select("rec_id", T.document_text("text", "content", "code").alias("body"))
    return N.lsh_pairs(N.signatures(x, "rec_id", "body"), "rec_id").select("a", "b", F.round("similarity", 6).alias("similarity"))


def q_substring_pairs(s, d):
    """DD13: bodies that stand in others at least twice as long."""
    x = t(s, d, "near_dedup").select("rec_id", T.document_text("text", "content", "code").alias("body"))
    return N.substring_pairs(x, "rec_id", "body")


def q_combined_dedup(s, d):
    """DD14: what is left after exact, near and substring deduplication, by source."""
    x = t(s, d).where("text is not null and text <> ''").select("doc_id", "text", "source")
    left = N.minhash_dedup(x, "doc_id", "text").where("method = 'unique'").select("doc_id")
    return N.substring_survivors(x, "doc_id", "text", left).join(x, "doc_id").groupBy("source").agg(F.count("*").alias("n"))


def q_md5_dedup(s, d):
    """DD3."""
    return t(s, d).where("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def q_raw_hash(s, d):
    """DD2: the first record of each body, with the first 16 digits of its SHA-256."""
    x = t(s, d, "near_dedup").select("rec_id", T.document_text("text", "content", "code").alias("body")).where("body is not null")
    return x.groupBy(F.substring(F.sha2("body", 256), 1, 16).alias("hash")).agg(F.min("rec_id").alias("rec_id"), F.count("*").alias("n"))


def q_code_blocks(s, d):
    """DD16: documents whose first ten code lines are equal, as classes."""
    x = bind(t(s, d).where("text is not null"), ["doc_id"], b=N.code_blocks(F.col("text"))).where("b <> ''")
    return x.groupBy(F.md5("b").alias("block_md5")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


# Records of five formats, made of instruction and response by chat_id.
def _records(s, d):
    x = t(s, d, "coding_chat").groupBy("chat_id").agg(F.max(F.struct("received_at", "instruction", "response", "source")).alias("x")).select("chat_id", "x.*")
    i, r = F.coalesce("instruction", F.lit("")), F.coalesce("response", F.lit(""))
    said = lambda a, b: F.array(F.struct(F.lit(a).alias("from"), i.alias("value")), F.struct(F.lit(b).alias("from"), r.alias("value")))
    k = F.col("chat_id") % 6
    record = (
        F.when(k == 0, F.to_json(F.struct(i.alias("instruction"), F.lit("").alias("input"), r.alias("output")))).when(k == 1, F.to_json(F.struct(F.lit("1").alias("message_id"), F.lit("assistant").alias("role"), r.alias("content"))))
        .when(k == 2, F.to_json(F.struct(said("human", "gpt").alias("conversations")))).when(k == 3, F.to_json(F.struct(F.array(H.message("user", i), H.message("assistant", r), H.message("user", F.lit("Thanks."))).alias("dialogs"))))
        .when(k == 4, F.to_json(F.struct(i.alias("prompt"), r.alias("response")))).otherwise(F.to_json(F.struct(i.alias("body"))))
    )
    x = bind(x, ["chat_id", "source"], record=record)
    x = bind(x, ["chat_id", "source", "record"], form=H.detect_format(F.col("record")))
    return bind(x, ["chat_id", "source", "form"], turns=H.convert(F.col("record"), F.col("form")))


def q_chat_convert(s, d):
    """CH1, CH2: format of each record and its turns."""
    return _records(s, d).select("chat_id", "form", F.coalesce(F.size(F.col("turns")), F.lit(-1)).cast("long").alias("n_turns"), F.md5(F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "||")).alias("turns_md5"))


def q_chat_process(s, d):
    """CH3 to CH6: verdicts by format, with lengths of what is valid."""
    x = bind(_records(s, d), ["form"], v=H.verdict(F.col("turns")), f=H.formatted(F.col("turns")))
    return x.groupBy("form", "v").agg(F.count("*").alias("n"), F.sum(F.length("f")).alias("chars"))


def q_chat_report(s, d):
    """CH6: samples, turns and lengths by source of the valid conversations."""
    x = bind(_records(s, d), ["source", "turns"], v=H.verdict(F.col("turns"))).where("v = 'valid'").select("source", F.size("turns").alias("k"), F.length(H.formatted(F.col("turns"))).alias("n"))
    return x.groupBy("source").agg(F.count("*").alias("samples"), F.sum("k").alias("turns"), F.round(F.avg("n"), 5).alias("mean_chars"), F.median("n").alias("median_chars"))


# Conversations: the pairs of each asker's day as turns.
def _conversations(s, d):
    x = t(s, d, "coding_chat").where("asker_id is not null and created_at is not null").select("asker_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "chat_id", "instruction", "response").groupBy("asker_id", "day", "chat_id").agg(F.max("instruction").alias("i"), F.max("response").alias("r"))
    said = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.coalesce("i", F.lit("")).alias("content")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.coalesce("r", F.lit("")).alias("content")))
    flat = x.select(F.concat_ws("/", F.col("asker_id").cast("string"), "day").alias("conv"), "chat_id", F.inline(said))
    return H.turns_of(flat, "conv", ["chat_id", "k"], "role", "content")


def q_conv_pairs(s, d):
    """CH7, CH8, SRC12: the first pair of each conversation and all adjacent ones."""
    x = bind(_conversations(s, d), ["conv"], f=H.first_pair(F.col("turns")), p=H.adjacent_pairs(F.col("turns")))
    return x.select("conv", F.md5(F.concat_ws("|", "f.prompt", "f.response")).alias("first_md5"), F.size("p").cast("long").alias("n_pairs"))


def q_conv_memory(s, d):
    """CH11 to CH14: the last ten messages, the last of each role, estimate, summary and id of each conversation."""
    c = F.col("turns")
    x = bind(_conversations(s, d), ["conv"], r=H.recent(c), u=H.last_of(c, "user"), a=H.last_of(c, "assistant"), e=H.token_estimate(c), z=H.summary(c), i=H.conversation_id(c))
    return x.select("conv", F.size("r").cast("long").alias("n_recent"), F.md5("u").alias("user_md5"), F.md5("a").alias("assistant_md5"), F.col("e").cast("long").alias("tokens"), F.md5("z").alias("summary_md5"), F.col("i").alias("conv_id"))


def q_key_points(s, d):
    """CH14."""
    x = bind(t(s, d).where("text is not null"), ["doc_id"], k=H.key_points(F.col("text")))
    return x.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "|")).alias("points_md5"))


def q_preference_pairs(s, d):
    """CH15: the longest and the shortest response of each instruction."""
    x = t(s, d, "coding_chat").where("instruction is not null and response is not null")
    return H.preference_pairs(x, "instruction", "response", F.length("response").cast("long")).select(F.md5("instruction").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"), "margin")


def q_image_captions(s, d):
    """CH9, CH10: records as images, their notes as captions: the first of each, valid from ten characters."""
    img = t(s, d, "near_dedup").select(F.col("rec_id").alias("image_id"), "repo_name")
    ann = t(s, d, "scored").where("text is not null").select(F.col("rec_id").alias("annotation_id"), (F.col("rec_id") % 1000).alias("image_id"), F.col("text").alias("caption"))
    x = H.with_captions(img, ann)
    return x.select("image_id", F.md5("caption").alias("caption_md5"), (F.length(F.trim("caption")) >= 10).alias("valid"))


def q_sft_records(s, d):
    """SFT1, CLN13: prompt and response put together and cut to a length."""
    x = t(s, d, "coding_chat").groupBy("chat_id").agg(F.max(F.struct("received_at", F.coalesce("instruction", F.lit("")).alias("i"), F.coalesce("response", F.lit("")).alias("r"))).alias("x"))
    whole = H.labelled(F.array(H.message("system", F.lit("Be exact.")), H.message("user", F.col("x.i")), H.message("assistant", F.col("x.r"))))
    return bind(x, ["chat_id"], w=whole).select("chat_id", F.md5(F.substring("w", 1, 2048)).alias("text_md5"), (F.length("w") > 2048).alias("cut"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_BODY = "(select rec_id, coalesce(nullif(text, ''), nullif(content, ''), nullif(code, '')) as body from near_dedup)"
_TRIM = r"regexp_replace({}, '^ +| +$', '', 'g')"
_BLK = r"array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' and not starts_with(ltrim(x), '#'))[1:10], lambda x: trim(regexp_replace(x, '[\s\x0b]+', ' ', 'g'))), chr(10))"
_REC = """(with l as (select chat_id, arg_max(struct_pack(i := coalesce(instruction, ''), r := coalesce(response, ''), s := source), struct_pack(a := received_at, b := instruction, c := response, e := source)) as x from coding_chat group by chat_id),
 f as (select chat_id, x.s as source, x.i as i, x.r as r, case chat_id % 6 when 0 then 'alpaca' when 1 then 'openassistant' when 2 then 'sharegpt' when 3 then 'ultrachat' when 4 then 'standard' else 'unknown' end as form from l)
 select chat_id, source, form, case form when 'alpaca' then case when i <> '' and r <> '' then [{'role': 'user', 'content': i}, {'role': 'assistant', 'content': r}] end
  when 'openassistant' then case when r <> '' then [{'role': 'assistant', 'content': r}] end
  when 'sharegpt' then case when i <> '' and r <> '' then [{'role': 'user', 'content': i}, {'role': 'assistant', 'content': r}] end
  when 'ultrachat' then case when (i <> '')::int + (r <> '')::int >= 1 then list_filter([{'role': 'user', 'content': i}, {'role': 'assistant', 'content': r}, {'role': 'user', 'content': 'Thanks.'}], lambda m: m.content <> '') end
  when 'standard' then [{'role': 'user', 'content': i}, {'role': 'assistant', 'content': r}] end as turns from f)"""
_FMT = "trim(array_to_string(list_transform(list_filter(turns, lambda m: m.content <> ''), lambda m: case when m.role = 'user' then 'USER: ' else 'ASSISTANT: ' end || m.content), chr(10) || chr(10)))"
_LEN = "list_sum(list_transform(turns, lambda m: length(m.content)))"
_VER = f"case when turns is null or len(turns) = 0 then 'empty' when len(list_filter(turns, lambda m: m.role = 'user')) < 1 then 'too_few_turns' when {_LEN} < 10 then 'too_short' when {_LEN} > 8192 then 'too_long' else 'valid' end"
_CONV = """(with a as (select asker_id, strftime(created_at, '%Y-%m-%d') as day, chat_id, max(instruction) as i, max(response) as r from coding_chat where asker_id is not null and created_at is not null group by 1, 2, 3)
 select asker_id || '/' || day as conv, flatten(list([{'role': 'user', 'content': coalesce(i, '')}, {'role': 'assistant', 'content': coalesce(r, '')}] order by chat_id)) as turns from a group by 1)"""
ORACLES = {
    "q_md5_dedup": "select md5(text) as text_md5, min(doc_id) as doc_id, count(*) as n from documents where text is not null group by 1",
    "q_raw_hash": f"select substr(sha256(body), 1, 16) as hash, min(rec_id) as rec_id, count(*) as n from {_BODY} where body is not null group by 1",
    "q_code_blocks": f"select md5(b) as block_md5, min(doc_id) as first_id, count(*) as n from (select doc_id, {_BLK} as b from documents where text is not null) where b <> '' group by 1 having count(*) > 1",
    "q_substring_pairs": f"with f as (select min(rec_id) as k, body as t from {_BODY} where body is not null group by body) select x.k as a, y.k as b from f x join f y on length(x.t) < length(y.t) * 0.5 and contains(y.t, x.t)",
    "q_chat_convert": f"select chat_id, form, coalesce(len(turns), -1) as n_turns, md5(array_to_string(list_transform(turns, lambda m: m.role || '|' || m.content), '||')) as turns_md5 from {_REC}",
    "q_chat_process": f"select form, {_VER} as v, count(*) as n, sum(length({_FMT}))::bigint as chars from {_REC} group by 1, 2",
    "q_chat_report": f"select source, count(*) as samples, sum(len(turns))::bigint as turns, round(avg(length({_FMT})), 5) as mean_chars, median(length({_FMT}))::double as median_chars from {_REC} where {_VER} = 'valid' group by source",
    "q_conv_pairs": f"select conv, md5(turns[1].content || '|' || turns[2].content) as first_md5, len(turns) // 2 as n_pairs from {_CONV}",
    "q_conv_memory": f"select conv, least(len(turns), 10) as n_recent, md5(turns[len(turns) - 1].content) as user_md5, md5(turns[len(turns)].content) as assistant_md5, list_sum(list_transform(turns, lambda m: length(m.content) // 4))::bigint as tokens, md5(case when len(turns) <= 4 then array_to_string(list_transform(turns, lambda m: m.role || ': ' || substr(m.content, 1, 50)), ' | ') else 'Started: ' || substr(turns[1].content, 1, 50) || '... Ended: ' || substr(turns[len(turns)].content, 1, 50) end) as summary_md5, substr(md5(array_to_string(list_transform(turns, lambda m: m.content), '')), 1, 12) as conv_id from {_CONV}",
    "q_key_points": f"with a as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {_TRIM.format('x')}), lambda x: length(x) > 20)[1:5] as k from documents where text is not null) select doc_id, len(k) as n, md5(array_to_string(k, '|')) as points_md5 from a",
    "q_preference_pairs": "with a as (select instruction, struct_pack(s := length(response), r := response) as x from coding_chat where instruction is not null and response is not null), b as (select instruction, max(x) as best, min(x) as worst from a group by 1) select md5(instruction) as prompt_md5, md5(best.r) as chosen_md5, md5(worst.r) as rejected_md5, best.s - worst.s as margin from b where best.r <> worst.r",
    "q_image_captions": "with a as (select rec_id % 1000 as image_id, arg_min(text, rec_id) as caption from scored where text is not null group by 1) select n.rec_id as image_id, md5(caption) as caption_md5, length(trim(caption)) >= 10 as valid from near_dedup n join a on a.image_id = n.rec_id",
    "q_sft_records": "with a as (select chat_id, max(struct_pack(a := received_at, i := coalesce(instruction, ''), r := coalesce(response, ''))) as x from coding_chat group by chat_id), b as (select chat_id, 'System: Be exact.' || chr(10) || 'User: ' || x.i || chr(10) || 'Assistant: ' || x.r as w from a) select chat_id, md5(substr(w, 1, 2048)) as text_md5, length(w) > 2048 as cut from b",
}
