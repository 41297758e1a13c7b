"""Chat and instruction records: formats, conversion, checks, turns (CH1 to CH15, SRC12, SFT1, CLN13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,content:string>>"


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def detect_format(record: Column) -> Column:
    """CH1: of a JSON record, by the fields it has."""
    def has(k: str) -> Column:
        return F.array_contains(F.json_object_keys(record), k)

    return (
        F.when(has("parent_id") | has("message_id"), "openassistant").when(has("conversations"), "sharegpt").when(has("instruction") & has("input"), "alpaca").when(has("dialogs"), "ultrachat")
        .when(has("prompt") & has("response") | has("input") & has("output"), "standard").otherwise("unknown")
    )


def _get(record: Column, k: str) -> Column:
    return F.get_json_object(record, f"$.{k}")


def convert(record: Column, form: Column) -> Column:
    """CH2: the turns (role, content) of a JSON record of a known format; null if there is nothing to convert."""
    def filled(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    ins, inp, out = _get(record, "instruction"), _get(record, "input"), _get(record, "output")
    prompt = F.when(filled(inp), F.concat(ins, F.lit("\n\nInput: "), inp)).otherwise(ins)
    alpaca = F.when(filled(ins) & filled(out), F.array(message("user", prompt), message("assistant", out)))
    open_ = F.when((_get(record, "role") == "assistant") & filled(_get(record, "content")), F.array(message("assistant", _get(record, "content"))))
    share = F.from_json(_get(record, "conversations"), "array<struct<from:string,value:string>>")
    role = lambda m: F.when(m["from"] == "human", "user").when(m["from"] == "gpt", "assistant").otherwise(m["from"])
    share = F.filter(F.transform(share, lambda m: message(role(m), m["value"])), lambda m: filled(m["role"]) & filled(m["content"]))
    ultra = F.filter(F.from_json(_get(record, "dialogs"), TURNS), lambda m: filled(m["role"]) & filled(m["content"]))
    plain = F.array(message("user", F.coalesce(_get(record, "prompt"), inp, F.lit(""))), message("assistant", F.coalesce(_get(record, "response"), out, F.lit(""))))
    return F.when(form == "alpaca", alpaca).when(form == "openassistant", open_).when((form == "sharegpt") & (F.size(share) >= 2), share).when((form == "ultrachat") & (F.size(ultra) >= 2), ultra).when(form == "standard", plain)


def verdict(turns: Column, least: int = 10, most: int = 8192, users: int = 1) -> Column:
    """CH3: the first ground for leaving a conversation out, or valid."""
    n = F.aggregate(turns, F.lit(0), lambda a, m: a + F.length(F.coalesce(m["content"], F.lit(""))))
    n_user = F.size(F.filter(turns, lambda m: m["role"] == "user"))
    none = ~F.exists(turns, lambda m: m["role"].isin("user", "assistant"))
    return F.when(turns.isNull() | (F.size(turns) == 0), "empty").when(none, "no_roles").when(n_user < users, "too_few_turns").when(n < least, "too_short").when(n > most, "too_long").otherwise("valid")


def formatted(turns: Column) -> Column:
    """CH4: USER and ASSISTANT turns apart by blank lines; system messages are left out."""
    own = F.filter(turns, lambda m: m["role"].isin("user", "assistant") & (m["content"] != ""))
    return F.trim(F.array_join(F.transform(own, lambda m: F.concat(F.when(m["role"] == "user", "USER: ").otherwise("ASSISTANT: "), m["content"])), "\n\n"))


def labelled(turns: Column) -> Column:
    """CLN13: System, User and Assistant lines."""
    return F.array_join(F.transform(turns, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def first_pair(turns: Column) -> Column:
    """CH7: the first user message and the first assistant message after it."""
    at = F.array_position(F.transform(turns, lambda m: m["role"]), "user").cast("int")
    later = F.filter(F.slice(turns, at + 1, F.greatest(F.size(turns) - at, F.lit(0))), lambda m: m["role"] == "assistant")
    return F.when((at > 0) & (F.size(later) > 0), F.struct(F.get(turns, at - 1)["content"].alias("prompt"), F.get(later, F.lit(0))["content"].alias("response")))


def adjacent_pairs(turns: Column) -> Column:
    """CH8, SRC12: user and assistant messages at places 2k and 2k + 1."""
    steps = F.sequence(F.lit(0), F.greatest(F.size(turns) - 2, F.lit(0)), F.lit(2))
    pairs = F.transform(steps, lambda i: F.struct(F.get(turns, i).alias("u"), F.get(turns, i + 1).alias("a")))
    good = F.filter(pairs, lambda p: (p["u"]["role"] == "user") & (p["a"]["role"] == "assistant"))
    return F.transform(good, lambda p: F.struct(p["u"]["content"].alias("prompt"), p["a"]["content"].alias("response")))


def recent(turns: Column, n: int = 10) -> Column:
    """CH11: the last n messages, with the first one before them if it is a system message."""
    last = F.slice(turns, F.greatest(F.size(turns) - n + 1, F.lit(1)), F.lit(n))
    first = F.get(turns, F.lit(0))
    return F.when((F.size(turns) > n) & (first["role"] == "system"), F.concat(F.array(first), last)).otherwise(last)


def last_of(turns: Column, role: str) -> Column:
    """CH12: the last message of a role."""
    return F.try_element_at(F.filter(turns, lambda m: m["role"] == role), F.lit(-1))["content"]


def token_estimate(turns: Column) -> Column:
    """CH12: characters over four."""
    return F.aggregate(turns, F.lit(0), lambda a, m: a + F.floor(F.length(F.coalesce(m["content"], F.lit(""))) / 4).cast("int"))


def summary(turns: Column) -> Column:
    """CH13: all messages of short conversations, else the beginnings of the first and the last."""
    whole = F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit(": "), F.substring(m["content"], 1, 50))), " | ")
    ends = F.concat(F.lit("Started: "), F.substring(F.get(turns, F.lit(0))["content"], 1, 50), F.lit("... Ended: "), F.substring(F.try_element_at(turns, F.lit(-1))["content"], 1, 50))
    return F.when(F.size(turns) <= 4, whole).otherwise(ends)


def conversation_id(turns: Column) -> Column:
    """CH14: the first twelve hex digits of the MD5 of all contents."""
    return F.substring(F.md5(F.array_join(F.transform(turns, lambda m: F.coalesce(m["content"], F.lit(""))), "")), 1, 12)


def key_points(c: Column, n: int = 5) -> Column:
    """CH14: the first sentences of more than 20 characters."""
    return F.slice(F.filter(F.transform(F.split(c, "[.!?]+", -1), lambda x: F.trim(x)), lambda x: F.length(x) > 20), 1, n)


def preference_pairs(df: DataFrame, prompt: str, response: str, score: Column) -> DataFrame:
    """CH15: the best and the worst response of each prompt that has two different ones."""
    x = df.select(prompt, F.struct(score.alias("s"), F.col(response).alias("r")).alias("x")).groupBy(prompt).agg(F.max("x").alias("best"), F.min("x").alias("worst"))
    return x.where("best.r <> worst.r").select(prompt, F.col("best.r").alias("chosen"), F.col("worst.r").alias("rejected"), (F.col("best.s") - F.col("worst.s")).alias("margin"))


def with_captions(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """CH9: images with their first caption, by an equi-join; images without one are left out."""
    first = annotations.groupBy("image_id").agg(F.min_by("caption", "annotation_id").alias("caption"))
    return images.join(first, "image_id")


def turns_of(df: DataFrame, group: str, order: list[str], role: str, content: str) -> DataFrame:
    """One row a conversation with its messages in order. A conversation's length is bounded by what a chat holds."""
    return df.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(role).alias("role"), F.col(content).alias("content")))), lambda m: message(m["role"], m["content"])).alias("turns"))


