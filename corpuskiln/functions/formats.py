"""Chat formats: lists of {from, value} turns and of {role, content, thinking} messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import OPENAI, SHAREGPT
from .common import none_if_empty, or_empty, strip

THINK = r"(?s)\A<think>\s*(.*?)\s*</think>\s*(.*)\z"


def is_openai(json_text: Column) -> Column:
    """A JSON list is in message form if its first turn has a role."""
    return F.get_json_object(json_text, "$[0].role").isNotNull()


def to_sharegpt(messages: Column) -> Column:
    """system and other roles pass; user is human, assistant is gpt with its thinking inlined in front."""

    def turn(m: Column) -> Column:
        thought = F.concat(F.lit("<think>\n"), m["thinking"], F.lit("\n</think>\n\n"), or_empty(m["content"]))
        said = F.when((m["role"] == "assistant") & (or_empty(m["thinking"]) != ""), thought).otherwise(or_empty(m["content"]))
        name = F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"])
        return F.struct(name.alias("from"), said.alias("value"))

    return F.transform(messages, turn)


def to_openai(turns: Column) -> Column:
    """human is user, gpt is assistant; thinking is taken out only at the very start of an assistant turn."""

    def message(t: Column) -> Column:
        role = F.when(t["from"] == "human", "user").when(t["from"].isin("gpt", "assistant"), "assistant").otherwise(t["from"])
        value = or_empty(t["value"])
        thinks = t["from"].isin("gpt", "assistant") & F.regexp_like(value, F.lit(THINK))
        thinking = F.when(thinks, none_if_empty(strip(F.regexp_extract(value, THINK, 1))))
        content = F.when(thinks, strip(F.regexp_extract(value, THINK, 2))).otherwise(value)
        return F.struct(role.alias("role"), content.alias("content"), thinking.cast("string").alias("thinking"))

    return F.transform(turns, message)


def first_value(turns: Column, *names: str) -> Column:
    """Value of the first turn whose `from` is one of names, or empty."""
    return or_empty(F.get(F.filter(turns, lambda t: t["from"].isin(*names)), F.lit(0))["value"])


def first_message(messages: Column, role: str) -> Column:
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))


def parsed(json_text: Column, ddl: str) -> Column:
    """A JSON list, or null where it is empty, the word null, or broken."""
    return F.from_json(F.when(~strip(json_text).isin("", "null"), json_text), ddl, {"mode": "PERMISSIVE"})


def resolve_messages(messages: Column, turns: Column) -> Column:
    """Messages where there are any, else the converted turns."""
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.coalesce(some(messages), some(to_openai(turns)))


def salvage_json(raw: Column, ddl: str) -> Column:
    """Model output without code fences, parsed as a list; broken output is an empty list."""
    bare = strip(F.regexp_replace(strip(F.regexp_replace(raw, r"```(?:json)?\s*", "")), r"`+\z", ""))
    return F.coalesce(F.from_json(bare, ddl), F.array().cast(ddl))


def salvage_turns(raw: Column) -> Column:
    return F.filter(salvage_json(raw, SHAREGPT), lambda t: t["from"].isNotNull() & t["value"].isNotNull())


def triplets(raw: Column, system: Column) -> Column:
    """Question/thinking/answer items of model output as conversations of three messages; an item needs question and answer."""
    items = salvage_json(raw, "array<struct<question:string,thinking:string,answer:string>>")
    said = lambda x, f: strip(or_empty(x[f]))
    usable = F.filter(items, lambda x: (said(x, "question") != "") & (said(x, "answer") != ""))
    none = F.lit(None).cast("string")
    message = lambda role, content, thinking: F.struct(F.lit(role).alias("role"), content.alias("content"), thinking.alias("thinking"))
    talk = lambda x: F.array(message("system", system, none), message("user", said(x, "question"), none), message("assistant", said(x, "answer"), none_if_empty(said(x, "thinking"))))
    return F.transform(usable, talk).cast(f"array<{OPENAI}>")


def delta_text(line: Column) -> Column:
    """The text that one line of a model's output stream adds; null for lines that add none, the line itself if it is no JSON."""
    kind = F.get_json_object(line, "$.type")
    blocks = F.from_json(F.get_json_object(line, "$.message.content"), "array<struct<type:string,text:string>>")
    said = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: or_empty(b["text"])), "")
    plain = F.when(strip(line) != "", strip(line))
    return none_if_empty(
        F.when(F.try_parse_json(line).isNull(), plain)
        .when(kind == "assistant", said)
        .when(kind == "content_block_delta", F.get_json_object(line, "$.delta.text"))
        .when(kind == "result", F.lit(None))
        .otherwise(F.get_json_object(line, "$.message.content"))
    )
