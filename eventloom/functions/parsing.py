"""Reading what language models answer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import strip

EVENT = "struct<title:string,clues:array<string>,associated_numbers:array<struct<value:string,explanation:string>>,actors:array<string>,locations:array<string>,summary:string,description:string,influence:array<string>,confidence:double>"


def relation_label(relation: Column, raw: Column) -> Column:
    """The label in lower case from its own column or from the JSON object in raw; null if neither has one."""
    return F.lower(strip(F.coalesce(relation, F.get_json_object(raw, "$.relation"))))


def first_array(text: str) -> str | None:
    """The first bracketed part that is a JSON array, brackets counted; linear but for parts that fail to parse."""
    decoder, at = json.JSONDecoder(), text.find("[")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            if isinstance(value, list):
                return text[at:end]
        except ValueError:
            pass
        at = text.find("[", at + 1)
    return None


def split_answer(text: str | None) -> tuple[str | None, str | None]:
    """(thoughts, JSON array): of the marked sections if both are there in order, of a whole JSON answer, or of the first
    array anywhere; the word None means no events."""
    if not text:
        return None, None
    text = text.strip()
    low = text.lower()
    if low == "none":
        return text, "[]"
    thoughts, mark = low.find("**thoughts**"), low.find("**json**")
    if 0 <= thoughts < mark:
        return text[thoughts + 12 : mark].strip(), text[mark + 8 :].strip()
    try:
        value = json.loads(text)
    except ValueError:
        value = None
    if isinstance(value, list):
        return None, text
    if isinstance(value, dict) and "events" in value:
        return None, json.dumps(value["events"], ensure_ascii=False)
    return None, first_array(text)


def is_readable(text: str | None) -> bool:
    """Whether an extraction answer has events, or says that there are none."""
    try:
        value = json.loads(split_answer(text)[1] or "")
    except ValueError:
        return False
    return isinstance(value, list) or (isinstance(value, dict) and isinstance(value.get("events"), list))


def answer_parts(text: Column) -> Column:
    """struct(thoughts, json) of an extraction answer, in Arrow batches."""

    @F.pandas_udf("thoughts string, json string")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([split_answer(x) for x in s], columns=["thoughts", "json"])

    return parts(text)


def events_of(text: Column) -> Column:
    """Array of events of an extraction answer's JSON, a list or an object that holds one; null if it is neither."""
    listed = F.from_json(text, f"array<{EVENT}>")
    held = F.from_json(text, f"struct<events:array<{EVENT}>>")["events"]
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.filter(listed, lambda e: e.isNotNull())).otherwise(F.filter(held, lambda e: e.isNotNull()))


VERDICT = "map<string,struct<Winner:string,Explanation:string>>"


def message_of(answer: Column) -> Column:
    """The text of a model's answer: of a JSON object's content, of its first choice's message, of a list's first content,
    or the answer itself."""
    paths = ("$.content", "$.choices[0].message.content", "$[0].content")
    return F.coalesce(*[F.get_json_object(answer, p) for p in paths], answer)


def verdict_of(answer: Column) -> Column:
    """struct(evaluation, parse_error, raw_text): the JSON of a judge's answer in any of its shapes, or of its outermost
    braces; what cannot be read keeps its text."""
    text = strip(message_of(answer))
    whole = F.from_json(text, VERDICT)
    inner = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), VERDICT)
    found = F.coalesce(F.when(F.size(whole) > 0, whole), F.when(F.size(inner) > 0, inner))
    return F.struct(found.alias("evaluation"), found.isNull().alias("parse_error"), F.when(found.isNull(), text).alias("raw_text"))
