"""Parsers of model answers: five-field answers, JSON in prose, scores of a judge, claims."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.vectorised import vectorised

SCORES = ("faithfulness", "completeness", "correctness")


def structured_answer(raw: Column) -> Column:
    """answer, evidence, confidence, safety_notes and missing_info of an answer with bold field names.

    Without an answer field the whole text is the answer; confidence is High, Medium or
    Low, whichever the field names first in that order, else Unknown; the last two
    default to None, the word.
    """
    text = F.coalesce(raw, F.lit(""))
    part = lambda name, end=r"(?=\n\*\*|\z)": F.nullif(F.regexp_extract(text, rf"(?s)\*\*{name}:\*\*\s*(.+?){end}", 1), F.lit(""))
    level = F.coalesce(part("Confidence", r"(?=\n|\z)"), F.lit(""))
    confidence = F.when(level.contains("High"), "High").when(level.contains("Medium"), "Medium").when(level.contains("Low"), "Low").otherwise("Unknown")
    field = lambda name, default: T.strip(F.coalesce(part(name), default))
    return F.struct(
        field("Answer", text).alias("answer"),
        field("Evidence", F.lit("")).alias("evidence"),
        confidence.alias("confidence"),
        field("Safety Notes", F.lit("None")).alias("safety_notes"),
        field("Missing Info", F.lit("None")).alias("missing_info"),
    )


def unfenced(text: Column) -> Column:
    """A response without the fences of a code block."""
    return T.strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"```(?:json)?", ""))


def json_list(text: Column, schema: str) -> Column:
    """The outermost JSON array of a response, parsed; an empty array if there is none or it is broken."""
    body = F.regexp_extract(unfenced(text), r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(F.nullif(body, F.lit("")), schema), F.array().cast(schema))


def _objects(value: object) -> list[dict] | None:
    if isinstance(value, dict):
        value = next((v for v in value.values() if isinstance(v, list)), [value])
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else None


def judge_scores(response: str, size: int) -> list[dict[str, float]]:
    """Scores for size answers out of a judge's response.

    Tried in turn: a JSON list, or an object that holds one; flat objects in prose; lines
    with three numbers. Scores of the first two are clamped to 0..10; missing answers
    are filled up with zeros, more than size are cut.
    """
    text = re.sub(r"```(?:json)?", "", response or "").strip()
    clamp = lambda v: max(0.0, min(10.0, float(v)))
    read = lambda o: {k: clamp(o.get(k, 0) or 0) for k in SCORES}
    found: list[dict[str, float]] = []
    for pattern in (r"\[.*\]", r"\{.*\}"):
        if not found and (m := re.search(pattern, text, re.DOTALL)):
            try:
                found = [read(o) for o in _objects(json.loads(m[0])) or [] if any(k in o for k in SCORES)]
            except (ValueError, TypeError):
                found = []
    if not found:
        for m in re.finditer(r"\{[^{}]*\}", text):
            try:
                found.append(read(json.loads(m[0])))
            except (ValueError, TypeError):
                continue
    if not found:
        for line in text.splitlines():
            numbers = re.findall(r"\d+(?:\.\d+)?", re.sub(r"^\s*\d+\s*[.):]", "", line))
            if len(numbers) >= len(SCORES):
                found.append(dict(zip(SCORES, map(float, numbers[-len(SCORES) :]), strict=True)))
    return (found + [dict.fromkeys(SCORES, 0.0)] * size)[:size]


def claims(response: str, size: int) -> list[dict]:
    """(claims, hallucinated, rate) for size answers: a list, an object with results, or one object; zeros where it can't be read."""
    empty = {"claims": 0, "hallucinated": 0, "rate": 0.0}
    try:
        value = json.loads(re.sub(r"```(?:json)?", "", response or "").strip())
        rows = value if isinstance(value, list) else value.get("results", [value])
        out = []
        for o in rows:
            n, bad = int(o.get("claims", 0)), int(o.get("hallucinated", 0))
            out.append({"claims": n, "hallucinated": bad, "rate": bad / n if n else 0.0})
    except (ValueError, TypeError, AttributeError):
        out = []
    return (out + [empty] * size)[:size]


@vectorised("array<struct<faithfulness:double,completeness:double,correctness:double>>")
def parse_judge(response: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([judge_scores(r, int(n)) for r, n in zip(response, size, strict=True)])


@vectorised("array<struct<claims:int,hallucinated:int,rate:double>>")
def parse_claims(response: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([claims(r, int(n)) for r, n in zip(response, size, strict=True)])


def model_headings(response: Column) -> Column:
    """Headings out of a model's reply, a JSON list of objects: array of (heading, level), levels from 1 to 6 and 2 without one, blank ones left out."""
    found = json_list(response, "array<struct<heading:string,level:int>>")
    rows = F.transform(found, lambda h: F.struct(T.strip(F.coalesce(h["heading"], F.lit(""))).alias("heading"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(h["level"], F.lit(2)))).alias("level")))
    return F.filter(rows, lambda h: h["heading"] != "")
