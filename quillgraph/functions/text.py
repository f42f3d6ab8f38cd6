"""Scalar text functions as columns; the few without a built-in form are Arrow-batched UDFs."""

from __future__ import annotations

import ast
import html
import json
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def unescape_html(c: pd.Series) -> pd.Series:
    """Character references decoded; Spark has no built-in for the full table."""
    return c.map(lambda x: None if x is None else html.unescape(x))


def clean_text(c: Column) -> Column:
    """Stripped, references decoded, control characters dropped."""
    return F.regexp_replace(unescape_html(strip(c)), CONTROL, "")


def is_number(c: Column) -> Column:
    return c.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


@F.pandas_udf(T.StringType())
def decode_unicode_escapes(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), x))


def content_id(prefix: str, c: Column) -> Column:
    """prefix and the MD5 of the UTF-8 text."""
    return F.concat(F.lit(prefix), F.md5(F.encode(c, "utf-8")))


def split_markers(c: Column, markers: list[str]) -> Column:
    """Parts between any of the markers, trimmed, without empty ones."""
    parts = F.split(c, "|".join(re.escape(m) for m in markers))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def keep_allowed(c: Column, allowed: list[str], default: str) -> Column:
    """The trimmed value if allowed, else its lower-case form if allowed, else default."""
    t = strip(c.cast("string"))
    return F.when(t.isin(allowed), t).when(F.lower(t).isin(allowed), F.lower(t)).otherwise(default)


# Spellings of yes and no.
YES, NO = ["1", "true", "yes", "有", "是"], ["0", "false", "no", "无", "否"]


def to_binary(c: Column, default: int = 0) -> Column:
    t = F.lower(strip(c.cast("string")))
    return F.when(t.isin(YES), 1).when(t.isin(NO), 0).otherwise(default)


def to_integer(c: Column, default: int) -> Column:
    """Truncated number, default where there is none."""
    return F.coalesce(strip(c.cast("string")).try_cast("double").cast("int"), F.lit(default))


def lymph_status(c: Column) -> Column:
    """``positive/total`` as it is; negative, positive or unknown in lower case; else unknown."""
    t = strip(c)
    low = F.lower(t)
    return F.when(t.rlike(r"^\d+/\d+$"), t).when(low.isin("negative", "positive", "unknown"), low).otherwise("unknown")


def first_number(c: Column) -> Column:
    found = F.regexp_extract(c.cast("string"), r"(\d+\.?\d*)", 1)
    return F.when(found != "", found.try_cast("double"))


def cut_with_ellipsis(c: Column, prefixes: list[str], most: int = 100) -> Column:
    """Without leading prefixes, cut to ``most`` characters and marked."""
    t = strip(F.regexp_replace(strip(c), "^(?:" + "|".join(re.escape(p) for p in prefixes) + ")", ""))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t)


def token_count(c: Column) -> Column:
    """Tokens of the default tokenizer: single spaces part them."""
    return F.size(F.split(c, " "))


# Stages as a model writes them after its mark, and bare ones.
_MARKED_STAGE = r"(?i)FIGO分期[：:]\s*(I{1,3}(?:[ACV](?:[1-3](?:i{1,2})?)?|[VX])?(?:m(?:POLEmut|MMRd|p53abn)|(?:POLEmut|MMRd|NSMP|p53abn))?)"
_BARE_STAGE = r"\b(I(?:Am(?:POLEmut)|[ABC][1-3]?(?:i{1,2})?|[IVX]+[ABC]?[1-3]?(?:i{1,2})?)(?:m(?:POLEmut|MMRd|p53abn)|(?:POLEmut|MMRd|NSMP|p53abn))?)\b"


def stage_of(c: Column) -> Column:
    """Stage after the mark, molecular class included, else the last bare one; null without any."""
    named = F.regexp_extract(c, _MARKED_STAGE, 1)
    return F.when(named != "", named).otherwise(F.try_element_at(F.regexp_extract_all(c, F.lit(_BARE_STAGE), F.lit(1)), F.lit(-1)))


def tool_call(c: Column) -> Column:
    """JSON of the first query tag, null if there is none."""
    found = strip(F.regexp_extract(c, r"(?s)<query>(.*?)</query>", 1))
    return F.when(found != "", found)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def calculate(expression: str) -> str:
    """JSON with the result of + - * / ( ) abs() float(), or an error; nothing else is evaluated."""

    def value(n):
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float):
            return n.value
        if isinstance(n, ast.BinOp) and type(n.op) in _OPERATORS:
            return _OPERATORS[type(n.op)](value(n.left), value(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in _OPERATORS:
            return _OPERATORS[type(n.op)](value(n.operand))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("abs", "float") and len(n.args) == 1:
            return {"abs": abs, "float": float}[n.func.id](value(n.args[0]))
        raise ValueError("not an arithmetic expression")

    try:
        return json.dumps({"result": value(ast.parse(expression, mode="eval").body)})
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError) as e:
        return json.dumps({"error": str(e)})


@F.pandas_udf(T.StringType())
def calculator(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else calculate(x))


def first_json(text: str) -> str | None:
    """The whole text, else its first balanced object, else the first object of an array; null if none parses."""
    try:
        found = json.loads(text)
        found = next((x for x in found if isinstance(x, dict)), None) if isinstance(found, list) else found
        return json.dumps(found) if isinstance(found, dict) else None
    except ValueError:
        pass
    for at in (m.start() for m in re.finditer(r"\{", text)):
        try:
            return json.dumps(json.JSONDecoder().raw_decode(text[at:])[0])
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def extract_json(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else first_json(x))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(c: pd.Series) -> pd.Series:
    """Base64 of little-endian 32-bit floats."""
    import base64

    import numpy as np

    return c.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4"))


def smart_truncate(text: str, most: int, keywords: list[str], marker: str = "...[cut]") -> str:
    """Lines with a keyword first, then the others, until ``most`` characters; marked where something is missing."""
    if len(text) <= most:
        return text
    lines = [x for x in text.split("\n") if x.strip()]
    line, size = [], 0
    for x in [x for x in lines if any(k in x for k in keywords)] + [x for x in lines if not any(k in x for k in keywords)]:
        if size >= most:
            break
        line.append(x)
        size += len(x) + 1
    return "\n".join(line)[:most] + marker


def chat_prompt(roles: Column, contents: Column) -> Column:
    """Ordered messages as tagged text."""
    return F.array_join(F.zip_with(roles, contents, lambda r, c: F.concat(F.lit("<"), r, F.lit(">"), c, F.lit("</"), r, F.lit(">"))), "\n")
