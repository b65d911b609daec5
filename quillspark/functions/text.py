"""Text functions: cleaning, tokens, scripts, stable ids."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's ``strip`` takes off; Spark's ``trim`` knows the blank only.
_EDGES = r"(?U)^\s+|\s+$"

# What cleaning takes out or puts in order, step by step.
_STEPS = (
    (re.compile(r"\f"), "\n"),
    (re.compile(r"\r\n?"), "\n"),
    (re.compile("[​‌‍﻿⁠]"), ""),
    (re.compile(r"(?m)^[ \t]*[-=_*~]{5,}[ \t]*$"), ""),
)
_TIDY = (
    (re.compile(r"[^\S\r\n]+"), " "),
    (re.compile(r" *\n *"), "\n"),
    (re.compile(r"\n{3,}"), "\n\n"),
)


def cleaned(text: str | None) -> str:
    """Compatibility forms composed, page artefacts and invisible characters dropped, blanks and empty lines collapsed.

    Case, scripts and punctuation stay.  Null and empty give ''.
    """
    out = unicodedata.normalize("NFKC", text or "")
    for pattern, by in _STEPS:
        out = pattern.sub(by, out)
    if not out.isprintable():
        out = "".join(c for c in out if c in "\t\n" or unicodedata.category(c)[0] != "C")
    for pattern, by in _TIDY:
        out = pattern.sub(by, out)
    return out.strip()


@F.pandas_udf(T.StringType())
def clean_text(texts: pd.Series) -> pd.Series:
    """:func:`cleaned` of a column: NFKC has no built-in in Spark."""
    return texts.map(cleaned)


def stripped(text: Column) -> Column:
    """Python's ``strip``: all Unicode blanks off both ends."""
    return F.regexp_replace(text, _EDGES, "")


def is_blank(text: Column) -> Column:
    """Null, empty or blanks only."""
    return text.isNull() | (stripped(text) == "")


def tokens_lower(text: Column) -> Column:
    """Distinct runs of a-z of the lower-cased text, in order of first appearance; null text gives an empty array."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))


def document_id(path: Column, differentiator: Column) -> Column:
    """First 16 hex digits of the hash of 'path:differentiator'; the path is relative to the input root."""
    return F.substring(F.sha2(F.concat(path, F.lit(":"), differentiator), 256), 1, 16)


def id_list(text: Column, separator: str = ",") -> Column:
    """Trimmed non-empty parts of a separated list; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), re.escape(separator)), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def fenced_json(text: Column) -> Column:
    """Content of the first ``` fence, the whole text if there is none."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)```", 1)
    return stripped(F.when(text.rlike(r"(?s)```.*```"), inner).otherwise(text))


def fenced_items(text: Column, schema: str) -> Column:
    """The JSON array in a reply, fenced or not, as an array of structs; a reply that can't be read gives an empty array."""
    body = fenced_json(text)
    return F.coalesce(F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), f"array<{schema}>"), F.array().cast(f"array<{schema}>"))
