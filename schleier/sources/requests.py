"""What a user sends with documents: texts within limits, and the forms that set policy, terms, language and flags."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import merged_policy
from .documents import MOST_CHARS

MOST_TERMS, TERM_CHARS, INSTRUCTION_CHARS = 100, 200, 2000


def text_error(text: Column, most: int = MOST_CHARS) -> Column:
    """Why a text isn't taken: it is blank or longer than the limit; null where it is."""
    return F.when(~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)), "it has no text").when(F.length(text) > most, "its text is longer than the limit")


def accepted(df: DataFrame, text: str = "text", error: str = "error", most: int = MOST_CHARS) -> DataFrame:
    """``df`` with ``error`` and with the texts that aren't taken as null."""
    why = text_error(F.col(text), most)
    return df.withColumn(error, why).withColumn(text, F.when(F.col(error).isNull(), F.col(text)))


def _json(raw: str | None, what: str, kind: type):
    if not (raw or "").strip():
        return None
    try:
        value = json.loads(raw)
    except json.JSONDecodeError:
        raise ValueError(f"the {what} aren't JSON") from None
    if not isinstance(value, kind):
        raise ValueError(f"the {what} aren't of the form expected")
    return value


def terms(raw: str | None) -> list[str]:
    """The terms of a JSON list: at most a hundred, cut to their length, blank ones left out."""
    listed = _json(raw, "terms", list) or []
    if len(listed) > MOST_TERMS:
        raise ValueError("there are too many terms")
    return [str(t)[:TERM_CHARS] for t in listed if str(t).strip()]


def policy(raw: str | None) -> dict[str, str] | None:
    """The partial policy of a JSON object; unknown names are refused."""
    given = _json(raw, "policies", dict)
    if given is not None:
        merged_policy(given)
    return given


def instruction(raw: str | None) -> str | None:
    if raw is not None and len(raw) > INSTRUCTION_CHARS:
        raise ValueError("the instruction is too long")
    return raw


def language(raw: str | None) -> str | None:
    """A language's code; what isn't one is no error, and later stands for German."""
    return (raw or "").strip() or None


def flag(raw: str | None) -> bool:
    return (raw or "").strip().lower() in ("true", "1", "yes", "on")
