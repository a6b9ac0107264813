"""Notices about a run: a stable code, its English text, and the values in it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import MESSAGES, NOTICE_DDL


def message(code: str, **params: Column) -> Column:
    """The text of a code with the values filled in."""
    parts = re.split(r"\{(\w+)\}", MESSAGES[code])
    return F.concat(*(F.coalesce(params[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def notice(code: str, **params: Column) -> Column:
    values = F.create_map(*(x for k, v in params.items() for x in (F.lit(k), v.cast("string")))) if params else F.create_map()
    return F.struct(F.lit(code).alias("code"), message(code, **params).alias("message"), values.cast("map<string,string>").alias("params")).cast(NOTICE_DDL)


def of_codes(codes: Column) -> Column:
    """Notices of codes without values."""
    known = [c for c, text in MESSAGES.items() if "{" not in text]
    texts = F.create_map(*(F.lit(x) for c in known for x in (c, MESSAGES[c])))
    return F.transform(codes, lambda c: F.struct(c.alias("code"), F.try_element_at(texts, c).alias("message"), F.create_map().cast("map<string,string>").alias("params")).cast(NOTICE_DDL))


def none() -> Column:
    return F.array().cast(f"array<{NOTICE_DDL}>")
