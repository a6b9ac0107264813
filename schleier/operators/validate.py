"""Checks of the output, and its grade: any HIGH warning fails it, any WARNING asks for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.notices import message
from ..functions.patterns import FIELD_ANCHOR, LABELLED_FIELD
from ..functions.text import matches
from ..types import MENTION_DDL, WARNING_DDL, merged_policy
from . import detect, grounding

LEAST_RESIDUAL = 4


def _warning(code: str, category: str, severity: str, start: Column | None = None, end: Column | None = None, kind: Column | None = None) -> Column:
    none = F.lit(None)
    start, end, kind = (none if x is None else x for x in (start, end, kind))
    return F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), start.cast("int").alias("start"), end.cast("int").alias("end"), kind.cast("string").alias("entity_type"), message(code, entity_type=kind).alias("message"))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def residuals(output: Column, applied: Column) -> Column:
    """A warning for each redacted span whose text is still in the output, at its first place."""
    gone = F.filter(applied, lambda s: (s["status"] != "PRESERVED") & (F.length(stripped(s["text"])) >= LEAST_RESIDUAL) & F.contains(output, stripped(s["text"])))
    at = lambda s: F.instr(output, stripped(s["text"])) - 1
    return F.transform(gone, lambda s: _warning("residual_identifier", "residual_identifier", "HIGH", at(s), at(s) + F.length(stripped(s["text"])), s["entity_type"]))


def redetected(output: Column, applied: Column, policy: dict[str, str] | None = None) -> Column:
    """A warning for each rule match in the output, but for preserved types and texts."""
    kept_types = [k for k, v in merged_policy(policy).items() if v == "PRESERVE"]
    kept = F.transform(F.filter(applied, lambda s: s["status"] == "PRESERVED"), lambda s: s["text"])
    found = F.filter(detect.rules()(output), lambda s: ~s["entity_type"].isin(*kept_types) & ~F.array_contains(kept, s["text"]))
    return F.transform(found, lambda s: _warning("revalidation_hit", "revalidation_hit", "WARNING", s["start"], s["end"], s["entity_type"]))


def labelled_fields(output: Column) -> Column:
    return F.transform(matches(output, LABELLED_FIELD, 1, FIELD_ANCHOR), lambda m: _warning("labelled_field", "labelled_field", "WARNING", m["start"], m["end"]))


def from_notices(notices: Column) -> Column:
    """Detectors' notices, so that nothing ungrounded passes."""
    return F.transform(notices, lambda n: _warning_of(n["code"], n["message"]))


def _warning_of(code: Column, text: Column) -> Column:
    return F.struct(code.alias("code"), F.lit("detector").alias("category"), F.lit("WARNING").alias("severity"), _none("int").alias("start"), _none("int").alias("end"), _none("string").alias("entity_type"), text.alias("message"))


def status(warnings: Column) -> Column:
    return F.when(F.exists(warnings, lambda w: w["severity"] == "HIGH"), "FAIL").when(F.exists(warnings, lambda w: w["severity"] == "WARNING"), "REVIEW_REQUIRED").otherwise("PASS")


def validate(df: DataFrame, policy: dict[str, str] | None = None, output: str = "output", applied: str = "applied", notices: str | None = "notices", recheck_skipped: bool = False) -> DataFrame:
    """``df`` with ``warnings`` and ``validation_status``."""
    parts = [from_notices(F.col(notices))] if notices and notices in df.columns else []
    o, a = F.coalesce(F.col(output), F.lit("")), F.col(applied)
    parts += [residuals(o, a), redetected(o, a, policy), labelled_fields(o)]
    if recheck_skipped:
        parts.append(F.array(_warning("llm_recheck_skipped", "llm_recheck", "INFO")))
    out = df.withColumn("warnings", F.concat(*(p.cast(f"array<{WARNING_DDL}>") for p in parts)))
    return out.withColumn("validation_status", status(F.col("warnings")))


def recheck(df: DataFrame, answers: DataFrame, doc: str = "doc_id", output: str = "output") -> DataFrame:
    """``df`` of ``validate`` with the warnings of a model's audit of the outputs, and the grade that follows.

    ``answers`` is of ``mentions.rechecked``. What is told to remain is located in the output; what can't be is only information.
    A risk above low asks for review and makes its concerns warnings; an audit that failed, or a document without one, asks for
    review too.
    """
    found = answers.select(F.col(doc).alias("audit_id_"), F.col("mentions").alias("audit_mentions_"), F.col("risk").alias("audit_risk_"), F.col("concerns").alias("audit_concerns_"))
    out = df.join(found, F.col(doc) == F.col("audit_id_"), "left")
    failed = F.col("audit_mentions_").isNull()
    out = out.withColumn("audit_asked_", F.coalesce("audit_mentions_", F.array().cast(f"array<{MENTION_DDL}>")))
    out = grounding.grounded(out, output, "audit_asked_", "audit_spans_", "audit_lost_")
    remain = F.transform("audit_spans_", lambda s: _warning("llm_recheck_remaining", "llm_recheck", "WARNING", s["start"], s["end"], s["entity_type"]))
    lost = F.transform("audit_lost_", lambda _: _warning("llm_recheck_unlocated", "llm_recheck", "INFO"))
    high = F.coalesce(F.col("audit_risk_") != "low", F.lit(False))
    plain = lambda code, category, severity, text: F.struct(F.lit(code).alias("code"), category.alias("category"), severity.alias("severity"), _none("int").alias("start"), _none("int").alias("end"), _none("string").alias("entity_type"), text.alias("message"))
    risk = F.when(high, F.array(plain("recheck_risk", F.lit("recheck_risk"), F.lit("WARNING"), message("recheck_risk", risk=F.col("audit_risk_"))))).otherwise(F.array())
    # a concern's text is the model's own
    concerns = F.transform(F.coalesce("audit_concerns_", F.array().cast("array<struct<category:string,description:string>>")), lambda c: plain("", F.concat(F.lit("recheck_"), c["category"]), F.when(high, "WARNING").otherwise("INFO"), c["description"]))
    kind = f"array<{WARNING_DDL}>"
    told = F.when(failed, F.array(_warning("llm_recheck_failed", "llm_recheck", "WARNING")).cast(kind)).otherwise(F.concat(remain.cast(kind), lost.cast(kind), risk.cast(kind), concerns.cast(kind)))
    out = out.withColumn("warnings", F.concat("warnings", told)).withColumn("validation_status", status(F.col("warnings")))
    return out.select(*df.columns)


def needles(applied: Column) -> Column:
    """Distinct texts that must not survive an export: at least two characters, longest first."""
    texts = F.array_distinct(F.transform(F.filter(applied, lambda s: s["status"] != "PRESERVED"), lambda s: stripped(s["text"])))
    return F.array_sort(F.filter(texts, lambda t: F.length(t) >= 2), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def preserved_at_risk(applied: Column) -> Column:
    """Preserved texts that hold a redacted one and so can't stay readable in a file whose every occurrence is blacked out."""
    fold = lambda t: F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))
    kept = F.array_distinct(F.transform(F.filter(applied, lambda s: s["status"] == "PRESERVED"), lambda s: stripped(s["text"])))
    return F.array_sort(F.filter(kept, lambda k: F.exists(needles(applied), lambda n: F.contains(fold(k), fold(n)))))


def survives(text: Column, needle: Column) -> Column:
    """Whether a needle is still in an extracted text: whole words if short, else with any white space or without."""
    flat, bare = F.regexp_replace(text, r"(?U)\s+", " "), F.regexp_replace(text, r"(?U)\s+", "")
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), needle, F.lit(r"\E(?!\w)"))
    return F.when(F.length(needle) <= 3, F.regexp_like(text, quoted)).otherwise(F.contains(text, needle) | F.contains(flat, F.regexp_replace(needle, r"(?U)\s+", " ")) | F.contains(bare, F.regexp_replace(needle, r"(?U)\s+", "")))


def covered(needle: Column, found: Column) -> Column:
    """A needle that wasn't found is fine if it is part of a longer one that was."""
    return F.exists(found, lambda f: (F.length(f) > F.length(needle)) & F.contains(f, needle))
