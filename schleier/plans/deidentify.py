"""Documents in, redacted documents out: one narrow stage, so it runs on tables and on streams alike."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import notices
from ..operators import detect, evaluate, grounding, policy, resolve, validate
from ..operators import mentions as mentions_
from ..types import MENTION_DDL, merged_policy


def detected(df: DataFrame, detectors: Iterable[str] = ("rules",), redact_terms: Iterable[str] = (), mentions: str | None = None, text: str = "text") -> DataFrame:
    """``df`` with resolved ``spans``, ``notices`` and ``decisions``. ``mentions`` names a column of what a model reported."""
    out = detect.with_spans(df, detect.registered(detectors, redact_terms), text)
    out = detect.validated(out, text)
    if mentions:
        out = grounding.grounded(out.withColumn(mentions, F.coalesce(F.col(mentions), F.array().cast(f"array<{MENTION_DDL}>"))), text, mentions)
        out = out.withColumns({"spans": detect.numbered(F.concat("spans", "mention_spans")), "notices": F.concat("notices", "mention_notices")}).drop("mention_spans", "mention_notices")
    return resolve.resolved(out, decisions="decisions")


def finished(df: DataFrame, chosen: dict[str, str] | None = None, lang: str | Column = "de", preserve_terms: Iterable[str] = (), overrides: str | None = None, text: str = "text", source_type: str | None = None, recheck_skipped: bool = False) -> DataFrame:
    """``detected`` rows with ``applied``, ``output``, ``override_notices``, ``warnings`` and ``validation_status``; run it again after a review.

    ``source_type`` names a column: for 'pdf', whose redaction blacks out every occurrence of a text, passages that were kept but hold
    a redacted text get a notice. ``recheck_skipped`` tells that a model's audit of the output wasn't repeated.
    """
    out = df.withColumn("override_notices", notices.none())
    if overrides:
        out = policy.manual(out, text, overrides=overrides)
        out = resolve.resolved(out)
    out = policy.apply_policy(out, chosen, lang, preserve_terms, text, overrides=overrides)
    if overrides:
        lost = F.transform(policy.unmatched_overrides(F.col(overrides), F.col("applied")), lambda x: notices.notice("override_not_matched"))
        out = out.withColumn("override_notices", F.concat("override_notices", lost))
    if source_type:
        out = out.withColumn("at_risk_", F.size(validate.preserved_at_risk(F.col("applied"))))
        covered = F.when((F.col(source_type) == "pdf") & (F.col("at_risk_") > 0), F.array(notices.notice("pdf_preserve_not_honoured", count=F.col("at_risk_")))).otherwise(notices.none())
        out = out.withColumn("override_notices", F.concat("override_notices", covered)).drop("at_risk_")
    return validate.validate(out, chosen, recheck_skipped=recheck_skipped)


def audited(done: DataFrame, ask: Callable[[str, int], str | None], chosen: dict[str, str] | None = None, doc: str = "doc_id") -> DataFrame:
    """``deidentified`` rows with the warnings and the grade after a model has audited the outputs.

    ``ask(chunk, pass)`` gives the model's answer, or None where it can't be had: then the document asks for review.
    """
    chunked = mentions_.chunks(done.select(doc, F.coalesce("output", F.lit("")).alias("text")), doc)
    answers = mentions_.asked(chunked, ask, passes=1)
    return validate.recheck(done, mentions_.rechecked(answers, merged_policy(chosen), doc), doc)


def deidentified(df: DataFrame, chosen: dict[str, str] | None = None, lang: str | Column = "de", detectors: Iterable[str] = ("rules",), redact_terms: Iterable[str] = (), preserve_terms: Iterable[str] = (), mentions: str | None = None, overrides: str | None = None, text: str = "text", source_type: str | None = None) -> DataFrame:
    return finished(detected(df, detectors, redact_terms, mentions, text), chosen, lang, preserve_terms, overrides, text, source_type)


def evaluated(gold: DataFrame, mode: str = "detection", only_annotated_types: bool = False, detectors: Iterable[str] = ("rules",), text: str = "text") -> DataFrame:
    """Annotated documents (text, gold) with the detectors' predictions and scores."""
    out = detected(gold, detectors, text=text)
    out = out.withColumn("predicted", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"))))
    out = evaluate.for_mode(out, mode)
    return evaluate.scored(evaluate.restricted(out) if only_annotated_types else out, text)
