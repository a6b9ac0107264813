"""Detection: columns of spans, one array for a document, in the order in which detectors found them.

A detector is a function from a text column to array<span>; those that need Python are Arrow UDFs of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.notices import notice
from ..functions.patterns import RULES
from ..functions.text import PIECES, bound, cut, cuttable, matches, metadata, pieces, placed, word_bounded
from ..types import SPAN_DDL, DetectorUnavailable

Detector = Callable[[Column], Column]


def _spans(found: Column, entity_type: str | Column, confidence: float | Column, detector: str, meta: Column) -> Column:
    entity_type, confidence = (x if isinstance(x, Column) else F.lit(x) for x in (entity_type, confidence))
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), entity_type.alias("entity_type"), confidence.alias("confidence"), F.lit(detector).alias("detector"), F.lit(0).alias("ordinal"), meta.alias("metadata")),
    )


def numbered(spans: Column) -> Column:
    """Spans with their place in the array as ordinal."""
    return F.transform(spans, lambda s, i: s.withField("ordinal", i.cast("int"))).cast(f"array<{SPAN_DDL}>")


def rules(only: Iterable[str] | None = None) -> Detector:
    """The rule detector; ``only`` names some rules."""
    wanted = set(only) if only is not None else None
    chosen = [r for r in RULES if wanted is None or r.rule_id in wanted]
    if wanted and len(chosen) != len(wanted):
        raise DetectorUnavailable(f"no such rules: {sorted(wanted - {r.rule_id for r in chosen})}")
    listed = lambda values: F.split(F.lit("\t".join(values)), "\t")
    kinds, names, subtypes, sureness = (listed([str(v) for v in x]) for x in zip(*((r.entity_type, r.rule_id, r.subtype or "", r.confidence) for r in chosen)))

    def detect(text: Column) -> Column:
        # each rule's matches, then one expression that places those of all rules
        found = F.array(*(pieces(text, r.pattern, r.group, r.anchor) for r in chosen)).cast(f"array<{PIECES}>")

        def spans(p: Column, i: Column) -> Column:
            of = lambda values: F.get(values, i)
            meta = metadata(rule_id=of(names), subtype=F.nullif(of(subtypes), F.lit("")))
            made = _spans(placed(p), of(kinds), of(sureness).cast("double"), "rules", meta)
            return F.when(p.isNull(), F.array().cast(f"array<{SPAN_DDL}>")).otherwise(made.cast(f"array<{SPAN_DDL}>"))

        return F.flatten(F.transform(found, spans))

    return detect if chosen else lambda text: F.array().cast(f"array<{SPAN_DDL}>")


def terms(listed: Iterable[str]) -> Detector:
    """Terms that are always sensitive, word-bounded and in any case; a place that several terms match counts once."""
    patterns = [word_bounded(t.strip()) for t in listed if t.strip()]
    if not patterns:
        return lambda text: F.array().cast(f"array<{SPAN_DDL}>")
    return lambda text: F.array_distinct(F.concat(*(_spans(matches(text, p), "OTHER_PII", 1.0, "user_terms", metadata(user_term="true")) for p in patterns)))


def fixtures(literals: dict[str, str], confidence: float = 1.0) -> Detector:
    """Literal texts with their types, for tests; occurrences may overlap."""

    def one(text: Column, value: str, kind: str) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(len(value))) == value)
        found = F.transform(at, lambda i: F.struct((i - 1).alias("start"), (i - 1 + len(value)).alias("end"), F.lit(value).alias("text")))
        return _spans(found, kind, confidence, "mock", metadata())

    def detect(text: Column) -> Column:
        return F.concat(*(one(text, value, kind) for value, kind in literals.items()))

    return detect


DETECTORS: dict[str, Callable[[], Detector]] = {"rules": rules}


def registered(names: Iterable[str], user_terms: Iterable[str] = ()) -> list[Detector]:
    """User terms first, then the named detectors; an unknown name is an error, never skipped."""
    out = [terms(user_terms)] if list(user_terms) else []
    for name in names:
        if name not in DETECTORS:
            raise DetectorUnavailable(f"detector {name!r} isn't available")
        out.append(DETECTORS[name]())
    return out


def with_spans(df: DataFrame, detectors: Iterable[Detector], text: str = "text", to: str = "spans") -> DataFrame:
    """``df`` with all detectors' spans; a null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = [d(t) for d in detectors]
    return df.withColumn(to, numbered(F.concat(*found)) if found else F.array().cast(f"array<{SPAN_DDL}>"))


def validated(df: DataFrame, text: str = "text", spans: str = "spans", notices: str = "notices") -> DataFrame:
    """Spans whose text isn't the document's at their place are dropped, each with a notice."""

    def checked(whole: Column) -> Column:
        right = lambda s: F.when((s["start"] >= 0) & (s["end"] > s["start"]), cut(whole, s["start"], s["end"]) == s["text"])
        return F.transform(spans, lambda s: F.coalesce(right(s), F.lit(False)))

    fits = F.when(F.size(spans) > 0, bound(cuttable(F.col(text)), checked)).otherwise(F.array().cast("array<boolean>"))
    out = df.withColumn("fits_", fits)
    wrong = F.transform(F.filter(spans, lambda s, i: ~F.get(F.col("fits_"), i)), lambda s: notice("invalid_span_rejected", detector=s["detector"]))
    return out.withColumns({notices: wrong, spans: F.filter(spans, lambda s, i: F.get(F.col("fits_"), i))}).drop("fits_")
