"""What becomes of each span, and the text that results. The source text is never changed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import YEAR_ANYWHERE
from ..functions.notices import none, notice
from ..functions.text import bound, cut, cuttable, metadata, normalized
from ..types import APPLIED_DDL, OVERRIDE_DDL, PLACEHOLDERS, SPAN_DDL, language, masks, merged_policy


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def last_of_each_place(overrides: Column) -> Column:
    """Of several overrides of one place the last counts, at the place of the first."""
    o = F.coalesce(overrides, F.array().cast(f"array<{OVERRIDE_DDL}>"))
    by_place = F.array_sort(F.transform(o, lambda x, i: F.struct(x["start"].alias("a"), x["end"].alias("b"), i.alias("at"), x.alias("x"))))
    same = lambda p, q: p["a"].eqNullSafe(q["a"]) & p["b"].eqNullSafe(q["b"])

    def ends(c: Column) -> Column:
        first = F.filter(c, lambda p, i: (i == 0) | ~same(p, F.get(c, i - 1)))
        last = F.filter(c, lambda p, i: (i == F.size(c) - 1) | ~same(p, F.get(c, i + 1)))
        return F.zip_with(first, last, lambda p, q: F.struct(p["at"].alias("at"), F.when(q["a"].isNotNull() & q["b"].isNotNull(), q["x"]).alias("x")))

    return F.transform(F.array_sort(bound(by_place, ends)), lambda p: p["x"])


def by_place_of(overrides: Column) -> Column:
    """The overrides that count, sorted by place, as ``at_place`` looks them up; and the steps in which it does."""
    placed = F.transform(F.filter(last_of_each_place(overrides), lambda x: x.isNotNull()), lambda x: F.struct(F.struct(x["start"].alias("start"), x["end"].alias("end")).alias("place"), x.alias("x")))
    powers = F.array(*(F.lit(1 << k) for k in range(29, -1, -1)))
    return bound(F.array_sort(placed), lambda c: F.struct(c.alias("sorted"), F.filter(powers, lambda k: k <= F.size(c)).alias("steps")))


def at_place(found: Column, start: Column, end: Column) -> Column:
    """The override of a place in what ``by_place_of`` gives, or null."""

    def search(place: Column) -> Column:
        before = F.aggregate(found["steps"], F.lit(0), lambda n, k: F.when(F.get(found["sorted"], n + k - 1)["place"] < place, n + k).otherwise(n))
        return bound(F.get(found["sorted"], before), lambda hit: F.when(hit["place"] == place, hit["x"]))

    return bound(F.struct(start.alias("start"), end.alias("end")), search)


def manual(df: DataFrame, text: str = "text", spans: str = "spans", overrides: str = "overrides", notices: str = "override_notices") -> DataFrame:
    """Overrides of places without a span become spans (detector user_manual); those that the text no longer has get a notice,
    which is about the review and not about the detection.

    The spans come after the detected ones; resolve again where there are any.
    """
    o = F.coalesce(F.col(overrides), F.array().cast(f"array<{OVERRIDE_DDL}>"))
    new = F.filter(o, lambda x: ~F.exists(F.col(spans), lambda s: (s["start"] == x["start"]) & (s["end"] == x["end"])))
    there = lambda x: F.coalesce((x["end"] <= F.length(text)) & (F.substring(F.col(text), x["start"] + 1, x["end"] - x["start"]) == x["text"]), F.lit(False))
    made = F.transform(
        F.filter(new, there),
        lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.coalesce(x["entity_type"], F.lit("OTHER_PII")).alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit("user_manual").alias("detector"), (F.lit(1 << 30) + i).cast("int").alias("ordinal"), metadata(user_manual="true").alias("metadata")),
    ).cast(f"array<{SPAN_DDL}>")
    stale = F.transform(F.filter(new, lambda x: ~there(x)), lambda x: notice("manual_selection_ignored"))
    old = F.col(notices) if notices in df.columns else none()
    return df.withColumns({spans: F.concat(spans, made), notices: F.concat(old, stale)})


def apply_policy(df: DataFrame, policy: dict[str, str] | None = None, lang: str | Column = "de", preserve: Iterable[str] | Column = (), text: str = "text", spans: str = "spans", overrides: str | None = None, applied: str = "applied", output: str = "output") -> DataFrame:
    """``df`` with ``applied`` (the spans with transformation, replacement and status) and ``output``, the new text.

    An override whose text is the span's comes first, then terms to preserve, then the policy, then TYPE_MASK.
    ``lang`` is a language or a column of languages; unknown ones are German. ``overrides`` names an array column;
    ``preserve`` is a list of terms or a column of lists.
    """
    active = _map(merged_policy(policy))
    kept = preserve if isinstance(preserve, Column) else F.array(*map(F.lit, [t for t in preserve if t.strip()])).cast("array<string>")
    kept = F.transform(kept, normalized)

    def of_language(values: dict[str, Column]) -> Column:
        if not isinstance(lang, Column):
            return values[language(lang)]
        out = None
        for code in ("en", "fr", "es"):
            out = F.when(lang == code, values[code]) if out is None else out.when(lang == code, values[code])
        return out.otherwise(values["de"])

    mask = of_language({k: _map(masks(k)) for k in PLACEHOLDERS})
    removed = of_language({k: F.lit(p[1]) for k, p in PLACEHOLDERS.items()})
    stem = of_language({k: F.lit(p[2]) for k, p in PLACEHOLDERS.items()})

    def decided(s: Column, own: Column) -> Column:
        over = own.isNotNull()
        kind = F.coalesce(own["entity_type"], s["entity_type"])
        term = ~over & F.array_contains(kept, normalized(s["text"]))
        what = F.coalesce(own["transformation"], F.when(term, F.lit("PRESERVE")), active[kind], F.lit("TYPE_MASK"))
        meta = s["metadata"].withField("overridden", F.when(over, "true")).withField("preserved_by_term", F.when(term, "true"))
        return s.withField("entity_type", kind).withField("metadata", meta).withField("transformation", what)

    def own(s: Column, found: Column) -> Column:
        return bound(at_place(found, s["start"], s["end"]), lambda x: F.when(x["text"] == s["text"], x))

    by_place = F.transform(F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("a"), s["ordinal"].alias("b"), s.alias("s")))), lambda k: k["s"])
    if overrides:
        done = bound(by_place_of(F.col(overrides)), lambda found: F.transform(by_place, lambda s: bound(own(s, found), lambda x: decided(s, x))))
    else:
        done = F.transform(by_place, lambda s: decided(s, F.lit(None).cast(OVERRIDE_DDL)))
    step1 = df.withColumn(applied, done)
    key = lambda s: F.coalesce(F.nullif(s["metadata"]["tag_group"], F.lit("")), normalized(s["text"]))
    keys = F.array_distinct(F.transform(F.filter(applied, lambda s: s["transformation"] == "CONSISTENT_TAG"), key))

    def replaced(s: Column, keys: Column) -> Column:
        what = s["transformation"]
        year = F.nullif(F.regexp_extract(s["text"], YEAR_ANYWHERE, 0), F.lit(""))
        tag = F.concat(F.lit("["), stem, F.lit("_"), F.array_position(keys, key(s)).cast("string"), F.lit("]"))
        new = F.when(what == "CONSISTENT_TAG", tag).when(what == "GENERALIZE", F.coalesce(year, mask[s["entity_type"]])).when(what == "REMOVE", removed).when(what == "PRESERVE", F.lit(None)).otherwise(mask[s["entity_type"]])
        status = F.when(what == "CONSISTENT_TAG", "TAGGED").when(what == "GENERALIZE", "GENERALIZED").when(what == "PRESERVE", "PRESERVED").otherwise("REDACTED")
        return s.withField("replacement", new).withField("status", status)

    step2 = step1.withColumn(applied, bound(keys, lambda k: F.transform(applied, lambda s: replaced(s, k))).cast(f"array<{APPLIED_DDL}>"))
    return step2.withColumn(output, rewritten(F.col(text), F.col(applied)))


def rewritten(text: Column, applied: Column) -> Column:
    """The text with each replaced span's replacement; spans don't overlap and ascend."""
    changed = F.transform(F.filter(applied, lambda s: s["replacement"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("by")))

    def put(c: Column, whole: Column) -> Column:
        parts = F.transform(c, lambda s, i: F.concat(cut(whole, F.coalesce(F.get(c, i - 1)["end"], F.lit(0)), s["start"]), s["by"]))
        return F.concat(F.array_join(parts, ""), cut(whole, F.element_at(c, -1)["end"], F.length(text)))

    return bound(changed, lambda c: F.when(F.size(c) > 0, bound(cuttable(text), lambda whole: put(c, whole))).otherwise(text))


def unmatched_overrides(overrides: Column, applied: Column) -> Column:
    """The overrides that no span took."""
    return F.filter(last_of_each_place(overrides), lambda x: ~F.exists(applied, lambda s: (s["start"] == x["start"]) & (s["end"] == x["end"]) & (s["metadata"]["overridden"] == "true")))


def entity_counts(applied: Column) -> Column:
    """array<struct<entity_type, n>> in the order of first appearance."""
    kinds = F.array_distinct(F.transform(applied, lambda s: s["entity_type"]))
    return F.transform(kinds, lambda k: F.struct(k.alias("entity_type"), F.size(F.filter(applied, lambda s: s["entity_type"] == k)).alias("n")))


def review_overrides(action: Column, status: Column, detector: Column) -> Column:
    """What a reviewer's action on a span asks for: a transformation, 'drop' (of its override), or null for no change."""
    by_hand = detector == "user_manual"
    return (
        F.when(action == "reset", "drop")
        .when((action == "preserve") & by_hand, "drop")
        .when((action == "preserve") & (status != "PRESERVED"), "PRESERVE")
        .when((action == "redact") & by_hand, "REMOVE")
        .when((action == "redact") & (status == "PRESERVED"), "TYPE_MASK")
    )


