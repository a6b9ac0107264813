"""Elementary intervals of a text: pieces between the boundaries of all spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound, cut, cuttable, greatest_before
from ..types import NOT_SCORED


def clamped(spans: Column, n: Column) -> Column:
    """Spans cut to 0..n; those that end up empty go."""
    cut = F.transform(spans, lambda s: F.struct(F.least(F.greatest(s["start"], F.lit(0)), n).alias("start"), F.least(F.greatest(s["end"], F.lit(0)), n).alias("end")))
    return F.filter(cut, lambda s: s["start"] < s["end"])


def edges(n: Column, *spans: Column) -> Column:
    """0, every boundary and n, ascending, each once."""
    out = F.array(F.lit(0), n)
    for s in spans:
        out = F.concat(out, F.transform(s, lambda x: x["start"]), F.transform(s, lambda x: x["end"]))
    return F.array_sort(F.array_distinct(out))


def union_weight(whole: Column, spans: Column) -> Column:
    """Scored characters that any of the spans covers, each counted once; ``whole`` is the ``cuttable`` text.

    Of the spans in their order each adds what reaches beyond all before it.
    """
    def measured(s: Column, reach: Column) -> Column:
        new = F.zip_with(s, reach, lambda x, before: F.struct(F.greatest(x["start"], before).alias("start"), x["end"].alias("end")))
        some = F.filter(new, lambda x: x["start"] < x["end"])
        return F.aggregate(some, F.lit(0).cast("long"), lambda acc, x: acc + F.length(F.translate(cut(whole, x["start"], x["end"]), NOT_SCORED, "")).cast("long"))

    return bound(F.array_sort(spans), lambda s: bound(greatest_before(F.transform(s, lambda x: x["end"])), lambda reach: measured(s, reach)))


def highlighted(text: Column, entities: Column, warnings: Column) -> Column:
    """array<struct<start, text, entity_index, warning, show_label>>: what a viewer draws, in order.

    entity_index is the first entity over the piece (null for none), warning whether a warning is; neighbours that
    agree in both are one segment, and show_label marks the last segment of each entity.
    """
    marked = lambda n: F.filter(F.transform(entities, lambda e, i: F.struct(F.greatest(e["start"], F.lit(0)).alias("start"), F.least(e["end"], n).alias("end"), i.cast("int").alias("i"))), lambda e: e["start"] < e["end"])
    warned = lambda n: clamped(F.filter(warnings, lambda w: w["start"].isNotNull() & w["end"].isNotNull()), n)
    given = F.struct(F.length(text).alias("n"), marked(F.length(text)).alias("marked"), warned(F.length(text)).alias("warned"), cuttable(text).alias("whole"))

    def drawn(g: Column) -> Column:
        over = lambda spans, a: F.filter(spans, lambda s: (s["start"] <= a) & (a < s["end"]))
        state = lambda a: F.struct(a.alias("start"), F.get(F.transform(over(g["marked"], a), lambda e: e["i"]), F.lit(0)).alias("entity_index"), (F.size(over(g["warned"], a)) > 0).alias("warning"))
        each = F.transform(F.filter(edges(g["n"], g["marked"], g["warned"]), lambda a: a < g["n"]), state)
        # a segment begins where the entity or the warning changes
        begins = bound(each, lambda x: F.filter(x, lambda p, i: (i == 0) | ~F.get(x, i - 1)["entity_index"].eqNullSafe(p["entity_index"]) | (F.get(x, i - 1)["warning"] != p["warning"])))
        return bound(begins, lambda x: F.transform(x, lambda p, i: segment(x, p, F.get(x, i + 1), g)))

    def segment(x: Column, p: Column, after: Column, g: Column) -> Column:
        return F.struct(
            p["start"].alias("start"),
            cut(g["whole"], p["start"], F.coalesce(after["start"], g["n"])).alias("text"),
            p["entity_index"].alias("entity_index"),
            p["warning"].alias("warning"),
            (p["entity_index"].isNotNull() & ~after["entity_index"].eqNullSafe(p["entity_index"])).alias("show_label"),
        )

    return bound(given, drawn)
