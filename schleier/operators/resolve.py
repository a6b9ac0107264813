"""Overlap resolution: a fold over spans sorted by start, longer first, surer first, found first.

Each span is compared with the span selected last, so what was rejected doesn't extend its reach: of (0, 10),
(8, 20) and (12, 15) the first and the third stay. An earlier span wins over a longer one that starts inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, folded
from ..types import SPAN_DDL

MERGED = "duplicate span merged"
SURER = "identical offsets, higher-confidence type kept"
OVERLAP = "overlapping span, longer/earlier span kept"
DECISION_DDL = "struct<start:int,end:int,entity_type:string,rejected_start:int,rejected_end:int,rejected_type:string,reason:string>"


def ordered(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), (-s["confidence"]).alias("c"), s["ordinal"].alias("d"), s.alias("span")))
    # no two spans have the same ordinal, so the metadata never decides
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def resolution(spans: Column) -> Column:
    """struct<selected: array<span>, decisions: array<decision>>."""

    def step(last: Column, s: Column) -> Column:
        free = last.isNull() | (s["start"] >= last["end"])
        same = (s["start"] == last["start"]) & (s["end"] == last["end"])
        twin = same & (s["entity_type"] == last["entity_type"])
        # the surest of two comes first, so its confidence is the merged one
        both = F.array_join(F.array_sort(F.array_distinct(F.array(last["detector"], s["detector"]))), ",")
        merged = last.withField("metadata", last["metadata"].withField("supporting_detectors", both)).withField("confidence", F.greatest(last["confidence"], s["confidence"]))
        reason = F.when(twin, MERGED).when(same, SURER).otherwise(OVERLAP)
        decision = F.struct(last["start"].alias("start"), last["end"].alias("end"), last["entity_type"].alias("entity_type"), s["start"].alias("rejected_start"), s["end"].alias("rejected_end"), s["entity_type"].alias("rejected_type"), reason.alias("reason"))
        state = F.when(free, s).when(twin, merged).otherwise(last)
        # the last one can still be merged with, so it is given out when the next is selected
        return F.struct(
            state.alias("state"),
            F.when(free & last.isNotNull(), F.array(last)).otherwise(F.array().cast(f"array<{SPAN_DDL}>")).alias("selected"),
            F.when(free, F.array().cast(f"array<{DECISION_DDL}>")).otherwise(F.array(decision)).alias("decisions"),
        )

    found = folded(ordered(spans), F.lit(None).cast(SPAN_DDL), step, [("selected", SPAN_DDL), ("decisions", DECISION_DDL)])
    whole = lambda r: F.struct(F.filter(F.concat(r["selected"], F.array(r["state"])), lambda s: s.isNotNull()).alias("selected"), r["decisions"].alias("decisions"))
    return bound(found, whole)


def resolved(df: DataFrame, spans: str = "spans", decisions: str | None = None) -> DataFrame:
    """``df`` with its spans resolved, and the decisions if a column is named for them."""
    out = df.withColumn(spans, F.when(F.size(spans) > 0, resolution(F.col(spans))).otherwise(F.struct(F.array().cast(f"array<{SPAN_DDL}>").alias("selected"), F.array().cast(f"array<{DECISION_DDL}>").alias("decisions"))))
    if decisions:
        out = out.withColumn(decisions, F.col(spans)["decisions"])
    return out.withColumn(spans, F.col(spans)["selected"])
