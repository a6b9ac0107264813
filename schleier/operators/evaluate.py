"""Scoring predictions against annotations: characters, spans, types, and leaking documents.

Documents carry arrays (``gold``: start, end, label, entity_type; ``predicted``: start, end, entity_type), so scoring
one is a projection; only totals shuffle, and these are a few numbers a task. Predictions count whatever their type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, cuttable
from ..types import DEFAULT_POLICY, NOT_SCORED
from .segments import clamped, union_weight

COUNTS = ("tp", "fp", "tn", "fn", "gold_total", "gold_exact", "gold_overlap", "predicted_total", "predicted_exact", "predicted_overlap")


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _same(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])


def _matched(spans: Column, others: Column, test) -> Column:
    return F.size(F.filter(spans, lambda s: F.exists(others, lambda o: test(s, o)))).cast("long")


def scored(df: DataFrame, text: str = "text", gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """``df`` with each document's counts, ``leaked``, and ``missed`` (annotations that no prediction touches)."""
    t, g, p = F.coalesce(F.col(text), F.lit("")), F.col(gold), F.col(predicted)

    def characters(x: Column) -> Column:
        whole, n = x["whole"], x["n"]
        cover = lambda spans: union_weight(whole, spans)
        # the characters in both are those of either less those of any
        return bound(F.struct(cover(clamped(g, n)).alias("g"), cover(clamped(p, n)).alias("p"), cover(F.concat(clamped(g, n), clamped(p, n))).alias("any")), lambda w: F.struct(*(v.alias(k) for k, v in {"tp": w["g"] + w["p"] - w["any"], "fp": w["any"] - w["g"], "tn": x["scored"] - w["any"], "fn": w["any"] - w["p"]}.items())))

    given = F.struct(cuttable(t).alias("whole"), F.length(t).alias("n"), F.length(F.translate(t, NOT_SCORED, "")).cast("long").alias("scored"))
    out = df.withColumn("counts_", bound(given, characters)).withColumns(
        {
            **{c: F.col(f"counts_.{c}") for c in ("tp", "fp", "tn", "fn")},
            "gold_total": F.size(g).cast("long"),
            "gold_exact": _matched(g, p, _same),
            "gold_overlap": _matched(g, p, _overlaps),
            "predicted_total": F.size(p).cast("long"),
            "predicted_exact": _matched(p, g, _same),
            "predicted_overlap": _matched(p, g, _overlaps),
            "missed": F.filter(g, lambda s: ~F.exists(p, lambda o: _overlaps(s, o))),
        }
    ).drop("counts_")
    return out.withColumn("leaked", F.col("fn") > 0)


def _metrics(c: dict[str, Column]) -> dict[str, Column]:
    out = {}
    for name, (hit_p, all_p, hit_r, all_r) in {
        "char": (c["tp"], c["tp"] + c["fp"], c["tp"], c["tp"] + c["fn"]),
        "exact": (c["predicted_exact"], c["predicted_total"], c["gold_exact"], c["gold_total"]),
        "overlap": (c["predicted_overlap"], c["predicted_total"], c["gold_overlap"], c["gold_total"]),
    }.items():
        p, r = ratio(hit_p, all_p), ratio(hit_r, all_r)
        out |= {f"{name}_precision": F.round(p, 4), f"{name}_recall": F.round(r, 4), f"{name}_f1": F.round(f1(p, r), 4)}
    return out | {"char_specificity": F.round(ratio(c["tn"], c["tn"] + c["fp"]), 4)}


def with_metrics(df: DataFrame) -> DataFrame:
    """``scored`` rows with their ratios, rounded to 4 digits."""
    return df.withColumns(_metrics({c: F.col(c) for c in COUNTS}))


def micro(df: DataFrame) -> DataFrame:
    """One row: sums over documents, then ratios."""
    total = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS))
    return with_metrics(total)


def macro(df: DataFrame) -> DataFrame:
    """One row: means of the documents' rounded ratios; a document without annotations counts with recall 0."""
    names = list(_metrics({c: F.col(c) for c in COUNTS}))
    return with_metrics(df).agg(*(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in names))


def leakage(df: DataFrame) -> DataFrame:
    """One row: leaking and clean documents, their rate, leaked characters, missed annotations."""
    n, leaked = F.count("*"), F.coalesce(F.count_if("leaked"), F.lit(0))
    return df.agg(n.alias("documents"), leaked.alias("leaked_documents"), (n - leaked).alias("clean_documents"), F.round(ratio(leaked, n), 4).alias("leakage_rate"), F.coalesce(F.sum("fn"), F.lit(0)).cast("long").alias("leaked_characters"), F.coalesce(F.sum(F.size("missed")), F.lit(0)).cast("long").alias("missed_entities"))


def by_type(df: DataFrame, document: str | None = None, text: str = "text", gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Annotations, those touched, and recall of spans by type (and of characters by ``document`` and type)."""
    each = df.select(*([document] if document else []), F.col(text).alias("t"), F.col(predicted).alias("p"), F.explode(gold).alias("g"))
    hit = F.exists("p", lambda o: _overlaps(F.col("g"), o))
    keys = [*([document] if document else []), F.col("g.entity_type").alias("entity_type")]
    out = each.groupBy(*keys).agg(F.count("*").alias("entities"), F.count_if(hit).alias("detected"))
    out = out.withColumn("recall", F.round(ratio(F.col("detected"), F.col("entities")), 4))
    if not document:
        return out
    kinds = df.select(document, F.col(text).alias("t"), F.col(predicted).alias("p"), F.col(gold).alias("g"), F.explode(F.array_distinct(F.transform(gold, lambda x: x["entity_type"]))).alias("entity_type"))
    mine = kinds.withColumn("g", F.filter("g", lambda x: x["entity_type"] == F.col("entity_type")))
    chars = scored(mine, "t", "g", "p").select(document, "entity_type", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("char_recall"))
    return out.join(chars, [document, "entity_type"])


def for_mode(df: DataFrame, mode: str, predicted: str = "predicted") -> DataFrame:
    """In mode redaction, predictions of types that the default policy preserves don't count; in mode detection all do."""
    if mode not in ("detection", "redaction"):
        raise ValueError(f"no such mode: {mode}")
    kept = [k for k, v in DEFAULT_POLICY.items() if v == "PRESERVE"]
    return df.withColumn(predicted, F.filter(predicted, lambda s: ~s["entity_type"].isin(*kept))) if mode == "redaction" else df


def restricted(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Only predictions of types that are annotated anywhere in the corpus (a set of at most twelve)."""
    kinds = df.select(F.explode(gold).alias("g")).agg(F.collect_set("g.entity_type").alias("kinds"))
    return df.crossJoin(F.broadcast(kinds)).withColumn(predicted, F.filter(predicted, lambda s: F.array_contains("kinds", s["entity_type"]))).drop("kinds")


def matching(gold: DataFrame, predicted: DataFrame, how: str = "overlap", keep: str = "left_semi", doc: str = "doc_id") -> DataFrame:
    """Rows of ``gold`` (doc, start, end) that meet a row of ``predicted`` of their document, or with left_anti those that don't.

    For spans as rows: an equi-join of documents, with the overlap as a condition on top.
    """
    g, p = gold.alias("g"), predicted.alias("p")
    same = F.col(f"g.{doc}") == F.col(f"p.{doc}")
    test = (F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end")) if how == "exact" else (F.col("g.start") < F.col("p.end")) & (F.col("p.start") < F.col("g.end"))
    return g.join(p, same & test, keep)


def occurrences(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``spans`` with the number of spans of the same document that have the same text, in any case."""
    from pyspark.sql import Window

    key = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    return spans.withColumn("occurrences", F.count("*").over(Window.partitionBy(doc, key)))
