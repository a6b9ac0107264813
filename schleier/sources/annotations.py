"""Annotated corpora: JSON lines, UIMA CAS JSON, folders and archives of these."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..types import ENTITY_TYPES, LABELS

GOLD_DDL = "array<struct<start:int,end:int,label:string,entity_type:string>>"
ROW = "document_id string, text string, entities array<struct<start:int,end:int,entity_type:string,label:string,text:string>>"
CAS = "`%FEATURE_STRUCTURES` array<struct<`%ID`:int,`%TYPE`:string,sofaString:string,`begin`:int,`end`:int,label:string>>"


def label_map(custom: dict[str, str] | None = None) -> dict[str, str]:
    return LABELS | {t.lower(): t for t in ENTITY_TYPES} | {k.strip().lower(): v for k, v in (custom or {}).items()}


def mapped(label: Column, custom: dict[str, str] | None = None) -> Column:
    """The type of a label; null for unknown ones."""
    table = F.create_map(*(F.lit(x) for kv in label_map(custom).items() for x in kv))
    return F.try_element_at(table, F.lower(F.trim(label)))


def _typed(spans: Column, custom: dict[str, str] | None) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.coalesce(mapped(s["label"], custom), F.lit("OTHER_PII")).alias("entity_type"))).cast(GOLD_DDL)


def _unknown(spans: Column, custom: dict[str, str] | None) -> Column:
    return F.transform(F.array_distinct(F.transform(F.filter(spans, lambda s: mapped(s["label"], custom).isNull()), lambda s: s["label"])), lambda k: F.concat(F.lit("unknown label "), F.coalesce(k, F.lit("(none)"))))


def _numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, n): the lines of text files that aren't blank, with their numbers in their file.

    Files are split into blocks as Spark does. The lines of each block are counted, and a line's number is its place in the
    block and the lines of the blocks before it; only counts and lines without an id of their own move.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    lines = raw.where(F.col("value").rlike(r"(?U)\S"))
    named = F.get_json_object("value", "$.document_id").isNotNull()
    loose = lines.where(~named).join(starts, ["file", "block"]).select("value", (F.col("at") + F.col("shift")).alias("n"))
    return lines.where(named).select("value", F.lit(None).cast("long").alias("n")).unionByName(loose).withColumnRenamed("value", "line")


def json_lines(spark: SparkSession, path: str | list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """(document_id, text, gold, warnings); blank lines are skipped, but counted for the id 'line-N' of lines without one.

    A line without text, with spans outside it, or with a span whose text differs fails the query, whichever columns are asked for.
    """
    got = _numbered_lines(spark, path).select("n", F.from_json("line", ROW, {"mode": "FAILFAST"}).alias("d"))
    name = F.coalesce("d.document_id", F.concat(F.lit("line-"), F.col("n").cast("string")))
    spans = F.transform(F.coalesce("d.entities", F.array().cast("array<struct<start:int,end:int,entity_type:string,label:string,text:string>>")), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.coalesce(e["entity_type"], e["label"]).alias("label"), e["text"].alias("text")))
    rows = got.select(name.alias("document_id"), F.col("d.text").alias("text"), spans.alias("spans"))
    bad = lambda s: s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length("text")) | (s["text"].isNotNull() & (F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) != s["text"]))
    why = F.when(F.col("text").isNull(), F.concat("document_id", F.lit(": it has no text"))).when(F.exists("spans", bad), F.concat("document_id", F.lit(": a span doesn't fit its text")))
    checked = rows.where(F.when(why.isNull(), F.lit(True)).otherwise(F.raise_error(why).cast("boolean")))
    return checked.select("document_id", "text", _typed(F.col("spans"), labels).alias("gold"), _unknown(F.col("spans"), labels).alias("warnings"))


def _from_cas(rows: DataFrame, labels: dict[str, str] | None) -> DataFrame:
    fs = F.col("`%FEATURE_STRUCTURES`")
    text = F.try_element_at(F.transform(F.filter(fs, lambda x: x["%TYPE"] == "uima.cas.Sofa"), lambda x: x["sofaString"]), F.lit(1))
    marked = F.filter(fs, lambda x: (x["%TYPE"] == "custom.Span") & x["label"].isNotNull())
    # the format leaves out a feature that is 0
    spans = F.transform(marked, lambda x: F.struct(F.coalesce(x["begin"], F.lit(0)).alias("start"), F.coalesce(x["end"], F.lit(0)).alias("end"), x["label"].alias("label")))
    found = rows.select("document_id", text.alias("text"), spans.alias("spans"))
    fits = lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length("text"))
    skipped = F.transform(F.filter("spans", lambda s: ~fits(s)), lambda s: F.concat(F.lit("span skipped: "), s["label"]))
    good = F.filter("spans", fits)
    return found.select("document_id", "text", _typed(good, labels).alias("gold"), F.concat(skipped, _unknown(good, labels)).alias("warnings"))


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")


def cas_json(spark: SparkSession, path: str, labels: dict[str, str] | None = None) -> DataFrame:
    """UIMA CAS files: the first Sofa's text and its custom spans; spans that don't fit are skipped with a warning."""
    rows = spark.read.schema(CAS).json(path, multiLine=True).select(_stem(F.col("_metadata.file_path")).alias("document_id"), "`%FEATURE_STRUCTURES`")
    return _from_cas(rows, labels)


def folder(spark: SparkSession, path: str, labels: dict[str, str] | None = None) -> DataFrame:
    """The .json and .jsonl files directly in a folder, without hidden ones."""
    raw = spark.read.format("binaryFile").load(path).select("path").where(~F.col("path").rlike(r"/(?:\.|__MACOSX)[^/]*$"))
    names = [r[0] for r in raw.orderBy("path").collect()]  # a folder's names
    parts = [read(spark, some, labels) for read, end in ((cas_json, ".json"), (json_lines, ".jsonl")) if (some := [n for n in names if n.lower().endswith(end)])]
    if not parts:
        raise ValueError(f"no annotations in {path}")
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def archive(spark: SparkSession, path: str, labels: dict[str, str] | None = None) -> DataFrame:
    """The .json members of zip archives, a row each, hidden ones left out."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        base = name.rsplit("/", 1)[-1]
                        if base.lower().endswith(".json") and not base.startswith(".") and not name.startswith("__MACOSX"):
                            body = z.read(name).decode("utf-8-sig")
                            json.loads(body)  # what isn't JSON fails
                            yield pd.DataFrame({"name": [name], "body": [body]})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "name string, body string")
    got = rows.select(_stem(F.col("name")).alias("document_id"), F.from_json("body", CAS, {"mode": "FAILFAST"}).alias("d"))
    return _from_cas(got.select("document_id", "d.`%FEATURE_STRUCTURES`"), labels)


def with_labels(spans: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """``spans`` (label) with ``entity_type`` by a join with the label table; unknown labels are OTHER_PII with a warning."""
    table = spans.sparkSession.createDataFrame(list(label_map(custom).items()), "key_ string, entity_type string")
    out = spans.join(F.broadcast(table), F.lower(F.trim("label")) == F.col("key_"), "left").drop("key_")  # a few dozen rows
    return out.withColumn("label_warning", F.when(F.col("entity_type").isNull(), F.concat(F.lit("unknown label "), "label"))).withColumn("entity_type", F.coalesce("entity_type", F.lit("OTHER_PII")))
