"""Writers: results as JSON or Parquet, texts, and the evaluation's report. Files are named by document id only."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate


def response(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, result): output, entities and validation as one JSON document each."""
    return df.select(doc, F.to_json(F.struct(F.col("output").alias("anonymized_text"), F.col("applied").alias("entities"), F.struct(F.col("validation_status").alias("status"), "warnings").alias("validation"))).alias("result"))


def write_results(df: DataFrame, path: str, doc: str = "doc_id") -> None:
    response(df, doc).write.mode("errorifexists").json(path)


def write_texts(df: DataFrame, path: str, doc: str = "doc_id") -> None:
    """One folder a document, as text files."""
    df.select(F.col(doc).alias("document"), F.regexp_replace("output", "\r\n?", "\n").alias("value")).write.partitionBy("document").mode("errorifexists").text(path)


def archives(df: DataFrame, suffix: str = "anonymized", doc: str = "doc_id", texts_each: int = 1000) -> DataFrame:
    """(archive, content): ZIP files of at most about ``texts_each`` texts, named by document id; equal inputs give equal bytes."""
    n = df.select(F.greatest(F.ceil(F.count("*") / texts_each), F.lit(1)).cast("int").alias("archives"))
    rows = df.select(F.col(doc).cast("string").alias("name"), F.coalesce("output", F.lit("")).alias("text")).join(F.broadcast(n))  # one row
    rows = rows.select(F.pmod(F.xxhash64("name"), F.col("archives")).cast("int").alias("archive"), "name", "text")

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            seen: dict[str, int] = {}
            for name, text in sorted(zip(group["name"].fillna("none"), group["text"])):
                safe = re.sub(r"[^\w.-]", "_", name)
                seen[safe] = seen.get(safe, 0) + 1
                number = f"-{seen[safe]}" if seen[safe] > 1 else ""
                z.writestr(zipfile.ZipInfo(f"{safe}{number}-{suffix}.txt", (1980, 1, 1, 0, 0, 0)), text)
        return pd.DataFrame({"archive": [int(key[0])], "content": [out.getvalue()]})

    return rows.groupBy("archive").applyInPandas(one, "archive int, content binary")


def report(scored: DataFrame, path: str, doc: str = "doc_id", with_text: bool = False) -> None:
    """documents, aggregate and types below ``path``; the texts of missed annotations only if asked for."""
    missed = F.transform("missed", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["entity_type"].alias("entity_type"), m["label"].alias("label"), *([F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"]).alias("text")] if with_text else [])))
    rows = evaluate.with_metrics(scored).withColumn("missed", missed).drop("text", "gold", "predicted", "spans")
    rows.write.mode("errorifexists").json(f"{path}/documents")
    evaluate.micro(scored).crossJoin(evaluate.leakage(scored)).write.json(f"{path}/aggregate")  # one row each
    evaluate.by_type(scored).write.json(f"{path}/types")


def summary(scored: DataFrame) -> str:
    """A few lines for a console."""
    a, m = evaluate.leakage(scored).first(), evaluate.micro(scored).first()
    lines = [f"{a['leaked_documents']} of {a['documents']} documents leak ({a['leakage_rate']:.2%})"]
    lines += [f"{k:8} P {m[f'{k}_precision']:.4f}  R {m[f'{k}_recall']:.4f}  F1 {m[f'{k}_f1']:.4f}" for k in ("char", "overlap", "exact")]
    lines += [f"{r['entity_type']:15} {r['detected']}/{r['entities']} = {r['recall']:.4f}" for r in evaluate.by_type(scored).orderBy("entity_type").collect()]  # twelve types
    return "\n".join(lines)
