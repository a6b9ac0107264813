"""A training corpus from documents, stage by stage: toxic documents go, one of each group of near-duplicates
stays, contaminated documents go, secrets are masked, and what is left is encoded.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. Between stages
the documents are written as Parquet and read again. All stages but the last return the columns of documents, whatever
other columns there are and however they are named; the last returns its own six.

In every stage a null text counts as an empty one and stays null, a null id is an id like others (the greatest), repeated
rows and ties get equal decisions (of equal rows near-dedup keeps one), texts of any length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schleier.llm import bpe, decontaminate, neardup, secrets, toxicity
from schleier.llm.common import bound_batches, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the cut go; empty ones have the score of no clause at all, and stay."""
    bound_batches(spark)
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class stays; texts without words are in a class with equal ones only."""
    bound_batches(spark)
    return neardup.dedupe(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go; documents without words stay."""
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of secrets become a mark, and n_chars follows."""
    bound_batches(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and their ends in its text (packed, little-endian, 32 bits each), the ids' number, and digests of ids and of
    the decoded bytes. Other columns of documents end here."""
    bound_batches(spark)
    out = bpe.encode(docs.select("doc_id", F.col("text")), bpe.default_vocabulary(), decoded="decoded")
    return out.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "token_ids", "token_ends")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte-bpe", encode),
]

#: Learned scores, signatures, an index and a tokenizer: SQL can't express a stage, so tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
