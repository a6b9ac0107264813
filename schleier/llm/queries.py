"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, content, decontaminate, media, neardup, ngram, secrets, toxicity, urlfilter, warc
from .common import bound_batches


def bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query in a session whose Arrow batches are bounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {
        "op1_media_columns": media.query,
        "op2_ngram_lm": ngram.query,
        "op3_byte_bpe": bpe.query,
        "op4_decontaminate": decontaminate.query,
        "op5_url_filter": urlfilter.query,
        "op6_html_content": content.query,
        "op7_warc_archive": warc.query,
        "op8_secret_scan": secrets.query,
        "op9_near_dedup": neardup.query,
        "op10_toxicity": toxicity.query,
    }
    return {name: bounded(query) for name, query in every.items()}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": urlfilter.SQL, "op7_warc_archive": warc.SQL}
