"""The batch pipeline on a stream: it moves no rows, so no state and no watermark are needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.deidentify import deidentified


def source(spark: SparkSession, path: str, schema: StructType | str, files_a_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def start(docs: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = deidentified, once: bool = True, kind: str = "parquet") -> StreamingQuery:
    """Results of a stream as Parquet, or with ``kind`` 'json' as lines of JSON, exactly once; ``once`` ends it when what is there is done."""
    out = transform(docs).writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="10 seconds")).start()
