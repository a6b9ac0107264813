"""How far a batch of documents is: events of documents, read with tolerance, and the batch's share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT = "event string, stage string, done long, total long"


def events(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` of JSON as (event, stage, done, total); what isn't JSON, or isn't an event, is left out."""
    got = lines.withColumn("event_", F.from_json(F.col(line), EVENT))
    return got.where(F.col("event_.event").isNotNull()).select(*lines.columns, "event_.*")


def percent(status, done, total):
    """Of one document: 100 once it is settled, 0 while it waits, else its share of steps."""
    share = F.when(total > 0, 100.0 * done / total).otherwise(0.0)
    return F.when(status.isin("done", "failed"), 100.0).when(status == "queued", 0.0).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)))


def batch(states: DataFrame, batch_id: str = "batch_id", at: str = "at") -> DataFrame:
    """(batch, at, percent): the mean of the documents' percent at each time, which never falls. ``states`` has a row for each document and time."""
    mean = states.groupBy(batch_id, at).agg(F.avg("percent").alias("mean"))
    so_far = Window.partitionBy(batch_id).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return mean.select(batch_id, at, F.max("mean").over(so_far).alias("percent"))
