"""Connected components by contraction to least labels; nothing is collected but whether a round left anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def spread(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """The join on ``key`` with rows of a key dealt to ``salts`` tasks; ``right`` has few rows a key, and is repeated."""
    salted = left.withColumn("salt_", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    return salted.join(right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*([key] if isinstance(key, str) else key), "salt_"], how).drop("salt_")


def _roots(parent: DataFrame) -> DataFrame:
    """(node, label) of a forest of least neighbours, (node, label) with label <= node, with each label the root of its tree."""
    while True:
        jump = parent.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = checkpoint(spread(parent, jump, "label").select("node", F.col("label").alias("old"), F.col("far").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        parent = new.select("node", "label")
        if not changed:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: bigint); label is the least node of its component.

    In each round every node goes to the root of its least neighbours, and edges between roots are left for the next. Of nodes that
    have edges at most half remain after two rounds, and edges within a tree are never read again.
    """
    labels = None
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    live = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while live.limit(1).count():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = _roots(checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))))
        to = lambda end: root.select(F.col("node").alias(end), F.col("label").alias(f"{end}_root"))
        ends = spread(spread(live, to("a"), "a"), to("b"), "b").where("a_root <> b_root")
        live = checkpoint(ends.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        if labels is None:
            labels = root
        else:
            far = root.select(F.col("node").alias("label"), F.col("label").alias("far"))
            labels = checkpoint(spread(labels, far, "label", "left").select("node", F.coalesce("far", "label").alias("label")))
    if labels is None:
        return checkpoint(nodes.select("node", F.col("node").alias("label")))
    # nodes with an edge to themselves alone
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct().join(labels, "node", "left_anti")
    return labels.union(alone.select("node", F.col("node").alias("label")))
