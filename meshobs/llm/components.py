"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connect(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``rep, label`` of every end of ``links`` (``a, b``); the label is the smallest end of its component.

    Each step gives a node the smallest label among itself and its neighbours and then the label of that label, until
    nothing changes; a chain halves with every step.  Minima are combined before the shuffle, so a hub costs no more than its links.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.save(both.distinct(), f"{name}-edges")
    labels = scratch.save(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "rep"), f"{name}-0")
    for step in range(1, 200):
        around = edges.join(labels.select(F.col("rep").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("best"))
        near = labels.join(around.withColumnRenamed("a", "rep"), "rep").select("rep", "label", F.least("label", "best").alias("next"))
        jump = labels.select(F.col("rep").alias("next"), F.col("label").alias("far"))
        moved = near.join(jump, "next", "left").select("rep", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label"))
        found = scratch.save(moved, f"{name}-{step}")
        labels = found.select("rep", "label")
        if found.filter("old <> label").isEmpty():
            break
    return labels
