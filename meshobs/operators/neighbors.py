"""Neighbour edges between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .filters import merge_by_key
from .resolve import came, within


def fold_neighbors(adverts: DataFrame, intervals: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """Edges from an advertising relay to its first hop where that is one node when the advert comes.

    ``adverts`` has ``node_id, node_type, iata, heard_at, path_bytes, hash_size`` of inserted adverts; ``intervals`` is what ``unique_intervals`` gives.
    """
    relays = adverts.filter(F.col("node_type").isin(X.REPEATER, X.ROOM_SERVER) & (F.length("path_bytes") >= 2 * F.col("hash_size")))
    first = relays.withColumn("hop", F.substring(F.col("path_bytes"), F.lit(1), 2 * F.col("hash_size")))
    edges = first.join(intervals.withColumnRenamed("node_id", "neighbor_id"), ["iata", "hop"]).filter(within(came(adverts)))
    new = edges.groupBy("node_id", "neighbor_id", "iata").agg(F.min("heard_at").alias("first_seen"), F.max("heard_at").alias("last_seen"), F.count(F.lit(1)).alias("observation_count"))
    return merge_by_key(existing, new, ["node_id", "neighbor_id", "iata"], {"first_seen": "min", "last_seen": "max", "observation_count": "sum"})


def neighbor_counts(edges: DataFrame) -> DataFrame:
    """Edges out of each node, over all places."""
    return edges.groupBy("node_id").agg(F.count(F.lit(1)).alias("neighbor_count"))


def node_neighbors_merged(edges: DataFrame, nodes: DataFrame, *, ordered: bool = True) -> DataFrame:
    """One row per node and neighbour over all places, with the place of the newest edge; newest first if ``ordered``."""
    merged = edges.groupBy("node_id", "neighbor_id").agg(
        F.sum("observation_count").alias("observation_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("iata", F.struct("last_seen", "iata")).alias("iata")
    )
    named = merged.join(nodes.select(F.col("node_id").alias("neighbor_id"), F.col("name").alias("neighbor_name"), F.col("node_type").alias("neighbor_type")), "neighbor_id", "left")
    return named.orderBy("node_id", F.desc("last_seen"), "neighbor_id") if ordered else named


def reconfirm_neighbors(edges: DataFrame, short_ids: DataFrame) -> DataFrame:
    """Edges whose neighbour has a short id in the place that no other node shares."""
    shared = short_ids.groupBy("iata", "prefix_4").agg(F.count(F.lit(1)).alias("n"))
    clear = short_ids.join(shared.filter("n = 1"), ["iata", "prefix_4"]).select(F.col("node_id").alias("neighbor_id"), "iata")
    return edges.join(clear, ["neighbor_id", "iata"], "left_semi")


def clean_neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without edges that have an end known not to be a relay; unknown ends are kept."""
    other = nodes.filter(~F.col("node_type").isin(X.REPEATER, X.ROOM_SERVER)).select("node_id")
    kept = edges.join(other, "node_id", "left_anti")
    return kept.join(other.select(F.col("node_id").alias("neighbor_id")), "neighbor_id", "left_anti")


def cross_iata_neighbors(edges: DataFrame, nodes: DataFrame, *, iata: str) -> DataFrame:
    """Edges recorded elsewhere than in ``iata``, with the neighbour's details, newest first."""
    named = edges.filter(F.col("iata") != iata).join(nodes.select(F.col("node_id").alias("neighbor_id"), F.col("name").alias("neighbor_name"), F.col("node_type").alias("neighbor_type")), "neighbor_id")
    return named.orderBy(F.desc("last_seen"), "node_id", "neighbor_id", "iata")
