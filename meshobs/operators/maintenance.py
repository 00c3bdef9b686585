"""Periodic jobs: published aggregates, retention and reconfirmation."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .neighbors import reconfirm_neighbors
from .routes import reconfirm_routes
from .stats import hourly_stats, radio_presets, top_nodes


def write_published(df: DataFrame, path: str, *, partition_by: str | None = "iata", keep: int = 2) -> str:
    """Publish an aggregate below ``path`` and return the folder of the new version.

    A version is written beside the others and gets its name ``v=N`` only when whole, so readers never see a hole or half a table; the
    ``keep`` newest versions stay for those that still read them.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = _versions(spark, path)
    draft = f"{path}/.draft-{uuid4().hex}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(draft)
    target = f"{path}/v={max(versions, default=0) + 1}"
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{target} exists")
    for old in sorted(versions)[: max(0, len(versions) + 1 - keep)]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}"), True)
    return target


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a published aggregate."""
    return spark.read.parquet(f"{path}/v={max(_versions(spark, path))}")


def write_hourly_stats(obs: DataFrame, path: str, *, as_of) -> str:
    """The hourly counts of the last seven days."""
    return write_published(hourly_stats(obs, as_of=as_of), f"{path}/hourly_stats")


def write_top_nodes(node_iatas: DataFrame, nodes: DataFrame, path: str, *, as_of) -> str:
    """Nodes heard in the last seven days by place, with their counts; the reader takes as many as it shows."""
    return write_published(top_nodes(node_iatas, nodes, as_of=as_of, limit=None), f"{path}/top_nodes")


def write_radio_presets(observers: DataFrame, obs: DataFrame, nodes: DataFrame, node_iatas: DataFrame, path: str) -> str:
    """Devices per place and radio preset."""
    return write_published(radio_presets(observers, obs, nodes, node_iatas), f"{path}/radio_presets")


def refresh_published(tables: dict[str, DataFrame], path: str, *, as_of) -> dict[str, str]:
    """T10, hourly: all three aggregates from ``observations, node_iatas, nodes, observers``; the new folders by name."""
    obs, places, nodes = tables["observations"], tables["node_iatas"], tables["nodes"]
    return {
        "hourly_stats": write_hourly_stats(obs, path, as_of=as_of), "top_nodes": write_top_nodes(places, nodes, path, as_of=as_of),
        "radio_presets": write_radio_presets(tables["observers"], obs, nodes, places, path),
    }


def prune_old(packets: DataFrame, obs: DataFrame, telemetry: DataFrame, *, as_of, packet_retention: str = "30 days", telemetry_retention: str = "28 days") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without packets last heard before the cutoff and their observations, and without old telemetry; messages stay."""
    kept = packets.filter(F.col("last_heard_at") >= F.lit(as_of) - F.expr(f"INTERVAL {packet_retention}"))
    fresh = telemetry.filter(F.col("reported_at") >= F.lit(as_of) - F.expr(f"INTERVAL {telemetry_retention}"))
    return kept, obs.join(kept.select("packet_hash"), "packet_hash", "left_semi"), fresh


def reconfirm(routes: DataFrame, edges: DataFrame, short_ids: DataFrame, *, by_width: bool = False) -> tuple[DataFrame, DataFrame]:
    """Routes first, then edges."""
    return reconfirm_routes(routes, short_ids, by_width=by_width), reconfirm_neighbors(edges, short_ids)


def hourly_upkeep(tables: dict[str, DataFrame], path: str, *, as_of, packet_retention: str = "30 days", telemetry_retention: str = "28 days", by_width: bool = False) -> dict[str, DataFrame]:
    """What runs every hour: published aggregates, then ``tables`` with old rows pruned and routes and edges reconfirmed."""
    refresh_published(tables, path, as_of=as_of)
    packets, obs, telemetry = prune_old(tables["packets"], tables["observations"], tables["telemetry"], as_of=as_of, packet_retention=packet_retention, telemetry_retention=telemetry_retention)
    routes, edges = reconfirm(tables["known_routes"], tables["node_neighbors"], tables["node_short_ids"], by_width=by_width)
    return tables | {"packets": packets, "observations": obs, "telemetry": telemetry, "known_routes": routes, "node_neighbors": edges}
