"""Aggregates over observations: hourly series, overview, breakdowns and top lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .filters import between, filter_iatas, heard_in, top, trailing
from .observers import observer_last_iata

Places = Sequence[str] | None


def hourly_stats(obs: DataFrame, *, as_of, iatas: Places = None, window: str = "7 days") -> DataFrame:
    """A1: per place and hour the observations, distinct packets and distinct observers of the last days.

    Two exact distinct counts in one aggregate would copy each row three times before the shuffle.  Here packets are counted per (place, hour,
    packet) and observers per (place, hour, observer), each combined before its shuffle; the two small results join on (place, hour).
    """
    recent = trailing(filter_iatas(obs, iatas), "heard_at", as_of=as_of, window=window)
    rows = recent.select("iata", F.date_trunc("hour", "heard_at").alias("hour"), "packet_hash", "observer_id")
    return distinct_counts(rows, ["iata", "hour"])


def distinct_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct ``packet_hash`` and distinct ``observer_id`` per ``keys``."""
    by_packet = rows.groupBy(*keys, "packet_hash").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("observations"), F.count("packet_hash").alias("packets")).alias("p")
    by_observer = rows.select(*keys, "observer_id").distinct().groupBy(*keys).agg(F.count("observer_id").alias("observers")).alias("o")
    same = reduce(and_, (F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys))
    return by_packet.join(by_observer, same).select(*(F.col(f"p.{k}").alias(k) for k in keys), "observations", "packets", "observers")


def hourly_series(stats: DataFrame, *, as_of, hours: int, iatas: Places = None) -> DataFrame:
    """A1, read side: the last whole ``hours`` of stored hourly rows."""
    return filter_iatas(stats, iatas).filter(F.col("hour") >= F.lit(as_of) - F.make_dt_interval(hours=F.lit(hours))).orderBy("iata", "hour")


def stats_overview(obs: DataFrame, *, as_of, iatas: Places = None, approximate: bool = False) -> DataFrame:
    """A2: the last 24 hours in one row."""
    recent = trailing(filter_iatas(obs, iatas), "heard_at", as_of=as_of, window="24 hours")
    if approximate:
        distinct = F.approx_count_distinct
        return recent.agg(
            distinct("packet_hash").alias("packets"), F.count(F.lit(1)).alias("observations"), distinct("observer_id").alias("observers"), distinct("iata").alias("places")
        )
    # Each exact distinct count combines before its own shuffle; one aggregate of three would copy every row four times.
    packets = recent.groupBy("packet_hash").agg(F.count(F.lit(1)).alias("n")).agg(F.count("packet_hash").alias("packets"), F.coalesce(F.sum("n"), F.lit(0)).alias("observations"))
    others = [recent.select(c).distinct().agg(F.count(c).alias(n)) for c, n in (("observer_id", "observers"), ("iata", "places"))]
    return packets.crossJoin(F.broadcast(others[0])).crossJoin(F.broadcast(others[1]))  # one row each


def payload_breakdown(obs: DataFrame, packets: DataFrame, *, since, iatas: Places = None) -> DataFrame:
    """A3: observations per payload type; counted per packet before the join, which then carries one row per packet."""
    counts = between(filter_iatas(obs, iatas), "heard_at", since=since).groupBy("packet_hash").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.join(packets.select("packet_hash", "payload_type"), "packet_hash").groupBy("payload_type").agg(F.sum("n").alias("observations"))
    return kinds.withColumn("name", X.payload_type_name(F.col("payload_type"))).orderBy(F.desc("observations"), "payload_type")


def node_types(nodes: DataFrame, node_iatas: DataFrame, *, iatas: Places = None) -> DataFrame:
    """A4: nodes per type; with places only those heard there."""
    kept = heard_in(nodes, node_iatas, "node_id", iatas)
    return kept.groupBy("node_type").agg(F.countDistinct("node_id").alias("nodes")).withColumn("name", X.node_type_name(F.col("node_type")))


def top_observers(obs: DataFrame, observers: DataFrame, *, since, iatas: Places = None, limit: int | None = 10) -> DataFrame:
    """A5: observers with most observations, and the place of their newest observation of all time."""
    counts = between(filter_iatas(obs, iatas), "heard_at", since=since).groupBy("observer_id").agg(F.count(F.lit(1)).alias("observations"))
    named = counts.join(observers.select("observer_id", "display_name"), "observer_id").join(observer_last_iata(obs), "observer_id", "left")
    named = named.withColumn("iata", F.coalesce("iata", F.lit("")))
    return top(named, "observations", limit=limit, ties=["observer_id"])


def top_nodes(node_iatas: DataFrame, nodes: DataFrame, *, as_of, iatas: Places = None, limit: int | None = 10) -> DataFrame:
    """Nodes with most adverts per place, among those heard in the last seven days."""
    recent = trailing(filter_iatas(node_iatas, iatas), "last_heard", as_of=as_of, window="7 days")
    named = recent.join(nodes.select("node_id", "name", "node_type"), "node_id")
    named = named.select("node_id", "name", "node_type", "iata", F.coalesce("observation_count", F.lit(0)).alias("observation_count"))
    return top(named, "observation_count", limit=limit, ties=["node_id", "iata"])


def radio_presets(observers: DataFrame, obs: DataFrame, nodes: DataFrame, node_iatas: DataFrame, *, preset: str | None = None, iatas: Places = None) -> DataFrame:
    """Devices per place and preset: observers at their last place, nodes at each of theirs.

    ``observers`` and ``nodes`` carry ``preset``, which is null where a part of it is unknown.
    """
    gateways = observers.filter("preset IS NOT NULL").join(observer_last_iata(obs), "observer_id")
    radios = nodes.filter("preset IS NOT NULL").join(node_iatas.select("node_id", "iata"), "node_id")
    sides = [(gateways, "observers"), (radios, "nodes")]
    rows = [df.groupBy("iata", "preset").agg(F.count(F.lit(1)).alias("devices")).withColumn("kind", F.lit(kind)) for df, kind in sides]
    out = filter_iatas(rows[0].unionByName(rows[1]), iatas)
    return out.filter(F.col("preset") == preset) if preset else out
