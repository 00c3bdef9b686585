"""Nodes: folds of adverts, places, and their lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .filters import equals, heard_in, limited, merge_by_key, name_like, page_desc, tristate
from .neighbors import neighbor_counts, node_neighbors_merged


def node_places(node_iatas: DataFrame) -> DataFrame:
    """Per node an array of places and when they were last heard, newest first by the whole time, of which milliseconds are shown."""
    newest = F.sort_array(F.collect_list(F.struct("last_heard", "iata")), asc=False)
    shown = F.transform(newest, lambda p: F.struct(X.epoch_ms(p["last_heard"]).alias("last_heard_ms"), p["iata"].alias("iata")))
    return node_iatas.groupBy("node_id").agg(shown.alias("places"))


def fold_nodes(adverts: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """Per public key the last type, name and radio, the last position that is not 0,0, and when it was seen.

    ``adverts`` are inserted advert observations with ``seq, arrival_ts, hop_count``, the struct ``advert``, and the observer's radio values.
    An empty name overwrites; the radio is known only for adverts heard directly.
    """
    a = F.col("advert")
    located = (F.coalesce(a["lat"], F.lit(0)) != 0) | (F.coalesce(a["lon"], F.lit(0)) != 0)
    direct = (F.col("hop_count") == 0) & (F.coalesce("radio_freq_mhz", F.lit(0)) != 0)
    rows = adverts.select(
        a["pubkey"].alias("public_key"), "seq", "arrival_ts", a["type"].alias("node_type"), F.coalesce(a["name"], F.lit("")).alias("name"),
        F.when(located, a["lat"] / 1e6).alias("latitude"), F.when(located, a["lon"] / 1e6).alias("longitude"),
        *(F.when(direct, F.col(c)).alias(n) for c, n in (("radio_freq_mhz", "radio_freq_mhz"), ("spread_factor", "radio_sf"), ("bandwidth_khz", "radio_bw_khz"))),
    )
    taken, known = ["node_type", "name", "radio_freq_mhz", "radio_sf", "radio_bw_khz"], ["latitude", "longitude"]
    new = rows.groupBy("public_key").agg(
        *(F.max_by(c, "seq").alias(c) for c in taken), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in known),
        F.min("arrival_ts").alias("first_seen"), F.max("arrival_ts").alias("last_seen"), F.max("arrival_ts").alias("last_advert_at"),
    )
    rules = dict.fromkeys(taken, "last") | dict.fromkeys(known, "last_known") | {"first_seen": "min", "last_seen": "max", "last_advert_at": "max"}
    return merge_by_key(existing, new, ["public_key"], rules).withColumn("location_source", F.when(F.col("latitude").isNotNull(), "advert"))


def fold_default_scope(adverts: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """The last scope matched on a node's adverts with transport routing (``public_key, route_type, scope_id, seq``)."""
    matched = adverts.filter(F.col("route_type").isin(X.TRANSPORT_FLOOD, X.TRANSPORT_DIRECT) & F.col("scope_id").isNotNull())
    new = matched.groupBy("public_key").agg(F.max_by("scope_id", "seq").alias("default_scope_id"))
    return merge_by_key(existing, new, ["public_key"], {"default_scope_id": "last"})


def fold_node_iatas(adverts: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """Per node and place the inserted advert observations (``node_id, iata, heard_at``)."""
    new = adverts.groupBy("node_id", "iata").agg(F.min("heard_at").alias("first_heard"), F.max("heard_at").alias("last_heard"), F.count(F.lit(1)).alias("observation_count"))
    return merge_by_key(existing, new, ["node_id", "iata"], {"first_heard": "min", "last_heard": "max", "observation_count": "sum"})


def fold_short_ids(adverts: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """Per node and place the first one to four bytes of the key (``node_id, iata, public_key``)."""
    new = adverts.select("node_id", "iata", X.key_prefix(F.col("public_key"), 4).alias("prefix_4")).dropDuplicates(["node_id", "iata"])
    merged = merge_by_key(existing, new, ["node_id", "iata"], {"prefix_4": "first"})
    return merged.withColumns({f"prefix_{n}": X.key_prefix(F.col("prefix_4"), n) for n in (1, 2, 3)})


def with_observer_link(nodes: DataFrame, observers: DataFrame) -> DataFrame:
    """``is_observer`` and ``observer_id`` by equal public key."""
    linked = nodes.join(observers.select("public_key", "observer_id"), "public_key", "left")
    return linked.withColumn("is_observer", F.col("observer_id").isNotNull())


def list_nodes(
    nodes: DataFrame, node_iatas: DataFrame, observers: DataFrame, edges: DataFrame, scopes: DataFrame, *, node_type: int | None = None, iatas: Sequence[str] | None = None,
    multibyte_paths: bool | None = None, multibyte_traces: bool | None = None, public_key: str | None = None, name: str | None = None, scope: str | None = None, cursor=None, limit: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Nodes with type name, places, observer link, neighbour count and default scope, newest first where ``last_seen`` is known."""
    kept = heard_in(name_like(equals(nodes, node_type=node_type, public_key=public_key), "name", name), node_iatas, "node_id", iatas)
    for flag, value in (("multibyte_paths", multibyte_paths), ("multibyte_traces", multibyte_traces)):
        kept = tristate(kept, flag, value)
    kept = kept.join(scopes.select(F.col("scope_id").alias("default_scope_id"), F.col("name").alias("default_scope")), "default_scope_id", "left")
    kept = with_observer_link(equals(kept, default_scope=scope), observers)
    found = kept.join(node_places(node_iatas), "node_id", "left").join(neighbor_counts(edges), "node_id", "left")
    found = found.withColumns(
        {"node_type_name": X.node_type_name(F.col("node_type")), "neighbor_count": F.coalesce("neighbor_count", F.lit(0)), "places": F.coalesce("places", F.array().cast("array<struct<last_heard_ms:bigint,iata:string>>"))}
    )
    if not ordered:
        return found
    if "last_seen" in found.columns:
        return page_desc(found, "last_seen", cursor=cursor, limit=limit, ties=["node_id"])
    return limited(found.orderBy("node_id"), limit)


def node_profile(nodes: DataFrame, node_iatas: DataFrame, observers: DataFrame, edges: DataFrame, scopes: DataFrame) -> DataFrame:
    """The list's columns, the least firmware and the merged neighbours, newest first."""
    each = F.struct(X.epoch_ms(F.col("last_seen")).alias("last_seen_ms"), "neighbor_id", "neighbor_name", "observation_count", "iata")
    merged = node_neighbors_merged(edges, nodes, ordered=False).groupBy("node_id").agg(F.sort_array(F.collect_list(each), asc=False).alias("neighbors"))
    found = list_nodes(nodes, node_iatas, observers, edges, scopes, ordered=False).join(merged, "node_id", "left")
    if {"multibyte_paths", "multibyte_traces"} <= set(nodes.columns):
        found = found.withColumn("min_firmware_version", X.min_firmware_version(F.col("multibyte_paths"), F.col("multibyte_traces")))
    return found
