"""Packets and observations: latest rows, delays, lists and details, and their folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from .filters import after_id, between, equals, heard_in, merge_by_key, page_by_id, page_desc
from .resolve import candidates_by_prefix, count_candidates, explode_hops

FIRST = ["payload_type", "payload_version", "route_type", "region_code", "sub_region_code", "scope_id", "origin_pubkey", "raw_payload", "raw_header", "parsed_payload", "channel_hash", "trace_tag"]


def packet_counts(obs: DataFrame) -> DataFrame:
    """All observations of a packet."""
    return obs.groupBy("packet_hash").agg(F.count(F.lit(1)).alias("observation_count"))


def latest_observation(obs: DataFrame) -> DataFrame:
    """J3 and A12 in one pass: count, and observer and place of the newest observation."""
    newest = F.max(F.struct("heard_at", "id", "observer_id", "iata")).alias("n")
    found = obs.groupBy("packet_hash").agg(newest, F.count(F.lit(1)).alias("observation_count"))
    return found.select("packet_hash", "observation_count", F.col("n.observer_id").alias("observer_id"), F.col("n.iata").alias("iata"))


def propagation_ms(obs: DataFrame) -> DataFrame:
    """Milliseconds since the packet was first heard."""
    first = F.min("heard_at").over(Window.partitionBy("packet_hash"))
    return obs.withColumn("propagation_ms", X.epoch_ms(F.col("heard_at")) - X.epoch_ms(first))


def packet_spread(obs: DataFrame) -> DataFrame:
    """Milliseconds from the first to the last observation."""
    return obs.groupBy("packet_hash").agg((X.epoch_ms(F.max("heard_at")) - X.epoch_ms(F.min("heard_at"))).alias("spread_ms"))


def observation_events(obs: DataFrame, *, order: str = "seq") -> DataFrame:
    """Whether an observation is the packet's first, and how many there were so far."""
    so_far = Window.partitionBy("packet_hash").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = obs.withColumn("observation_count", F.count(F.lit(1)).over(so_far))
    return counted.withColumn("is_first", F.col("observation_count") == 1)


def list_packets(
    packets: DataFrame, obs: DataFrame, observers: DataFrame, scopes: DataFrame, *, payload_type: int | None = None, route_type: int | None = None,
    iatas: Sequence[str] | None = None, scope: str | None = None, since=None, until=None, cursor=None, limit: int | None = None,
) -> DataFrame:
    """Packets newest first, with count and latest observer over all places; places choose packets only."""
    kept = between(equals(packets, payload_type=payload_type, route_type=route_type), "first_heard_at", since=since, until=until)
    kept = heard_in(kept, obs, "packet_hash", iatas).join(scopes.select("scope_id", F.col("name").alias("scope")), "scope_id", "left")
    kept = equals(kept, scope=scope)
    kept = kept if cursor is None else kept.filter(F.col("first_heard_at") < F.lit(cursor))
    # Without a limit nothing is cut, so only the result is sorted.
    page = kept if limit is None else page_desc(kept, "first_heard_at", limit=limit, ties=["packet_hash"])
    wanted = obs if limit is None else obs.join(page.select("packet_hash"), "packet_hash", "left_semi")
    found = page.join(latest_observation(wanted), "packet_hash", "left").join(observers.select("observer_id", F.col("display_name").alias("observer_name")), "observer_id", "left")
    return found.select(
        "packet_hash", "payload_type", X.payload_type_name(F.col("payload_type")).alias("payload_name"), "route_type", X.route_type_name(F.col("route_type")).alias("route_name"), "scope",
        X.epoch_ms(F.col("first_heard_at")).alias("first_ms"), X.epoch_ms(F.col("last_heard_at")).alias("last_ms"), F.coalesce("observation_count", F.lit(0)).alias("observation_count"),
        "observer_id", F.coalesce("iata", F.lit("")).alias("iata"), "observer_name",
    ).orderBy(F.desc("first_ms"), "packet_hash")


def packets_after(packets: DataFrame, obs: DataFrame, observers: DataFrame, scopes: DataFrame, *, after: int, iatas: Sequence[str] | None = None, limit: int | None = 100) -> DataFrame:
    """R2: one row per observation after an id, oldest first; the observer is that observation's."""
    rows = after_id(obs.filter(F.col("iata").isin(list(iatas))) if iatas else obs, after=after, limit=limit)
    counts = packet_counts(obs.join(rows.select("packet_hash").distinct(), "packet_hash", "left_semi"))
    named = rows.join(packets.select("packet_hash", "payload_type", "route_type", "scope_id"), "packet_hash").join(counts, "packet_hash")
    named = named.join(observers.select("observer_id", F.col("display_name").alias("observer_name")), "observer_id", "left").join(scopes.select("scope_id", F.col("name").alias("scope")), "scope_id", "left")
    return named.select("id", "packet_hash", "payload_type", "route_type", "scope", "observation_count", "observer_id", "observer_name", "iata", X.epoch_ms(F.col("heard_at")).alias("heard_ms")).orderBy("id")


def packet_detail(packets: DataFrame, obs: DataFrame, observers: DataFrame, scopes: DataFrame, messages: DataFrame, short_ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each packet with its spread, its JSON filled from a decrypted message, and its observations with resolved paths.

    An observation carries what ``obs`` has of the path's width, RSSI, radio and broker.  For a trace with ``trace_hashes``, ``route`` holds its
    resolved hops merged over places, else it is null.  A packet without observations has an empty array.

    Hops of paths and routes tell their confidence and number of ``candidates``.  Who these are stands once per packet in ``candidates``, an array of ``iata, hop, node_ids``:
    a short hop has a fixed share of a place's nodes as candidates, so lists at every hop would grow with the square of the input.
    """
    hops = count_candidates(explode_hops(obs), short_ids, nodes)
    paths = hops.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "hop", "confidence", "candidates"))).alias("path"))
    met = explode_hops(obs).select("packet_hash", "iata", "hop")
    rows = propagation_ms(obs).join(paths, "id", "left").join(observers.select("observer_id", F.col("display_name").alias("observer_name")), "observer_id", "left")
    optional = [c for c in ("path_length_byte", "hash_size", "rssi", "radio_freq_mhz", "bandwidth_khz", "spread_factor", "coding_rate", "source_broker") if c in obs.columns]
    each = F.struct("heard_at", "id", "observer_id", "observer_name", "iata", "propagation_ms", "hop_count", *optional, "snr", "path")
    heard = rows.groupBy("packet_hash").agg(F.sort_array(F.collect_list(each)).alias("observations"), F.max("propagation_ms").alias("spread_ms"))
    text = messages.select("packet_hash", "sender_name", "content", "sent_at").dropDuplicates(["packet_hash"])
    found = packets.join(scopes.select("scope_id", F.col("name").alias("scope")), "scope_id", "left").join(heard, "packet_hash", "left").join(text, "packet_hash", "left")
    if "parsed_payload" in packets.columns:
        found = found.withColumn("parsed_payload", X.enrich_group_text(F.col("parsed_payload"), F.col("sender_name"), F.col("content"), F.col("sent_at")))
    if {"trace_hashes", "trace_flags", "trace_tag"} <= set(packets.columns):
        from .traces import trace_detail

        hop = F.struct("pos", "hop", "confidence", "candidates", "iata", "snr")
        traced = trace_detail(packets, obs, short_ids, nodes).drop("node_ids")
        met = met.unionByName(traced.filter("candidates > 0").select("packet_hash", "iata", "hop"))
        route = traced.groupBy("packet_hash").agg(F.sort_array(F.collect_list(hop)).alias("route"))
        found = found.join(route, "packet_hash", "left")
    # Not computed where ``candidates`` is not asked for: a left join to one row per packet.
    who = met.distinct().join(candidates_by_prefix(short_ids, nodes), ["iata", "hop"]).groupBy("packet_hash").agg(F.sort_array(F.collect_list(F.struct("iata", "hop", "node_ids"))).alias("candidates"))
    found = found.join(who, "packet_hash", "left")
    empty = F.array().cast(heard.schema["observations"].dataType)
    nobody = F.array().cast(who.schema["candidates"].dataType)
    return found.withColumns({"observations": F.coalesce("observations", empty), "candidates": F.coalesce("candidates", nobody), "spread_ms": F.coalesce("spread_ms", F.lit(0))}).drop("sender_name", "content", "sent_at")


def node_observations(obs: DataFrame, packets: DataFrame, observers: DataFrame, *, cursor: int | None = None, limit: int | None = None, public_key: str | None = None) -> DataFrame:
    """Observations of nodes' own packets, newest id first."""
    own = packets.filter("origin_pubkey IS NOT NULL").select("packet_hash", "origin_pubkey", "payload_type")
    rows = obs.join(equals(own, origin_pubkey=public_key), "packet_hash").join(observers.select("observer_id", F.col("display_name").alias("observer_name")), "observer_id", "left")
    return page_by_id(rows.select("id", "packet_hash", "origin_pubkey", "payload_type", "observer_id", "observer_name", "iata", "heard_at"), cursor=cursor, limit=limit)


def fold_packets(decoded: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """Per hash the columns of the first arrival, and the first and last arrival time; ``inserted`` marks new hashes."""
    first = [c for c in FIRST if c in decoded.columns]
    new = decoded.groupBy("packet_hash").agg(F.min_by(F.struct(*first), "seq").alias("f"), F.min("arrival_ts").alias("first_heard_at"), F.max("arrival_ts").alias("last_heard_at"))
    new = new.select("packet_hash", "f.*", "first_heard_at", "last_heard_at")
    if existing is None:
        return new.withColumn("inserted", F.lit(True))
    rules = dict.fromkeys(first, "first") | {"first_heard_at": "min", "last_heard_at": "max"}
    known = existing.select("packet_hash", F.lit(False).alias("inserted"))
    return merge_by_key(existing, new, ["packet_hash"], rules).join(known, "packet_hash", "left").withColumn("inserted", F.coalesce("inserted", F.lit(True)))


def dedup_observations(rows: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """The first arrival of each (packet, observer, time), so the first broker stays; without keys that exist already."""
    key = ["packet_hash", "observer_id", "heard_at"]
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("f")).select(*key, "f.*").select(*rows.columns)
    return first if existing is None else first.join(existing.select(*key), key, "left_anti")
