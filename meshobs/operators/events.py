"""Events for subscribers: counts that run over batches, what observers were called and where, and the rows of the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from .asof import carried
from .filters import merge_by_key

# The event types, and the names of the fields in their payloads below.
OBSERVATION, NODE, MESSAGE, STATUS = "packetObservation", "nodeUpdate", "channelMessage", "observerStatus"


def running_counts(batch: DataFrame, counts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """A micro-batch's observations with first flag and running count, given the packets' counts so far; and the new counts."""
    so_far = Window.partitionBy("packet_hash").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = batch.withColumn("in_batch", F.count(F.lit(1)).over(so_far))
    new = batch.groupBy("packet_hash").agg(F.count(F.lit(1)).alias("n"))
    if counts is None:
        counts = new.limit(0)
    events = rows.join(counts, "packet_hash", "left").withColumn("observation_count", F.col("in_batch") + F.coalesce("n", F.lit(0))).drop("in_batch", "n")
    return events.withColumn("is_first", F.col("observation_count") == 1), merge_by_key(counts, new, ["packet_hash"], {"n": "sum"})


def with_observer_name(rows: DataFrame, status: DataFrame, *, stored: DataFrame | None = None) -> DataFrame:
    """``observer_name``, what the observer's last status with a name called it when the row came, ``''`` before any.

    ``rows`` has ``observer_id``, ``status`` ``pubkey`` and ``origin``; ``stored`` the names of earlier batches (``public_key, display_name``).
    """
    named = status.select(F.col("pubkey").alias("observer_id"), "seq", "arrival_ts", F.nullif("origin", F.lit("")).alias("observer_name"))
    found = carried(rows, named, ["observer_id"], "observer_name")
    if stored is not None:
        found = found.join(stored.select(F.col("public_key").alias("observer_id"), F.col("display_name").alias("_stored")), "observer_id", "left")
        found = found.withColumn("observer_name", F.coalesce("observer_name", "_stored")).drop("_stored")
    return found.withColumn("observer_name", F.coalesce("observer_name", F.lit("")))


def fold_observer_newest(inserted: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """J4 for batches: ``observer_id, newest``, the time, arrival number and place of each observer's newest observation."""
    new = inserted.groupBy("observer_id").agg(F.max(F.struct("heard_at", "seq", "iata")).alias("newest"))
    return merge_by_key(existing, new, ["observer_id"], {"newest": "max"})


def with_observer_context(status: DataFrame, inserted: DataFrame, scopes: DataFrame, *, newest: DataFrame | None = None, observer_scopes: DataFrame | None = None) -> DataFrame:
    """Statuses with ``last_iata``, the place of the observer's newest observation by then (null before any), and ``scopes``, the sorted names that it had.

    ``inserted`` are the batch's new observations; ``newest`` and ``observer_scopes`` what earlier batches left.
    """
    places = inserted.select(F.col("observer_id").alias("pubkey"), "seq", "arrival_ts", F.struct("heard_at", "seq", "iata").alias("newest"))
    found = carried(status, places, ["pubkey"], "newest", largest=True)
    if newest is not None:
        found = found.join(newest.select(F.col("observer_id").alias("pubkey"), F.col("newest").alias("_stored")), "pubkey", "left")
        found = found.withColumn("newest", F.greatest("newest", "_stored")).drop("_stored")
    # A row per observer and scope: the configured scopes are few.
    since = inserted.filter("scope_id IS NOT NULL").groupBy("observer_id", "scope_id").agg(F.min("seq").alias("since"))
    if observer_scopes is not None:
        since = since.unionByName(observer_scopes.select("observer_id", "scope_id", F.lit(None).cast("long").alias("since")))
    heard = since.join(F.broadcast(scopes.select("scope_id", "name")), "scope_id").groupBy(F.col("observer_id").alias("pubkey")).agg(F.collect_set(F.struct("name", "since")).alias("heard"))
    by_then = F.filter("heard", lambda s: s["since"].isNull() | (s["since"] <= F.col("seq")))
    names = F.array_sort(F.array_distinct(F.transform(by_then, lambda s: s["name"])))
    joined = found.join(heard, "pubkey", "left")
    return joined.withColumns({"last_iata": F.col("newest.iata"), "scopes": F.coalesce(names, F.array().cast("array<string>"))}).drop("newest", "heard")


def _event(df: DataFrame, kind: str, payload: dict[str, Column], iata: str, payload_type: Column, channel_hash: Column) -> DataFrame:
    """A row of the event table.  Null fields are left out of the payload; the columns beside it are what subscriptions are matched by."""
    body = F.to_json(F.struct(*(c.alias(n) for n, c in payload.items())))
    return df.select(F.lit(kind).alias("type"), body.alias("payload"), F.coalesce(F.col(iata), F.lit("")).alias("iata"), payload_type.cast("int").alias("payload_type"), channel_hash.alias("channel_hash"))


def _named(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _shown_radio(freq: str, bw: str, sf: str) -> Column:
    return F.when(F.coalesce(freq, F.lit(0)) != 0, X.radio_text(F.col(freq), F.coalesce(bw, F.lit(0)), F.coalesce(sf, F.lit(0))))


def observation_event_rows(events: DataFrame, scopes: DataFrame) -> DataFrame:
    """Inserted observations with first flag, running count and ``observer_name``; matched by place and payload type."""
    named = events.join(F.broadcast(scopes.select("scope_id", F.col("name").alias("scope"))), "scope_id", "left")
    # The path's length byte has the hash size less one in its upper two bits.
    length = F.col("path_length_byte") if "path_length_byte" in events.columns else (F.col("hash_size") - 1) * 64 + F.col("hop_count")
    packet = _named(
        payloadType=F.col("payload_type"), payloadTypeName=X.payload_type_name(F.col("payload_type")), routeType=F.col("route_type"), routeTypeName=X.route_type_name(F.col("route_type")),
        isFirstObservation=F.col("is_first"), observationCount=F.col("observation_count"), scope=F.col("scope"),
    )
    observation = _named(
        observerId=F.col("observer_id"), observerName=F.col("observer_name"), iata=F.col("iata"), heardAt=X.epoch_ms(F.col("heard_at")), rssi=F.col("rssi"), snr=F.col("snr"), sourceBroker=F.col("broker"),
        pathBytes=F.coalesce("path_bytes", F.lit("")), pathLength=_named(raw=F.lower(F.lpad(F.hex(length.cast("long")), 2, "0")), hashSize=F.col("hash_size"), hopCount=F.col("hop_count")), propagationTimeMs=F.lit(0),
    )
    return _event(named, OBSERVATION, {"packetHash": F.col("packet_hash"), "packet": packet, "observation": observation}, "iata", F.col("payload_type"), F.lit(""))


def node_event_rows(adverts: DataFrame, scopes: DataFrame, observers: DataFrame) -> DataFrame:
    """Inserted adverts.  A node is an observer if one with its key had been heard of by then (``public_key, first_seen``); matched as adverts."""
    known = observers.select(F.col("public_key").alias("_key"), F.col("first_seen").alias("_since"))
    rows = adverts.withColumn("_key", F.col("advert.pubkey")).join(known, "_key", "left").join(F.broadcast(scopes.select("scope_id", F.col("name").alias("scope"))), "scope_id", "left")
    a = F.col("advert")
    located = (F.coalesce(a["lat"], F.lit(0)) != 0) | (F.coalesce(a["lon"], F.lit(0)) != 0)
    payload = {
        "nodeId": a["pubkey"], "publicKey": a["pubkey"], "name": F.coalesce(a["name"], F.lit("")), "nodeType": a["type"], "nodeTypeName": X.node_type_name(a["type"]), "iata": F.col("iata"),
        "lat": F.when(located, F.coalesce(a["lat"], F.lit(0)) / 1e6), "lng": F.when(located, F.coalesce(a["lon"], F.lit(0)) / 1e6),
        "isObserver": F.coalesce(F.col("_since") <= F.col("arrival_ts"), F.lit(False)), "iatas": F.array(_named(iata=F.col("iata"), lastHeard=X.epoch_ms(F.col("arrival_ts")))),
        "defaultScope": F.col("scope"), "radio": _shown_radio("radio_freq_mhz", "bandwidth_khz", "spread_factor"),
    }
    return _event(rows, NODE, payload, "iata", F.lit(X.PAYLOAD_ADVERT), F.lit(""))


def message_event_rows(messages: DataFrame) -> DataFrame:
    """New messages with the place that they were first heard in and the fingerprint of the key that opened them; matched by channel hash, not by payload type."""
    payload = {
        "channelId": X.channel_id(F.col("channel_hash"), F.col("key_fingerprint")), "channelHash": F.col("channel_hash"), "packetHash": F.col("packet_hash"),
        "senderName": F.coalesce("sender_name", F.lit("")), "content": F.coalesce("content", F.lit("")), "sentAt": X.epoch_ms(F.col("sent_at")),
    }
    return _event(messages, MESSAGE, payload, "iata", F.lit(0), F.col("channel_hash"))


def status_event_rows(status: DataFrame) -> DataFrame:
    """Statuses with ``last_iata`` and ``scopes`` of ``with_observer_context``; matched by that place, not by payload type."""
    rows = status.withColumn("_radio", X.parse_radio(F.col("radio"))).withColumns({f"_{n}": F.col(f"_radio.{n}") for n in ("freq", "bw", "sf")})
    payload = {
        "observerId": F.col("pubkey"), "displayName": F.coalesce("origin", F.lit("")), "observerType": F.nullif("source", F.lit("")), "iata": F.nullif("last_iata", F.lit("")), "online": F.lit(True),
        "radio": _shown_radio("_freq", "_bw", "_sf"), "scopes": F.col("scopes"), "batteryMv": F.when(F.col("stats.battery_mv") != 0, F.col("stats.battery_mv")),
        "uptimeSeconds": F.coalesce("stats.uptime_secs", F.lit(0)), "lastStatusAt": X.epoch_ms(F.col("arrival_ts")),
    }
    return _event(rows, STATUS, payload, "last_iata", F.lit(0), F.lit(""))
