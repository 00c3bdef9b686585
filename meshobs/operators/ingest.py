"""The whole batch from messages and decoded packets to tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions import expr as X
from ..sources.messages import parse_packet_envelope, parse_status_envelope, parse_topic
from .channels import channel_candidates, fold_channel_messages, fold_channels, mark_decrypted
from .events import fold_observer_newest, message_event_rows, node_event_rows, observation_event_rows, running_counts, status_event_rows, with_observer_context, with_observer_name
from .filters import filter_allowed
from .neighbors import fold_neighbors
from .nodes import fold_default_scope, fold_node_iatas, fold_nodes, fold_short_ids
from .observers import attach_radio, fold_observer_brokers, fold_observer_scopes, fold_observer_status, fold_observers, telemetry_snapshots
from .packets import dedup_observations, fold_packets
from .resolve import node_capabilities, relay_prefixes, unique_intervals
from .routes import build_known_routes
from .scopes import match_scope


@dataclass
class State:
    """Tables so far by name; absent ones are empty."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def get(self, name: str) -> DataFrame | None:
        return self.tables.get(name)


def split_messages(messages: DataFrame, airports: DataFrame | None = None, *, countries=(), continents=()) -> dict[str, DataFrame]:
    """Accepted packets and statuses, and the rejects of both."""
    routed = parse_topic(messages)
    if airports is not None:
        routed = filter_allowed(routed, airports, countries=countries, continents=continents)
    packets, bad_packets = parse_packet_envelope(routed)
    status, bad_status = parse_status_envelope(routed)
    return {"packets": packets, "status": status, "rejects": bad_packets.unionByName(bad_status)}


def decoded_columns(decoded: DataFrame) -> DataFrame:
    """Columns that follow from a decoded packet: times, numbers, codes, header and JSON."""
    codes = X.region_codes(F.col("transport_code_1"), F.col("transport_code_2"))
    read = {name: F.col(name) for name in X.DECODED if name in decoded.columns}
    for name in read:  # a decoder may know fewer fields of a kind; the others are null
        have = decoded.schema[name].dataType.names
        fields = [(F.col(name)[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in DataType.fromDDL(X.DECODED[name]).fields]
        read[name] = F.when(F.col(name).isNotNull(), F.struct(*fields))
    if "group" not in read and "channel_hash" in decoded.columns:
        read["group"] = F.when(F.col("channel_hash").isNotNull(), F.struct(F.col("channel_hash"), *(F.lit(None).cast("string").alias(f) for f in ("mac", "ciphertext"))))
    return decoded.withColumns(
        {
            "heard_at": X.heard_at(F.col("timestamp_text"), F.col("arrival_ts")), "rssi": X.parse_number(F.col("rssi_text")).cast("int"), "snr": X.parse_number(F.col("snr_text")).cast("float"),
            "region_code": codes[0], "sub_region_code": codes[1], "raw_header": X.raw_header(F.col("header"), F.col("transport_code_1"), F.col("transport_code_2")),
            "parsed_payload": X.payload_json(F.col("payload_type"), F.col("raw_payload"), read),
            "trace_tag": F.when(F.col("payload_type") == X.PAYLOAD_TRACE, X.u32_le(F.col("trace.tag"))), "origin_pubkey": F.when(F.col("payload_type") == X.PAYLOAD_ADVERT, F.col("advert.pubkey")),
        }
    )


#: How the tables of ``ingest_batch`` grow: rows that only come anew, by key.
APPENDED = {"observations": ["packet_hash", "observer_id", "heard_at"], "telemetry": ["pubkey", "reported_at"], "events": ["type", "payload", "iata"]}
#: Large tables of which a batch touches few rows, by key.  A batch's rows merge into those before by ``merge_rules``.
UPSERTED = {"packets": ["packet_hash"], "channel_messages": ["packet_hash"], "packet_counts": ["packet_hash"]}


def merge_rules(columns: list[str]) -> dict[str, str]:
    """How rows of a later batch merge into those of ``UPSERTED`` tables: the first row counts, but for these columns."""
    special = {"first_heard_at": "min", "last_heard_at": "max", "decrypted": "or", "n": "sum"}
    return {c: special.get(c, "first") for c in columns}


def ingest_batch(
    decoded: DataFrame, status: DataFrame, scopes: DataFrame, keys: DataFrame, state: State | None = None, *, save: Callable[[DataFrame, str], DataFrame] | None = None,
    as_of_arrival: bool = True, touched_only: bool = False,
) -> dict[str, DataFrame]:
    """All tables after a batch of decoded packets (``packets_decoded``) and statuses (``status_decoded``).

    Known routes and capabilities follow from every arrival; all else from observations that are new.  Nodes and observers are named by
    their public key.  Batches must come in order of arrival.  Then several batches give what one batch of all their messages gives: radio values, first telemetry, running
    counts and known packets go on from ``state``, and with ``as_of_arrival`` hops resolve to nodes known when they came.  ``events`` are this batch's alone.

    Rows that a stream's state has marked (``new_observation``, ``observation_count`` and ``new_message`` of packets, ``new_window`` of statuses) say themselves what is new; then
    packets, observations, messages, counts and telemetry need no history.

    ``save`` writes a table and reads it back; given that, decoded rows, new observations and the times at which prefixes are unique are computed once and not for
    each table.  With ``touched_only`` the tables of ``APPENDED`` and ``UPSERTED`` hold only rows that are new or changed, so a batch costs by its own size.
    """
    state, save = state or State(), save or (lambda df, name: df)
    marked = "new_observation" in decoded.columns
    marks = ["new_observation", "observation_count"] if marked else []
    rows = decoded_columns(decoded).withColumn("observer_id", F.col("observer_pubkey"))
    first = rows.groupBy("packet_hash").agg(F.min_by(F.struct("route_type", "payload_type", "raw_payload", "transport_code_1"), "seq").alias("p")).select("packet_hash", "p.*")
    matched = match_scope(first, scopes).select("packet_hash", "scope_id")
    rows = save(rows.join(matched, "packet_hash", "left"), "rows")
    known_packets, known_obs, stored_messages = (None if marked else state.get(n) for n in ("packets", "observations", "channel_messages"))
    hashes = rows.select("packet_hash").distinct()
    if touched_only:
        known_packets, stored_messages = (None if t is None else t.join(hashes, "packet_hash", "left_semi") for t in (known_packets, stored_messages))
    packets = fold_packets(rows, existing=known_packets).drop("inserted")
    stored = state.get("observer_status")
    radios = None if stored is None else stored.select(
        F.col("public_key").alias("observer_id"), F.col("radio_freq_mhz").alias("freq"), F.col("radio_bw_khz").alias("bw"), F.col("radio_sf").alias("sf"), F.col("radio_cr").alias("cr")
    )
    arrivals = rows.select(
        "seq", "arrival_ts", "broker", "iata", "observer_id", "packet_hash", "payload_type", "route_type", "scope_id", "channel_hash", "heard_at", "hash_size", "hop_count", "path_bytes", "rssi", "snr", "advert", F.col("seq").alias("id"), *marks
    )
    # Routes and capabilities need no radio values, so only new observations get them.
    fresh = save(arrivals.filter("new_observation").drop("new_observation") if marked else dedup_observations(arrivals, existing=known_obs), "fresh")
    radio = status.select(F.col("pubkey").alias("observer_id"), "seq", "arrival_ts", X.parse_radio(F.col("radio")).alias("r")).select("observer_id", "seq", "arrival_ts", "r.*")
    inserted = save(attach_radio(fresh, radio, stored=radios), "inserted")
    adverts = inserted.filter((F.col("payload_type") == X.PAYLOAD_ADVERT) & F.col("advert").isNotNull())
    named = adverts.withColumns({"public_key": F.col("advert.pubkey"), "node_id": F.col("advert.pubkey"), "node_type": F.col("advert.type")})
    nodes = save(fold_nodes(adverts, existing=state.get("nodes")).withColumn("node_id", F.col("public_key")), "nodes")
    short_ids = save(fold_short_ids(named, existing=state.get("node_short_ids")), "node_short_ids")
    places = save(fold_node_iatas(named, existing=state.get("node_iatas")), "node_iatas")
    prefixes = save(relay_prefixes(short_ids, nodes, node_iatas=places if as_of_arrival else None), "prefixes")
    intervals = save(unique_intervals(prefixes), "intervals")
    both = rows.select("observer_pubkey", "arrival_ts", "broker").unionByName(status.select(F.col("pubkey").alias("observer_pubkey"), "arrival_ts", "broker"))
    observers = save(fold_observers(both, existing=state.get("observers")), "observers")
    texts = rows.filter(F.col("payload_type") == X.PAYLOAD_GROUP_TEXT).select("packet_hash", "channel_hash", "arrival_ts", "seq", "message", *(["opened_by"] if "opened_by" in rows.columns else []))
    if "opened_by" in texts.columns:
        opened = channel_candidates(texts.filter("message.ok").groupBy("packet_hash", "channel_hash").agg(F.min_by("opened_by", "seq").alias("opened_by")), keys)
    else:  # a decoder that does not say which key opened a message leaves channels without keys
        opened = texts.limit(0).select("packet_hash", "channel_hash", F.lit("").alias("key_fingerprint"), F.lit("").alias("name"))
    messages = fold_channel_messages(
        texts.filter("message.ok").select("packet_hash", "channel_hash", F.col("message.sender").alias("sender_name"), F.col("message.text").alias("content"), F.timestamp_seconds("message.ts").alias("sent_at"), "seq"),
        existing=stored_messages,
    )
    messages = save(messages, "channel_messages")
    before = None if marked else state.get("packet_counts")
    if before is not None:
        before = before.join(hashes, "packet_hash", "left_semi") if touched_only else before
    if marked:
        running, counts = inserted.withColumn("is_first", F.col("observation_count") == 1), inserted.groupBy("packet_hash").agg(F.count(F.lit(1)).alias("n"))
        inserted = inserted.drop("observation_count")
    else:
        running, counts = running_counts(inserted, before)
    running = with_observer_name(running, status, stored=stored)
    told = with_observer_context(status, inserted, scopes, newest=state.get("observer_newest"), observer_scopes=state.get("observer_scopes"))
    telemetry = telemetry_snapshots(status.filter("new_window")) if "new_window" in status.columns else telemetry_snapshots(status, existing=state.get("telemetry"))
    spoken = messages.join(rows.filter("new_message").select("packet_hash").distinct() if marked else hashes, "packet_hash", "left_semi")
    if stored_messages is not None:
        spoken = spoken.join(stored_messages.select("packet_hash"), "packet_hash", "left_anti")
    spoken = spoken.join(inserted.groupBy("packet_hash").agg(F.min_by("iata", "seq").alias("iata")), "packet_hash")
    spoken = spoken.join(opened.select("packet_hash", "channel_hash", "key_fingerprint"), ["packet_hash", "channel_hash"], "left")
    events = observation_event_rows(running, scopes).unionByName(node_event_rows(adverts, scopes, observers))
    events = events.unionByName(message_event_rows(spoken)).unionByName(status_event_rows(told))
    old = lambda name, new: new if touched_only or state.get(name) is None else state.get(name).select(*new.columns).unionByName(new)
    return {
        "packets": mark_decrypted(packets, messages), "observations": old("observations", inserted), "packet_counts": counts, "nodes": nodes, "node_short_ids": short_ids, "node_iatas": places,
        "default_scopes": fold_default_scope(named, existing=state.get("default_scopes")), "node_neighbors": fold_neighbors(named, intervals, existing=state.get("node_neighbors")),
        "known_routes": build_known_routes(arrivals, intervals, existing=state.get("known_routes")), "capabilities": node_capabilities(arrivals, prefixes, existing=state.get("capabilities")),
        "observers": observers, "observer_newest": fold_observer_newest(inserted, existing=state.get("observer_newest")), "observer_status": fold_observer_status(status, existing=stored),
        "observer_brokers": fold_observer_brokers(both, existing=state.get("observer_brokers")), "observer_scopes": fold_observer_scopes(inserted, existing=state.get("observer_scopes")),
        "telemetry": old("telemetry", telemetry), "channels": fold_channels(texts.select("packet_hash", "channel_hash", "arrival_ts").distinct(), opened, existing=state.get("channels")), "channel_messages": messages,
        "events": events,
    }
