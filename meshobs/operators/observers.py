"""Observers: last places, status, telemetry, folds of status messages, and their lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from .filters import between, equals, merge_by_key, name_like, page_by_id, page_desc, with_status

TELEMETRY_HOURS = {"1h": 1, "6h": 6, "24h": 24}


def observer_last_iata(obs: DataFrame) -> DataFrame:
    """The place of each observer's newest observation; combined before the shuffle, so busy observers do not skew."""
    return obs.groupBy("observer_id").agg(F.max_by("iata", F.struct("heard_at", "id")).alias("iata"))


def attach_radio(obs: DataFrame, status: DataFrame, *, stored: DataFrame | None = None) -> DataFrame:
    """Each observation with its observer's last radio values (``freq, bw, sf, cr``) in arrival order; before the first of ``status`` those
    of ``stored`` (one row per observer, from earlier batches), and 0 if there are none.

    Both are cut into days by ``arrival_ts``.  Within a day a window carries values on; what stands at the start of a day comes from a
    table of one row per observer and day, so no task has to sort all rows of a busy observer.
    """
    radio = F.struct("freq", "bw", "sf", "cr")
    fields = [f.name for f in obs.schema.fields]
    left = obs.select("observer_id", "seq", F.to_date("arrival_ts").alias("_day"), F.struct(*fields).alias("_row"), F.lit(None).alias("_radio"))
    right = status.select("observer_id", "seq", F.to_date("arrival_ts").alias("_day"), F.lit(None).alias("_row"), radio.alias("_radio"))
    both = left.unionByName(right)
    daily = right.groupBy("observer_id", "_day").agg(F.max_by("_radio", "seq").alias("_last"))
    days = both.select("observer_id", "_day").distinct().join(daily, ["observer_id", "_day"], "left")
    before = Window.partitionBy("observer_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("observer_id", "_day", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    so_far = Window.partitionBy("observer_id", "_day").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_now", F.last("_radio", ignorenulls=True).over(so_far)).filter("_row IS NOT NULL")
    found = filled.join(days, ["observer_id", "_day"]).withColumn("_use", F.coalesce("_now", "_carried"))
    if stored is not None:
        found = found.join(stored.select("observer_id", radio.alias("_stored")), "observer_id", "left").withColumn("_use", F.coalesce("_use", "_stored"))
    return found.select("_row.*", *(F.coalesce(F.col(f"_use.{c}"), F.lit(0).cast(status.schema[c].dataType)).alias(n) for c, n in (("freq", "radio_freq_mhz"), ("bw", "bandwidth_khz"), ("sf", "spread_factor"), ("cr", "coding_rate"))))


def telemetry_buckets(telemetry: DataFrame, *, hours: int, since=None, until=None) -> DataFrame:
    """Per observer and bucket of ``hours`` of the day; counters as what they grew by, not below 0."""
    ts = F.col("reported_at")
    bucket = F.date_trunc("day", ts) + F.make_dt_interval(hours=(F.floor(F.hour(ts) / hours) * hours).cast("int"))

    def grown(c: str) -> Column:
        return F.greatest(F.max(c) - F.min(c), F.lit(0))

    return between(telemetry, "reported_at", since=since, until=until).groupBy("observer_id", bucket.alias("bucket")).agg(
        F.round(F.avg("battery_mv")).cast("int").alias("battery_mv"), F.avg("noise_floor").alias("noise_floor"), F.round(F.avg("queue_len")).cast("int").alias("queue_len"),
        grown("airtime_tx").alias("airtime_tx"), grown("airtime_rx").alias("airtime_rx"), grown("recv_errors").alias("recv_errors"), F.max("uptime_s").alias("uptime_s"),
    )


def observer_telemetry(telemetry: DataFrame, *, interval: str = "1h", since=None, until=None, after_id: int | None = None) -> DataFrame:
    """Raw rows for ``1h``, else buckets of ``6h`` or ``24h``, oldest first."""
    if interval not in TELEMETRY_HOURS:
        raise ValueError(f"interval must be one of {', '.join(TELEMETRY_HOURS)}")
    if interval != "1h":
        return telemetry_buckets(telemetry, hours=TELEMETRY_HOURS[interval], since=since, until=until).orderBy("observer_id", "bucket")
    rows = between(telemetry, "reported_at", since=since, until=until)
    return (rows if after_id is None else rows.filter(F.col("id") > after_id)).orderBy("observer_id", "reported_at", "id")


def observer_scope_names(observer_scopes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Sorted distinct scope names per observer."""
    named = observer_scopes.join(scopes.select("scope_id", F.col("name").alias("scope")), "scope_id").filter("scope IS NOT NULL")
    return named.groupBy("observer_id").agg(F.sort_array(F.collect_set("scope")).alias("scopes"))


def fold_observers(messages: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """One row per key from packets and statuses (``observer_pubkey, arrival_ts``); the first message counts 0."""
    new = messages.groupBy(F.col("observer_pubkey").alias("public_key")).agg(
        F.min("arrival_ts").alias("first_seen"), F.max("arrival_ts").alias("last_seen"), F.count(F.lit(1)).alias("messages")
    )
    both = merge_by_key(None if existing is None else existing.withColumn("messages", F.col("observation_count") + 1), new, ["public_key"], {"first_seen": "min", "last_seen": "max", "messages": "sum"})
    return both.select("public_key", F.lit("unknown").alias("observer_type"), "first_seen", "last_seen", (F.col("messages") - 1).alias("observation_count"))


def fold_observer_status(status: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """The last status per observer (``pubkey``); name and type keep the old value if empty, battery if unknown, the rest is overwritten."""
    radio = X.parse_radio(F.col("radio"))
    rows = status.select(
        F.col("pubkey").alias("public_key"), "seq", "arrival_ts", F.nullif("origin", F.lit("")).alias("display_name"),
        F.nullif(X.infer_observer_type(F.col("source"), F.col("client_version")), F.lit("")).alias("observer_type"),
        F.coalesce("client_version", F.lit("")).alias("software_version"), F.coalesce("model", F.lit("")).alias("hardware_model"), F.coalesce("firmware_version", F.lit("")).alias("firmware_version"),
        radio["freq"].alias("radio_freq_mhz"), radio["bw"].alias("radio_bw_khz"), radio["sf"].alias("radio_sf"), radio["cr"].alias("radio_cr"),
        X.battery_volts(F.col("stats.battery_mv")).alias("battery_level"), F.col("stats.uptime_secs").alias("uptime_seconds"),
    )
    kept = ["display_name", "observer_type", "battery_level"]
    taken = ["software_version", "hardware_model", "firmware_version", "radio_freq_mhz", "radio_bw_khz", "radio_sf", "radio_cr", "uptime_seconds"]
    new = rows.groupBy("public_key").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in kept), *(F.max_by(c, "seq").alias(c) for c in taken), F.max_by("arrival_ts", "seq").alias("last_status_at")
    )
    rules = dict.fromkeys(kept, "last_known") | dict.fromkeys([*taken, "last_status_at"], "last")
    return merge_by_key(existing, new, ["public_key"], rules)


def fold_observer_brokers(messages: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """Per observer and broker the first and last message; both kinds of message count as packets."""
    new = messages.groupBy("observer_pubkey", F.col("broker").alias("broker_name")).agg(
        F.min("arrival_ts").alias("first_seen"), F.max("arrival_ts").alias("last_seen"), F.max("arrival_ts").alias("last_packet_at")
    )
    return merge_by_key(existing, new, ["observer_pubkey", "broker_name"], {"first_seen": "min", "last_seen": "max", "last_packet_at": "max"})


def fold_observer_scopes(inserted: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """Observers and the scopes of packets they heard (``observer_id, scope_id, heard_at``)."""
    new = inserted.filter("scope_id IS NOT NULL").groupBy("observer_id", "scope_id").agg(F.min("heard_at").alias("first_seen"), F.max("heard_at").alias("last_seen"))
    return merge_by_key(existing, new, ["observer_id", "scope_id"], {"first_seen": "min", "last_seen": "max"})


def telemetry_snapshots(status: DataFrame, *, resolution_s: int = 3600, existing: DataFrame | None = None) -> DataFrame:
    """T4 in batch: the first status of each observer and window; windows that ``existing`` has are not taken again."""
    at = X.truncate_ts(F.col("arrival_ts"), resolution_s)
    new = status.groupBy("pubkey", at.alias("reported_at")).agg(F.min_by("stats", "seq").alias("stats"))
    return new if existing is None else new.join(existing.select("pubkey", "reported_at"), ["pubkey", "reported_at"], "left_anti")


def _details(observers: DataFrame, observer_scopes: DataFrame, scopes: DataFrame, obs: DataFrame, as_of) -> DataFrame:
    found = observers.join(observer_last_iata(obs), "observer_id", "left").join(observer_scope_names(observer_scopes, scopes), "observer_id", "left")
    return found.withColumns(
        {"status": X.online_status(F.col("last_status_at"), F.lit(as_of)), "iata": F.coalesce("iata", F.lit("")), "scopes": F.coalesce("scopes", F.array().cast("array<string>"))}
    )


def list_observers(
    observers: DataFrame, brokers: DataFrame | None, observer_scopes: DataFrame, scopes: DataFrame, obs: DataFrame, *, as_of, iatas: Sequence[str] | None = None,
    observer_type: str | None = None, broker: str | None = None, status: str | None = None, name: str | None = None, scope: str | None = None, cursor=None, limit: int | None = None,
) -> DataFrame:
    """Observers by last sign of life, with status, last place and scopes."""
    kept = with_status(name_like(equals(observers, observer_type=observer_type), "display_name", name), status, as_of=as_of)
    if broker is not None and brokers is not None:
        kept = kept.join(brokers.filter(F.col("broker_name") == broker).select("observer_id"), "observer_id", "left_semi")
    if scope is not None:
        wanted = observer_scopes.join(F.broadcast(scopes.filter(F.col("name") == scope).select("scope_id")), "scope_id", "left_semi")
        kept = kept.join(wanted.select("observer_id"), "observer_id", "left_semi")
    found = _details(kept, observer_scopes, scopes, obs, as_of)
    found = found.filter(F.col("iata").isin(list(iatas))) if iatas else found
    return page_desc(found, "last_seen", cursor=cursor, limit=limit, ties=["observer_id"])


def observer_profile(observers: DataFrame, brokers: DataFrame, observer_scopes: DataFrame, scopes: DataFrame, obs: DataFrame, *, as_of) -> DataFrame:
    """All of an observer, its brokers newest first."""
    newest = F.struct(F.col("last_seen").alias("seen"), "broker_name")
    names = F.transform(F.sort_array(F.collect_list(newest), asc=False), lambda x: x["broker_name"])
    return _details(observers, observer_scopes, scopes, obs, as_of).join(brokers.groupBy("observer_id").agg(names.alias("brokers")), "observer_id", "left")


def observer_adverts(obs: DataFrame, packets: DataFrame, nodes: DataFrame, *, cursor: int | None = None, limit: int | None = None) -> DataFrame:
    """Adverts that observers heard, with the node's name."""
    adverts = packets.filter(F.col("payload_type") == X.PAYLOAD_ADVERT).select("packet_hash", "origin_pubkey")
    heard = obs.join(adverts, "packet_hash").join(nodes.select(F.col("public_key").alias("origin_pubkey"), F.col("name").alias("node_name")), "origin_pubkey", "left")
    return page_by_id(heard.select("id", "observer_id", "packet_hash", "iata", "heard_at", "origin_pubkey", "node_name"), cursor=cursor, limit=limit, desc=False)

