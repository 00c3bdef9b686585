"""Structured Streaming: deduplication, hourly counts, snapshots, folds and event delivery."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import expr as X
from ..operators import sketches
from ..operators.ingest import UPSERTED, State, ingest_batch, merge_rules, split_messages
from ..operators.observers import telemetry_snapshots
from ..sources.messages import to_event_json
from . import arrivals
from .store import Store

#: Tables of ``ingest_batch`` that a micro-batch writes whole: they hold a row per device, place or route and not per message.
WHOLE = ["nodes", "node_short_ids", "node_iatas", "default_scopes", "node_neighbors", "known_routes", "capabilities", "observers", "observer_newest", "observer_status", "observer_brokers", "observer_scopes", "channels"]
#: Tables of ``ingest_batch`` that are kept by day, and the time that says which.
BY_DAY = {"observations": "heard_at", "telemetry": "reported_at"}
#: Clients that may subscribe to everything; their ids are broadcast.
MAX_OPEN = 100_000

KEY = ["packet_hash", "observer_id", "heard_at"]


def clamp_times(stream: DataFrame) -> DataFrame:
    """``heard_at`` within half an hour of arrival, so disorder is an hour at most."""
    return stream.withColumn("heard_at", X.heard_at(F.col("timestamp_text"), F.col("arrival_ts")))


def dedup_stream(stream: DataFrame, *, watermark: str = "1 hour") -> DataFrame:
    """One row per packet, observer and time, whichever broker came first."""
    return stream.withWatermark("heard_at", watermark).dropDuplicatesWithinWatermark(KEY)


def hourly_stream(stream: DataFrame, *, watermark: str = "1 hour") -> DataFrame:
    """Observations and approximate distinct packets and observers per place and hour; the batch job has exact ones."""
    rows = stream.withWatermark("heard_at", watermark)
    counted = rows.groupBy(F.window("heard_at", "1 hour").alias("w"), "iata").agg(
        F.count(F.lit(1)).alias("observations"), F.approx_count_distinct("packet_hash").alias("packets"), F.approx_count_distinct("observer_id").alias("observers")
    )
    return counted.select("iata", F.col("w.start").alias("hour"), "observations", "packets", "observers")


def hourly_sketch_stream(stream: DataFrame, path: str, checkpoint: str, *, compact_every: int = 16) -> StreamingQuery:
    """Hours with sketches of distinct packets and observers, folded over micro-batches and kept under ``path``; late rows count whenever they come."""
    return fold_stream(stream, sketches.hourly_sketches, sketches.KEY, sketches.RULES, path, checkpoint, compact_every=compact_every)


def read_hours(spark: SparkSession, path: str) -> DataFrame:
    """What ``hourly_sketch_stream`` keeps, for ``sketches.sketched_counts``."""
    return read_folded(spark, path, sketches.KEY, sketches.RULES)


def telemetry_stream(stream: DataFrame, *, resolution_s: int = 3600, watermark: str = "2 hours") -> DataFrame:
    """T4: the first status of each observer and window that arrives."""
    snapped = stream.withColumn("reported_at", X.truncate_ts(F.col("arrival_ts"), resolution_s))
    return snapped.withWatermark("reported_at", watermark).dropDuplicatesWithinWatermark(["pubkey", "reported_at"])


def telemetry_fold_stream(stream: DataFrame, path: str, checkpoint: str, *, resolution_s: int = 3600) -> StreamingQuery:
    """T4: as ``telemetry_stream``, kept under ``path``; a window that an earlier run has stored is never taken again, however late a status comes."""
    store = Store(stream.sparkSession, path)

    def snap(batch: DataFrame, number: int) -> None:
        store.append("telemetry", telemetry_snapshots(batch, resolution_s=resolution_s, existing=store.appended("telemetry", number)), number)

    return stream.writeStream.foreachBatch(snap).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_stream(stream: DataFrame, fold: Callable[[DataFrame], DataFrame], keys: list[str], rules: dict[str, str], path: str, checkpoint: str, *, compact_every: int = 16) -> StreamingQuery:
    """T5: a folded table kept under ``path``; ``read_folded`` reads it.

    A micro-batch is folded and written as a delta of its own, ``delta=N``, whose size follows the batch and not the table.  Reading merges the last base with the
    deltas since; every ``compact_every`` batches the merge is written as the next base, and what it replaces goes one compaction later.  A batch that is run again
    writes the same folders again.
    """
    store = Store(stream.sparkSession, path)

    def merge(batch: DataFrame, number: int) -> None:
        store.write_delta(fold(batch), number)
        if (number + 1) % compact_every == 0:
            store.compact_deltas(keys, rules, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_folded(spark: SparkSession, path: str, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """T5: the table that ``fold_stream`` keeps under ``path``."""
    return Store(spark, path).folded(keys, rules)


def marked_arrivals(messages: DataFrame, decode: Callable[[DataFrame], DataFrame], *, airports: DataFrame | None = None, countries=(), continents=(), hold_s: float = arrivals.HOLD_S, keep_s: float = arrivals.KEEP_S) -> DataFrame:
    """A stream of ``kind, packet, status, reject``: decoded packets and statuses that the state store has marked as new or not, and rejected messages."""
    parts = split_messages(messages, airports, countries=countries, continents=continents)
    kinds = {
        "packet": arrivals.packets_with_state(decode(parts["packets"]), hold_s=hold_s, keep_s=keep_s),
        "status": arrivals.statuses_with_state(parts["status"], keep_s=keep_s),
        "reject": parts["rejects"],
    }
    shapes = {k: df.schema for k, df in kinds.items()}
    rows = [df.select(F.lit(k).alias("kind"), *((F.struct(*df.columns) if n == k else F.lit(None).cast(shapes[n])).alias(n) for n in kinds)) for k, df in kinds.items()]
    return reduce(DataFrame.unionByName, rows)


def run_ingest_stream(
    messages: DataFrame, decode: Callable[[DataFrame], DataFrame], scopes: DataFrame, keys: DataFrame, state_dir: str, checkpoint: str, *, airports: DataFrame | None = None, countries=(), continents=(),
    hold_s: float = arrivals.HOLD_S, keep_s: float = arrivals.KEEP_S, upkeep_every: int = 100, telemetry_keep_s: float = 28 * 86_400,
    subscriptions: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """W-A, T5, T6, T10: the ingest batch over a stream of messages, with all its tables kept under ``state_dir``; ``read_ingested`` reads them.

    ``decode`` turns ``packets`` rows of S3 into decoded packets, on a stream.  What has come before is in Spark's state store (see ``arrivals``), so a micro-batch reads no packets,
    observations, messages or telemetry of earlier ones: it appends new observations and telemetry by day, events and rejects by batch, and of packets, messages and counts the
    rows that it touched, which readers merge.  Tables with a row per device, place or route are read and written whole, and older versions go.  A micro-batch that is run again
    overwrites its own folders, so nothing counts twice.  Every ``upkeep_every`` batches ``upkeep`` merges and prunes what is kept, between two batches.

    ``subscriptions`` reads the clients' subscriptions, anew for each micro-batch; its events then go to ``deliveries`` (S9, T8), a row per client that wants one, as the text that it gets.
    """
    spark = messages.sparkSession
    store = Store(spark, state_dir)

    def ingest(batch: DataFrame, number: int) -> None:
        work = f"{state_dir}/work"

        def save(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{work}/{name}")
            return spark.read.schema(df.schema).parquet(f"{work}/{name}")

        rows = save(batch, "marked")  # the state moves on once per batch
        if rows.isEmpty():
            return
        of = lambda kind: rows.filter(F.col("kind") == kind).select(f"{kind}.*")
        tables = {n: store.latest(n, number) for n in WHOLE}
        found = ingest_batch(of("packet"), of("status"), scopes, keys, State({n: t for n, t in tables.items() if t is not None}), save=save, touched_only=True)
        for name, df in found.items():
            if name in BY_DAY:
                store.append_by_day(name, df, BY_DAY[name], number)
            else:
                store.append(name, df, number)
        store.append("rejects", of("reject"), number)
        if subscriptions is not None:
            told = save(store.read_batch("events", number).withColumn("event_id", F.monotonically_increasing_id()), "told")
            wanted = match_subscriptions(told, subscriptions())
            store.append("deliveries", to_event_json(told).join(wanted, "event_id").select("client_id", "type", "iata", "value"), number)
        for name in WHOLE:
            store.forget(name, number - 2)
        if (number + 1) % upkeep_every == 0:
            upkeep(spark, state_dir, number, packet_keep_s=keep_s, telemetry_keep_s=telemetry_keep_s)

    stream = marked_arrivals(messages, decode, airports=airports, countries=countries, continents=continents, hold_s=hold_s, keep_s=keep_s)
    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upkeep(spark: SparkSession, state_dir: str, number: int, *, as_of: Column | None = None, packet_keep_s: float = arrivals.KEEP_S, telemetry_keep_s: float = 28 * 86_400) -> None:
    """T10, J14 on what ``run_ingest_stream`` keeps: packets last heard before the cutoff go with their observations, counts and messages, old telemetry goes, and the batches before
    ``number`` of each table become one.  ``as_of`` is the newest time that a packet was heard unless given.  A run that was broken off is made good by the next.

    Days of observations before the cutoff are dropped as folders; the few of their rows whose packet still lives are written back.
    """
    store = Store(spark, state_dir)
    packets = store.merged("packets", UPSERTED["packets"], merge_rules)
    if packets is None:
        return
    work = f"{state_dir}/work/upkeep"

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    packets = save(packets, "all-packets")
    newest = packets.agg(F.max("last_heard_at").alias("t")) if as_of is None else spark.range(1).select(as_of.alias("t"))
    cut = newest.select(*(F.expr(f"t - make_dt_interval(0, 0, 0, {s})").alias(n) for n, s in (("packet", packet_keep_s), ("telemetry", telemetry_keep_s)))).first()
    kept = save(packets.filter(F.col("last_heard_at") >= F.lit(cut["packet"])), "living")
    for name in UPSERTED:
        table = store.merged(name, UPSERTED[name], merge_rules, before=number)
        if table is not None:
            store.compact(name, save(table.join(kept.select("packet_hash"), "packet_hash", "left_semi"), name), number)
    for name, border in (("observations", cut["packet"]), ("telemetry", cut["telemetry"])):
        rows, day = store.by_day(name, until=F.lit(border)), f"{border:%Y-%m-%d}"
        if rows is None:
            continue
        old = rows.filter(F.to_date(BY_DAY[name]) < F.lit(day).cast("date"))
        if name == "observations":
            store.append_by_day("observations-kept", save(old.join(kept.select("packet_hash"), "packet_hash", "left_semi"), "observations"), BY_DAY[name], number)
            store.drop_days("observations", day)
            back = store.by_day("observations-kept")
            if back is not None:
                store.append_by_day("observations", back, BY_DAY[name], number)
                store.drop_days("observations-kept", "9999")
        else:
            store.drop_days(name, day)


def read_ingested(spark: SparkSession, state_dir: str, name: str, *, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The table ``name`` of ``ingest_batch`` as ``run_ingest_stream`` keeps it; of observations and telemetry only the days between two times, if given."""
    store = Store(spark, state_dir)
    if name in UPSERTED:
        return store.merged(name, UPSERTED[name], merge_rules)
    if name in BY_DAY:
        rows = store.by_day(name, since, until)
        for bound, keep in ((since, lambda b: F.col(BY_DAY[name]) >= b), (until, lambda b: F.col(BY_DAY[name]) <= b)):
            rows = rows if bound is None else rows.filter(keep(bound))
        return rows
    return store.appended(name, None) if name in ("events", "rejects", "deliveries") else store.latest(name, None)


def match_subscriptions(events: DataFrame, subs: DataFrame) -> DataFrame:
    """``event_id, client_id`` of deliveries; events have ``event_id, type, iata, payload_type, channel_hash``.

    A subscription matches if each of its lists that is not empty holds the event's value.  Each is joined by equality on the most selective list that it
    has (channel hashes, places, payload types, event types) and checked for the others.  Only those without any list meet every event, of
    which ``MAX_OPEN`` at most are accepted.  A client gets an event once.
    """
    lists = [("channel_hashes", "channel_hash"), ("iatas", "iata"), ("payload_types", "payload_type"), ("events", "type")]

    def some(name: str) -> Column:
        return F.coalesce(F.size(name), F.lit(0)) > 0

    rows = events.select("event_id", "type", "iata", "payload_type", "channel_hash")
    hits, left = [], subs.select("client_id", *(n for n, _ in lists))
    for name, value in lists:
        own = left.filter(some(name)).withColumn("_value", F.explode(F.array_distinct(name)))
        fit = [~some(n) | F.coalesce(F.array_contains(n, F.col(v)), F.lit(False)) for n, v in lists if n != name]
        hits.append(rows.join(own, F.col(value) == F.col("_value")).filter(reduce(and_, fit)).select("event_id", "client_id"))
        left = left.filter(~some(name))
    anywhere = left.select("client_id").distinct()
    if anywhere.limit(MAX_OPEN + 1).count() > MAX_OPEN:
        raise ValueError(f"more than {MAX_OPEN} clients subscribe to everything")
    hits.append(rows.select("event_id").join(F.broadcast(anywhere), how="cross"))
    return reduce(DataFrame.union, hits).distinct()


def expand_subscription_places(subs: DataFrame, regions: DataFrame, members: DataFrame) -> DataFrame:
    """``iatas`` with the members of the regions named in ``region_ids`` and ``region_slugs``; unknown regions are skipped."""
    known = regions.join(members, "region_id").groupBy("region_id", "slug").agg(F.collect_set("iata").alias("members"))
    names = subs.select("client_id", "subscription_id", F.explode(F.concat(F.transform(F.coalesce("region_ids", F.array().cast("array<int>")), lambda x: x.cast("string")), F.coalesce("region_slugs", F.array().cast("array<string>")))).alias("name"))
    by_name = known.select(F.explode(F.array(F.col("region_id").cast("string"), F.col("slug"))).alias("name"), "members")
    more = names.join(by_name, "name").groupBy("client_id", "subscription_id").agg(F.flatten(F.collect_list("members")).alias("more"))
    empty = F.array().cast("array<string>")
    joined = subs.join(more, ["client_id", "subscription_id"], "left")
    return joined.withColumn("iatas", F.array_sort(F.array_union(F.coalesce("iatas", empty), F.coalesce("more", empty)))).drop("more")
