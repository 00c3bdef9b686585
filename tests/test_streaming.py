"""Streams give what the batch jobs give."""

import datetime as dt
import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from meshobs.operators import events, filters, ingest, maintenance, observers, packets, sketches
from meshobs.plans import ingested
from meshobs.plans.adapters import Tables
from meshobs.sources import dims, messages
from meshobs.sources.messages import TOPIC_ROOT
from meshobs.streaming import arrivals, jobs

SF = "/root/testdata/sf0.001"


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_dedup_and_hours(spark, tmp_path):
    rows = Tables(spark, SF).obs.select("packet_hash", "observer_id", F.col("heard_at").cast("timestamp").alias("heard_at"), "iata", F.col("id").alias("seq"), "source_broker")
    both = rows.unionByName(rows.withColumn("source_broker", F.lit("other"))).orderBy("heard_at")
    for k in range(3):  # in order of time
        both.filter(f"seq % 999 >= {k * 333} AND seq % 999 < {(k + 1) * 333}").coalesce(1).write.mode("append").parquet(str(tmp_path / "obs"))
    stream = spark.readStream.schema(both.schema).parquet(str(tmp_path / "obs"))
    once = run(jobs.dedup_stream(stream, watermark="60 days"), "deduped")
    assert once.count() == packets.dedup_observations(both).count() == rows.count()
    hours = run(jobs.hourly_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "obs"))), "hours")
    # Windows that the watermark has passed, an hour before the last time, are out; each counts both copies.
    passed = both.agg(F.max("heard_at")).first()[0] - dt.timedelta(hours=1)
    want = both.groupBy("iata", F.window("heard_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("packet_hash").alias("p")).collect()
    want = {(r.iata, r.w.start): (r.n, r.p) for r in want if r.w.end <= passed}
    got = {(r.iata, r.hour): (r.observations, r.packets) for r in hours.collect()}
    assert len(want) > 100 and got == want
    batch = jobs.hourly_stream(both)
    assert batch.agg(F.sum("observations")).first()[0] == 2 * rows.count()


@pytest.mark.parametrize("compact_every", [2, 16])
def test_fold_stream(spark, tmp_path, compact_every):
    rows = Tables(spark, SF).obs.select("observer_id", "heard_at")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold = lambda b: b.groupBy("observer_id").agg(F.count(F.lit(1)).alias("n"), F.max("heard_at").alias("last"))
    rules, path = {"n": "sum", "last": "max"}, str(tmp_path / "out")
    jobs.fold_stream(stream, fold, ["observer_id"], rules, path, str(tmp_path / "cp"), compact_every=compact_every).awaitTermination()
    got = jobs.read_folded(spark, path, ["observer_id"], rules)
    assert sorted(map(tuple, got.select("observer_id", "n", "last").collect())) == sorted(map(tuple, fold(rows).collect()))
    assert {f.name for f in (tmp_path / "out").iterdir()} == ({"base=1", "base=3", "delta=2", "delta=3", "delta=4"} if compact_every == 2 else {f"delta={k}" for k in range(5)})


def test_sketches_fold_over_batches(spark, tmp_path):
    rows = Tables(spark, SF).obs
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.hourly_sketch_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), compact_every=2).awaitTermination()
    hours = jobs.read_hours(spark, str(tmp_path / "out"))
    got = {(r.iata, r.hour): r for r in sketches.sketched_counts(hours, ["iata", "hour"]).collect()}
    want = rows.groupBy("iata", F.date_trunc("hour", "heard_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("packet_hash").alias("p"), F.countDistinct("observer_id").alias("o")).collect()
    assert {k: (r.observations, r.packets, r.observers) for k, r in got.items()} == {(r.iata, r.hour): (r.n, r.p, r.o) for r in want}
    all_of = sketches.sketched_counts(hours).first()
    exact = rows.agg(F.countDistinct("packet_hash").alias("p"), F.countDistinct("observer_id").alias("o"), F.countDistinct("iata").alias("i")).first()
    assert all_of.observations == rows.count() and abs(all_of.packets - exact.p) < 0.05 * exact.p and all_of.observers == exact.o and all_of.places == exact.i
    assert sketches.sketched_counts(hours, iatas=["none"]).first().packets == 0


def test_telemetry_streams(spark, tmp_path):
    status = ingested.decoded_statuses(Tables(spark, SF)).select("pubkey", "seq", "arrival_ts", "stats")
    for k in range(3):  # in order of arrival, with windows across files
        status.orderBy("seq").filter(F.col("stats.uptime_secs").between(k * 340, k * 340 + 339)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(status.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.telemetry_fold_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = sorted(map(tuple, observers.telemetry_snapshots(status).select("pubkey", "reported_at").collect()))
    got = jobs.Store(spark, str(tmp_path / "out")).appended("telemetry", None)
    assert sorted(map(tuple, got.select("pubkey", "reported_at").collect())) == want
    once = run(jobs.telemetry_stream(spark.readStream.schema(status.schema).parquet(str(tmp_path / "in")), watermark="60 days"), "telemetry_once")
    assert sorted(map(tuple, once.select("pubkey", "reported_at").collect())) == want


def test_clamped_times(spark):
    at = dt.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([("2024-01-01T11:59:00", at), ("2024-01-01T11:00:00", at), (None, at)], "timestamp_text string, arrival_ts timestamp")
    assert [r.heard_at.minute for r in jobs.clamp_times(rows).collect()] == [59, 0, 0]


@pytest.fixture(scope="module")
def raw_messages(spark, tmp_path_factory):
    """Messages of the derived packets and statuses, what a decoder makes of them, and three files of them in order of arrival."""
    base = tmp_path_factory.mktemp("messages")
    t = Tables(spark, SF)
    decoded, status = ingested.decoded_packets(t), ingested.decoded_statuses(t)
    key = lambda c: F.lpad(c, 4, "0")
    raw = F.to_json(F.struct(F.hex("seq").alias("raw"), F.col("timestamp_text").alias("timestamp"), F.lit("1").alias("len"), F.col("snr_text").alias("SNR"), F.col("rssi_text").alias("RSSI")))
    packets_in = decoded.select(F.concat_ws("/", F.lit(TOPIC_ROOT), "iata", key("observer_pubkey"), F.lit("packets")).alias("topic"), F.regexp_replace(raw, '"raw":"([0-9A-F])"', '"raw":"0$1"').alias("payload"), "broker", "arrival_ts", "seq")
    told = F.to_json(F.struct("source", "client_version", "model", "firmware_version", "origin", "radio", "stats"))
    status_in = status.select(F.concat_ws("/", F.lit(TOPIC_ROOT), "iata", key("pubkey"), F.lit("status")).alias("topic"), told.alias("payload"), "broker", "arrival_ts", "seq")
    bad = spark.createDataFrame([(f"{TOPIC_ROOT}/YVR/ab/packets", "{no json", "mqtt1", dt.datetime(2024, 1, 12), 1)], status_in.schema)
    everything = packets_in.unionByName(status_in).withColumn("payload", F.regexp_replace("payload", '"raw":"([0-9A-F]([0-9A-F]{2})*)"', '"raw":"0$1"')).unionByName(bad)
    everything.write.parquet(str(base / "all"))
    everything = spark.read.parquet(str(base / "all"))
    for k, part in enumerate(("arrival_ts < TIMESTAMP '2024-01-11'", "arrival_ts >= TIMESTAMP '2024-01-11' AND arrival_ts < TIMESTAMP '2024-01-16'", "arrival_ts >= TIMESTAMP '2024-01-16'")):
        everything.filter(part).coalesce(1).write.parquet(str(base / f"part{k}"))
    decoded.drop("arrival_ts", "broker", "iata", "observer_pubkey", "timestamp_text", "rssi_text", "snr_text").write.parquet(str(base / "decoded"))
    known = spark.read.parquet(str(base / "decoded"))
    return base, everything, lambda p: p.drop("raw").join(known, "seq"), ingested.channel_keys(t)


def feed(base, folder, k):
    """Part ``k`` as a new file of the stream's folder."""
    folder.mkdir(exist_ok=True)
    for f in (base / f"part{k}").glob("*.parquet"):
        shutil.copy(f, folder / f"{k}-{f.name}")
        at = time.time() - 100 + 10 * k  # files are taken in order of these times
        os.utime(folder / f"{k}-{f.name}", (at, at))


def test_ingest_stream_equals_one_batch(spark, tmp_path, raw_messages, monkeypatch):
    """Three micro-batches, with a restart after the first and the last run twice, leave the tables that one batch of all messages gives, and read no history but small tables."""
    base, everything, decode, keys = raw_messages
    scopes = dims.scope_dim(spark, ingested.SCOPES)
    reads = []
    inner = jobs.Store._read
    monkeypatch.setattr(jobs.Store, "_read", lambda self, table, numbers: reads.append((table, numbers)) or inner(self, table, numbers))
    path = str(tmp_path / "state")

    def run_on():
        stream = messages.read_messages(spark, str(tmp_path / "in"), streaming=True, fmt="parquet", maxFilesPerTrigger="1")
        jobs.run_ingest_stream(stream, decode, scopes, keys, path, str(tmp_path / "cp"), subscriptions=lambda: spark.read.parquet(str(tmp_path / "subs"))).awaitTermination()

    def subscribe(client, **lists):
        row = (client, *(lists.get(n, []) for n in ("iatas", "payload_types", "channel_hashes", "events")))
        spark.createDataFrame([row], "client_id string, iatas array<string>, payload_types array<int>, channel_hashes array<string>, events array<string>").write.mode("append").parquet(str(tmp_path / "subs"))

    subscribe("early", iatas=["YVR"], events=["packetObservation", "observerStatus"])
    feed(base, tmp_path / "in", 0)
    run_on()
    feed(base, tmp_path / "in", 1)
    feed(base, tmp_path / "in", 2)
    subscribe("late", payload_types=[0], events=["channelMessage"])
    run_on()
    last = max(int(f.name) for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit())
    for k in (last, last - 1):  # as if the stream had stopped before it could note that the last batch with rows was done
        (tmp_path / "cp" / "commits" / str(k)).unlink()
        (tmp_path / "cp" / "commits" / f".{k}.crc").unlink(missing_ok=True)
    (tmp_path / "cp" / "offsets" / str(last)).unlink()
    (tmp_path / "cp" / "offsets" / f".{last}.crc").unlink(missing_ok=True)
    assert reads == []  # tables of many batches are not read by the stream
    stamps = {f: f.stat().st_mtime_ns for f in (tmp_path / "state" / "events").glob("batch=*/_SUCCESS")}
    run_on()
    assert sum(f.stat().st_mtime_ns > t for f, t in stamps.items()) == 1
    events_of = lambda where: [json.loads(r.value)["event"] for r in jobs.read_ingested(spark, path, "deliveries").filter(where).collect()]
    told = jobs.read_ingested(spark, path, "events")
    assert len(events_of("client_id = 'early'")) == told.filter("iata = 'YVR' AND type IN ('packetObservation', 'observerStatus')").count() > 0
    assert 0 < len(events_of("client_id = 'late'")) < told.filter("type = 'channelMessage'").count()
    parts = ingest.split_messages(everything)
    want = ingest.ingest_batch(decode(parts["packets"]), parts["status"], scopes, keys, save=ingested.saver(spark, "t"))
    got = {name: jobs.read_ingested(spark, path, name) for name in want}
    show = lambda tables: {r.kind: (r.n, r.checksum) for r in ingested.digests(tables).collect()}
    assert show(got) == show(want) and jobs.read_ingested(spark, path, "rejects").count() == 1
    for name in jobs.WHOLE:
        assert len(list((tmp_path / "state" / name).glob("batch=*"))) <= 2
    # Only the days that are asked for are read.
    since, until = F.lit("2024-01-12 06:00:00").cast("timestamp"), F.lit("2024-01-13 06:00:00").cast("timestamp")
    some = jobs.read_ingested(spark, path, "observations", since=since, until=until)
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()
    whole = jobs.read_ingested(spark, path, "observations")
    assert 0 < some.count() == whole.filter((F.col("heard_at") >= since) & (F.col("heard_at") <= until)).count() < whole.count()


def test_upkeep_of_what_the_stream_keeps(spark, tmp_path, raw_messages):
    """Old days go as folders, packets that still live keep their old observations, and the stream goes on."""
    base, everything, decode, keys = raw_messages
    scopes, path = dims.scope_dim(spark, ingested.SCOPES), str(tmp_path / "state")

    def run_on(k, **options):
        feed(base, tmp_path / "in", k)
        stream = messages.read_messages(spark, str(tmp_path / "in"), streaming=True, fmt="parquet", maxFilesPerTrigger="1")
        jobs.run_ingest_stream(stream, decode, scopes, keys, path, str(tmp_path / "cp"), **options).awaitTermination()

    run_on(0)
    run_on(1)
    days = lambda name: sorted(f.name for f in (tmp_path / "state" / name).glob("day=*"))
    kept_apart = lambda df: spark.createDataFrame(df.collect(), df.schema)
    before, obs = days("observations"), kept_apart(jobs.read_ingested(spark, path, "observations").select("packet_hash", "observer_id", "heard_at", "seq"))
    all_packets = kept_apart(jobs.read_ingested(spark, path, "packets").select("packet_hash", "last_heard_at"))
    cut = dt.datetime(2024, 1, 12)
    jobs.upkeep(spark, path, 3, as_of=F.lit(cut + dt.timedelta(days=30)).cast("timestamp"), telemetry_keep_s=29 * 86_400)
    alive = all_packets.filter(F.col("last_heard_at") >= F.lit(cut))
    assert 0 < alive.count() < all_packets.count()
    left = jobs.read_ingested(spark, path, "observations")
    key = lambda df: sorted(map(tuple, df.select("packet_hash", "observer_id", "heard_at", "seq").collect()))
    in_old_days_of_dead = F.to_date("heard_at") < F.lit(cut).cast("date")
    want = obs.join(alive, "packet_hash", "left_semi").unionByName(obs.join(alive, "packet_hash", "left_anti").filter(~in_old_days_of_dead))
    assert key(left) == key(want) and len(days("observations")) < len(before)
    assert min(days("telemetry")) == "day=2024-01-13" and len(list((tmp_path / "state" / "packets").glob("batch=*"))) == 1
    for name in ("packets", "packet_counts"):
        assert jobs.read_ingested(spark, path, name).count() == alive.count()
    run_on(2)
    assert jobs.read_ingested(spark, path, "packets").count() > alive.count()
    assert key(jobs.read_ingested(spark, path, "observations"))[: len(key(want))] != [] and jobs.read_ingested(spark, path, "observations").count() > want.count()


def test_state_marks_what_is_new_and_is_freed(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "seq long, arrival_ts timestamp, heard_at timestamp, packet_hash string, observer_pubkey string, payload_type int, message struct<ok:boolean>"
    files = [
        [(2, at(2), at(0), "a", "o", 5, (False,)), (1, at(1), at(0), "a", "o", 5, (False,)), (3, at(3), at(1), "a", "p", 5, (True,)), (4, at(4), at(1), "b", None, 4, None)],
        [(5, at(50), at(0), "a", "o", 5, (True,)), (6, at(50), at(2), "a", "o", 5, (True,)), (7, at(51), at(1), "b", None, 4, None)],
    ]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def marks(name, **hold):
        got = []
        stream = arrivals.packets_with_state(read(), **hold)
        q = stream.writeStream.foreachBatch(lambda b, _: got.extend(b.select("seq", "new_observation", "observation_count", "new_message").collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.seq: tuple(r)[1:] for r in got}

    def kept(name, variable):
        return spark.read.format("statestore").option("stateVarName", variable).load(str(tmp_path / name)).count()

    first_two = {1: (True, 1, False), 2: (False, None, False), 3: (True, 2, True), 4: (True, 1, False)}
    got = marks("long")
    assert got == first_two | {5: (False, None, False), 6: (True, 3, False), 7: (False, None, False)}
    assert kept("long", "count") == 2 and kept("long", "last") == 2
    freed = marks("short", hold_s=0.001, keep_s=0.002)
    assert {k: v for k, v in freed.items() if k < 5} == first_two
    for k in range(2):  # timers run when later micro-batches move the clock on
        spark.createDataFrame([(10 + k, at(55), at(55), "z", "o", 4, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        marks("short", hold_s=0.001, keep_s=0.002)
    assert kept("short", "count") <= 1 and kept("short", "seen") <= 1  # of the last packet at most


def test_state_needs_its_provider(spark, monkeypatch):
    spark.conf.unset(arrivals.PROVIDER[0])
    try:
        with pytest.raises(ValueError):
            arrivals.packets_with_state(spark.readStream.format("rate").load().select(F.lit("a").alias("packet_hash"), F.lit(1).alias("seq"), F.col("timestamp").alias("heard_at"), F.lit("o").alias("observer_pubkey"), F.lit(1).alias("payload_type")))
    finally:
        spark.conf.set(*arrivals.PROVIDER)


def test_published_versions_and_upkeep(spark, tmp_path):
    t, as_of = Tables(spark, SF), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    preset = F.when(F.col("node_type") != 1, "915,250,10")
    tables = {"observations": t.obs, "node_iatas": t.node_iatas, "nodes": t.nodes.withColumn("preset", preset), "observers": t.observers}
    path = str(tmp_path / "p")
    for _ in range(3):
        maintenance.refresh_published(tables, path, as_of=as_of)
    for name in ("hourly_stats", "top_nodes", "radio_presets"):
        assert {f.name for f in (tmp_path / "p" / name).iterdir() if not f.name.startswith(".")} == {"v=2", "v=3"}
    hours = maintenance.read_published(spark, f"{path}/hourly_stats")
    assert hours.agg(F.sum("observations")).first()[0] == t.obs.filter(F.col("heard_at") > as_of - F.expr("INTERVAL 7 DAYS")).count()
    edges = spark.createDataFrame([(1, 2, "YVR")], "node_id long, neighbor_id long, iata string")
    routes = spark.createDataFrame([([1, 2], ["aa", "bb"], "YVR", 1)], "node_ids array<long>, hash_prefix array<string>, iata string, id long")
    kept = maintenance.hourly_upkeep(tables | {"packets": t.packets, "telemetry": t.telemetry, "known_routes": routes, "node_neighbors": edges, "node_short_ids": t.short_ids}, path, as_of=as_of, packet_retention="20 days")
    cutoff = dt.datetime(2024, 1, 11)
    assert kept["packets"].agg(F.min("last_heard_at")).first()[0] >= cutoff and kept["known_routes"].count() == 0 and kept["node_neighbors"].count() == 0


def test_running_events(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "packet_hash string, seq long")
    first, counts = events.running_counts(rows.filter("seq <= 2"), None)
    second, counts = events.running_counts(rows.filter("seq > 2"), counts)
    got = {r.seq: (r.observation_count, r.is_first) for r in [*first.collect(), *second.collect()]}
    assert got == {1: (1, True), 2: (2, False), 3: (1, True), 4: (3, False)}
    assert {r.packet_hash: r.n for r in counts.collect()} == {"a": 3, "b": 1}


def test_subscriptions(spark):
    rows = spark.createDataFrame([(1, "packetObservation", "YVR", 5, "ef"), (2, "nodeUpdate", "SEA", 4, None)], "event_id long, type string, iata string, payload_type int, channel_hash string")
    subs = [("all", [], [], [], []), ("place", ["YVR"], [], [], []), ("type", [], [4], [], []), ("hash", [], [], ["ef"], []), ("kind", [], [], [], ["nodeUpdate"]), ("both", ["SEA"], [5], [], []), ("all", ["YVR"], [], [], [])]
    table = spark.createDataFrame(subs, "client_id string, iatas array<string>, payload_types array<int>, channel_hashes array<string>, events array<string>")
    got = sorted(map(tuple, jobs.match_subscriptions(rows, table).collect()))
    assert got == [(1, "all"), (1, "hash"), (1, "place"), (2, "all"), (2, "kind"), (2, "type")]


def test_subscription_places(spark):
    subs = spark.createDataFrame([("c", "s", ["SEA"], [1, 99], ["west"])], "client_id string, subscription_id string, iatas array<string>, region_ids array<int>, region_slugs array<string>")
    regions = spark.createDataFrame([(1, "bc"), (2, "west")], "region_id int, slug string")
    members = spark.createDataFrame([(1, "YVR"), (2, "YYC"), (2, "YVR")], "region_id int, iata string")
    assert jobs.expand_subscription_places(subs, regions, members).first()["iatas"] == ["SEA", "YVR", "YYC"]


def test_pages(spark):
    rows = spark.createDataFrame([(k, dt.datetime(2024, 1, 1, 0, k)) for k in range(5)], "id long, at timestamp")
    items, more, cursor = filters.page_meta(filters.page_desc(rows, "at", limit=2, ties=["id"]), "at", limit=2)
    assert [r.id for r in items] == [4, 3] and more and cursor == 1704067380000
    items, more, cursor = filters.page_meta(filters.page_desc(rows, "at", cursor=dt.datetime(2024, 1, 1, 0, 2), limit=2, ties=["id"]), "at", limit=2)
    assert [r.id for r in items] == [1, 0] and not more and cursor is None
