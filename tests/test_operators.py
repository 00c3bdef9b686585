"""Operators over small tables: what the derived tables cannot show."""

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F


from meshobs.functions import expr as X
from meshobs.operators import asof, channels, events, filters, neighbors, nodes, observers, resolve, routes, scopes, traces
from meshobs.sources import dims

from reference_values import python_transport_code

T = lambda m: dt.datetime(2024, 1, 1, 0, m)


def test_attach_radio(spark):
    obs = spark.createDataFrame([(1, "o", T(1), 10), (3, "o", T(3), 11), (5, "o", dt.datetime(2024, 1, 3), 12), (6, "p", T(6), 13)], "seq long, observer_id string, arrival_ts timestamp, id long")
    status = spark.createDataFrame([(2, "o", T(2), 910.5, 62.5, 7, 5), (4, "o", T(4), 915.0, 250.0, 10, 6)], "seq long, observer_id string, arrival_ts timestamp, freq double, bw double, sf int, cr int")
    got = {r.id: (r.radio_freq_mhz, r.spread_factor) for r in observers.attach_radio(obs, status).collect()}
    assert got == {10: (0, 0), 11: (910.5, 7), 12: (915.0, 10), 13: (0, 0)}


def test_observer_status_overwrites_all_but_three(spark):
    stats = "stats struct<uptime_secs:bigint,battery_mv:int>"
    schema = f"pubkey string, seq long, arrival_ts timestamp, origin string, source string, client_version string, model string, firmware_version string, radio string, {stats}"
    rows = [("k", 1, T(1), "roof", "org/ha:1", "v1", "m", "f", "910,62.5,7,5", (60, 4100)), ("k", 2, T(2), "", None, "", None, None, "bad", (61, 0))]
    r = observers.fold_observer_status(spark.createDataFrame(rows, schema)).first()
    assert (r.display_name, r.observer_type, r.battery_level) == ("roof", "ha", 4.1)
    assert (r.hardware_model, r.firmware_version, r.radio_freq_mhz, r.radio_sf, r.uptime_seconds, r.last_status_at) == ("", "", 0, 0, 61, T(2))
    halves = [spark.createDataFrame([x], schema) for x in rows]
    again = observers.fold_observer_status(halves[1], existing=observers.fold_observer_status(halves[0])).first()
    assert again.asDict() == r.asDict()


def test_fold_nodes(spark):
    advert = "advert struct<pubkey:string,type:int,flags:int,lat:int,lon:int,name:string>"
    schema = f"seq long, arrival_ts timestamp, hop_count int, radio_freq_mhz float, spread_factor int, bandwidth_khz float, {advert}"
    rows = [(1, T(1), 0, 910.0, 7, 62.5, ("k", 2, 0x90, 49_000_000, 0, "a")), (2, T(2), 1, 910.0, 7, 62.5, ("k", 3, 0x80, 0, 0, ""))]
    r = nodes.fold_nodes(spark.createDataFrame(rows, schema)).first()
    assert (r.node_type, r.name, r.latitude, r.longitude, r.radio_freq_mhz, r.first_seen, r.last_seen) == (3, "", 49.0, 0.0, None, T(1), T(2))


def test_node_places_within_a_millisecond(spark):
    times = [dt.datetime(2024, 1, 1, 0, 0, 0, us) for us in (100, 900)]
    places = spark.createDataFrame([(1, "YVR", times[0]), (1, "LHR", times[1])], "node_id long, iata string, last_heard timestamp")
    (found,) = nodes.node_places(places).collect()
    assert [tuple(p) for p in found.places] == [(1_704_067_200_000, "LHR"), (1_704_067_200_000, "YVR")]


def test_match_scope(spark):
    dim = dims.scope_dim(spark, ["bc", "west"])
    key = bytes.fromhex("84509cfe73d94f7f6a8299e6bcdb8a3c")
    code = python_transport_code(key, 4, b"\x01\x02")
    rows = [("a", 0, 4, "0102", code), ("b", 1, 4, "0102", code), ("c", 3, 4, "0102", code + 1), ("d", 3, 4, "0102", None)]
    got = {r.packet_hash: r.scope for r in scopes.match_scope(spark.createDataFrame(rows, "packet_hash string, route_type int, payload_type int, raw_payload string, transport_code_1 int"), dim).collect()}
    assert got == {"a": "#bc", "b": None, "c": None, "d": None}


def test_scopes_of_one_code(spark):
    """Of two scopes whose keys give the same code, the first by name counts."""
    dim, payload = dims.scope_dim(spark, ["bc", "west", "$private"]), "9ef5003b96375743"
    rows = spark.createDataFrame([("a", 3, 8, payload)], "packet_hash string, route_type int, payload_type int, raw_payload string")
    inner, outer = X.hmac_pads(F.col("transport_key"))
    codes = {r.name: r.code for r in dim.select("name", X.transport_code(inner, outer, F.lit(8), F.lit(payload)).alias("code")).collect()}
    assert codes["#bc"] == codes["$private"] != codes["#west"]
    assert [r.scope for r in scopes.match_scope(rows.withColumn("transport_code_1", F.lit(codes["$private"])), dim).collect()] == ["#bc"]


def test_resolution_as_of_arrival(spark):
    short = spark.createDataFrame([(1, "YVR", "aabb0000"), (2, "YVR", "aacc0000"), (3, "SEA", "aadd0000"), (4, "YVR", "aaee0000")], "node_id long, iata string, prefix_4 string")
    known = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 1)], "node_id long, node_type int")
    obs = spark.createDataFrame([(7, "p", "YVR", "aa", 1, T(5)), (8, "p", "YVR", "aabbffff", 2, T(5)), (9, "p", "SEA", "", 1, T(5))], "id long, packet_hash string, iata string, path_bytes string, hash_size int, arrival_ts timestamp")
    got = {(r.id, r.pos): (r.hop, r.confidence, r.node_ids) for r in resolve.resolve_paths(obs, short, known).collect()}
    assert got == {(7, 0): ("aa", "ambiguous", [1, 2]), (8, 0): ("aabb", "high", [1]), (8, 1): ("ffff", "none", None)}
    heard = spark.createDataFrame([(1, "YVR", T(1)), (2, "YVR", T(9)), (3, "SEA", T(1))], "node_id long, iata string, first_heard timestamp")
    timed = {(r.id, r.pos): (r.confidence, r.node_ids) for r in resolve.resolve_paths(obs, short, known, node_iatas=heard, as_of_arrival=True).collect()}
    assert timed[7, 0] == ("high", [1]) and timed[8, 1] == ("none", [])


def test_packet_detail_keeps_candidates_once(spark):
    """Hops count their candidates, whose ids stand once per packet; who does not ask for them shuffles no list of ids."""
    from meshobs.operators import packets

    n = 300
    known = spark.createDataFrame([(i, 2) for i in range(n)], "node_id long, node_type int")
    short = spark.createDataFrame([(i, "YVR", f"aa{i:06x}") for i in range(n)], "node_id long, iata string, prefix_4 string")
    obs = spark.createDataFrame([(i, "p", "YVR", "aaaabb", 1, T(i), 1, 3, 1.0) for i in range(4)], "id long, packet_hash string, iata string, path_bytes string, hash_size int, heard_at timestamp, observer_id long, hop_count int, snr double")
    table = spark.createDataFrame([("p", None, "t", 0, ["aa", "cc"])], "packet_hash string, scope_id int, trace_tag string, trace_flags int, trace_hashes array<string>")
    named = spark.createDataFrame([(1, "o")], "observer_id long, display_name string")
    scope_list = spark.createDataFrame([(1, "#a")], "scope_id int, name string")
    texts = spark.createDataFrame([], "packet_hash string, sender_name string, content string, sent_at timestamp")
    found = packets.packet_detail(table, obs, named, scope_list, texts, short, known)
    r = found.first()
    assert [(h.hop, h.confidence, h.candidates) for h in r.observations[3].path] == [("aa", "ambiguous", n), ("aa", "ambiguous", n), ("bb", "none", 0)]
    assert [(h.hop, h.confidence, h.candidates, h.iata) for h in r.route] == [("aa", "ambiguous", n, "YVR"), ("cc", "none", 0, "YVR")]
    assert [(c.iata, c.hop, c.node_ids) for c in r.candidates] == [("YVR", "aa", list(range(n)))]
    traced = traces.trace_detail(table, obs, short, known).orderBy("pos").collect()
    assert [(h.hop, h.confidence, h.node_ids) for h in traced] == [("aa", "ambiguous", list(range(n))), ("cc", "none", None)]
    plan = found.select("packet_hash", "observations", "route")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_reconfirm_width(spark):
    table = spark.createDataFrame([([1, 2], ["aa", "bb"], "YVR", 1)], "node_ids array<long>, hash_prefix array<string>, iata string, id long")
    short = spark.createDataFrame([(1, "YVR", "aabb0000"), (2, "YVR", "bb000000"), (3, "YVR", "aacc0000")], "node_id long, iata string, prefix_4 string")
    assert routes.reconfirm_routes(table, short).count() == 1 and routes.reconfirm_routes(table, short, by_width=True).count() == 0
    assert routes.reconfirm_routes(table, short.filter("node_id <> 2")).count() == 0


def test_best_trace_payload(spark):
    rows = [("t", "b", '{"pathHashes":["a","b"]}'), ("t", "a", '{"pathHashes":["c","d"]}'), ("t", "c", None), ("u", "d", None)]
    got = {r.trace_tag: (r.best_payload, r.hops) for r in traces.best_trace_payload(spark.createDataFrame(rows, "trace_tag string, packet_hash string, parsed_payload string")).collect()}
    assert got == {"t": ('{"pathHashes":["c","d"]}', 2), "u": (None, 0)}


def test_trace_width_mismatch_resolves_to_nothing(spark):
    packets = spark.createDataFrame([("p", "t", 1, ["aa", "aabb"])], "packet_hash string, trace_tag string, trace_flags int, trace_hashes array<string>")
    obs = spark.createDataFrame([(1, "p", "YVR", T(1))], "id long, packet_hash string, iata string, heard_at timestamp")
    short = spark.createDataFrame([(1, "YVR", "aabb0000")], "node_id long, iata string, prefix_4 string")
    known = spark.createDataFrame([(1, 2)], "node_id long, node_type int")
    got = {r.pos: (r.hop, r.confidence) for r in traces.trace_detail(packets, obs, short, known).collect()}
    assert got == {0: ("aa", "none"), 1: ("aabb", "high")}


def test_tristate_and_names(spark):
    df = spark.createDataFrame([(1, True, "Alpha"), (2, False, "beta"), (3, None, "a_b")], "id int, flag boolean, name string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(filters.tristate(df, "flag", None)) == [1, 2, 3] and ids(filters.tristate(df, "flag", True)) == [1] and ids(filters.tristate(df, "flag", False)) == [2, 3]
    assert ids(filters.name_like(df, "name", "ALP")) == [1] and ids(filters.name_like(df, "name", "a_b")) == [3]


def test_messages_clean_and_first(spark):
    rows = [("p", "ef", "s", "first\x00", T(1), 1), ("p", "ef", "s", "second", T(2), 2), ("q", "ef", None, None, T(3), 3)]
    df = spark.createDataFrame(rows, "packet_hash string, channel_hash string, sender_name string, content string, sent_at timestamp, seq long")
    got = {r.packet_hash: (r.sender_name, r.content) for r in channels.fold_channel_messages(df).collect()}
    assert got == {"p": ("s", "first"), "q": ("", "")}
    marked = channels.mark_decrypted(spark.createDataFrame([("p",), ("z",)], "packet_hash string"), df)
    assert {r.packet_hash: r.decrypted for r in marked.collect()} == {"p": True, "z": False}


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, 5, "a", None), (2, 1, "x", "k")], "id int, n long, s string, t string")
    new = spark.createDataFrame([(1, 2, "b", "z"), (3, 9, "c", None)], "id int, n long, s string, t string")
    got = {r.id: (r.n, r.s, r.t) for r in filters.merge_by_key(old, new, ["id"], {"n": "sum", "s": "first", "t": "last_known"}).collect()}
    assert got == {1: (7, "a", "z"), 2: (1, "x", "k"), 3: (9, "c", None)}


def test_scope_list_is_bounded(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(scopes, "MAX_SCOPES", 1)
    rows = spark.createDataFrame([("a", 0, 4, "0102", 1)], "packet_hash string, route_type int, payload_type int, raw_payload string, transport_code_1 int")
    with pytest.raises(ValueError):
        scopes.match_scope(rows, dims.scope_dim(spark, ["bc", "west"]))


def test_radio_goes_on_from_stored_values(spark):
    obs = spark.createDataFrame([(1, "o", T(1), 10), (3, "o", T(3), 11), (4, "p", T(4), 12)], "seq long, observer_id string, arrival_ts timestamp, id long")
    status = spark.createDataFrame([(2, "o", T(2), 910.5, 62.5, 7, 5)], "seq long, observer_id string, arrival_ts timestamp, freq double, bw double, sf int, cr int")
    stored = spark.createDataFrame([("o", 915.0, 250.0, 10, 6)], "observer_id string, freq double, bw double, sf int, cr int")
    got = {r.id: r.spread_factor for r in observers.attach_radio(obs, status, stored=stored).collect()}
    assert got == {10: 10, 11: 7, 12: 0}


def test_prefixes_are_unique_between_first_and_second(spark):
    short = spark.createDataFrame([("n1", "YVR", "aabbccdd"), ("n2", "YVR", "aabb0000"), ("n3", "YVR", "aacc0000"), ("n4", "YVR", "aadd0000"), ("n5", "SEA", "aabbccdd"), ("n6", "YVR", "ee000000")], "node_id string, iata string, prefix_4 string")
    known = spark.createDataFrame([(f"n{k}", 1 if k == 4 else 2) for k in range(1, 7)], "node_id string, node_type int")
    heard = spark.createDataFrame([("n1", "YVR", T(5)), ("n2", "YVR", T(9)), ("n3", "YVR", T(5)), ("n4", "YVR", T(1)), ("n5", "SEA", T(2)), ("n6", "YVR", T(7))], "node_id string, iata string, first_heard timestamp")
    prefixes = resolve.relay_prefixes(short, known, node_iatas=heard)
    spans = {(r.iata, r.hop): (r.node_id, r.since, r.until) for r in resolve.unique_intervals(prefixes).collect()}
    assert ("YVR", "aa") not in spans  # two come at once; the companion of minute 1 is no candidate
    assert spans["YVR", "aabb"] == ("n1", T(5), T(9)) and spans["YVR", "aacc"] == ("n3", T(5), None) and spans["SEA", "aa"] == ("n5", T(2), None)
    rows = [(k, "YVR", path, size, T(m), T(m)) for k, (path, size, m) in enumerate([("aabbee00", 2, 6), ("aabbee00", 2, 7), ("aabbee00", 2, 8), ("aabbee00", 2, 9), ("aaccee00", 2, 40), ("aabb", 2, 8), ("aabbccddee", 4, 8), ("", 1, 8), ("ffffee00", 2, 8)])]
    obs = spark.createDataFrame(rows, "id long, iata string, path_bytes string, hash_size int, heard_at timestamp, arrival_ts timestamp").withColumn("payload_type", F.lit(2))
    found = {tuple(r.node_ids): (r.observation_count, r.first_seen, r.hash_prefix) for r in routes.build_known_routes(obs, resolve.unique_intervals(prefixes)).collect()}
    assert found == {("n1", "n6"): (2, T(7), ["aabb", "ee00"]), ("n3", "n6"): (1, T(40), ["aacc", "ee00"])}
    adverts = obs.withColumns({"node_id": F.lit("n9"), "node_type": F.lit(2)})
    edges = {r.neighbor_id: r.observation_count for r in neighbors.fold_neighbors(adverts, resolve.unique_intervals(prefixes)).collect()}
    assert edges == {"n1": 5, "n3": 1}  # the four-byte hop and those before minute 9
    able = {r.node_id: (r.multibyte_paths, r.multibyte_traces) for r in resolve.node_capabilities(obs, prefixes).collect()}
    assert able == {"n1": (True, False), "n2": (True, False), "n3": (True, False), "n6": (True, False)}
    plan = routes.build_known_routes(obs, resolve.unique_intervals(prefixes))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "first_heard" in plan


def test_intervals_equal_candidates_at_each_arrival(spark):
    """Unique hops by intervals are those with one candidate by lists."""
    import random

    rng = random.Random(3)
    ids = [(f"n{k}", rng.choice(["YVR", "SEA"]), "".join(rng.choice("ab") for _ in range(8)), 2 + k % 3, T(rng.randrange(20))) for k in range(40)]
    table = spark.createDataFrame(ids, "node_id string, iata string, prefix_4 string, node_type int, first_heard timestamp")
    obs = spark.createDataFrame([(k, "h", rng.choice(["YVR", "SEA"]), "".join(rng.choice("ab") for _ in range(16)), rng.choice([1, 2, 3, 4]), T(rng.randrange(22))) for k in range(300)], "id long, packet_hash string, iata string, path_bytes string, hash_size int, arrival_ts timestamp")
    obs = obs.withColumn("heard_at", F.col("arrival_ts"))
    lists = resolve.resolve_paths(obs, table.drop("first_heard"), table, node_iatas=table, as_of_arrival=True)
    spans = resolve.unique_intervals(resolve.relay_prefixes(table, table, node_iatas=table))
    hops = resolve.explode_hops(obs).join(obs.select("id", "arrival_ts"), "id").join(spans, ["iata", "hop"])
    got = {(r.id, r.pos, r.node_id) for r in hops.filter(resolve.within(F.col("arrival_ts"))).collect()}
    assert got == {(r.id, r.pos, r.node_ids[0]) for r in lists.filter("candidates = 1").collect()} and len(got) > 50


def test_carried_values_cross_days(spark):
    rows = spark.createDataFrame([(k, "o", dt.datetime(2024, 1, 1 + k // 4, k % 4)) for k in range(1, 20)], "seq long, key string, arrival_ts timestamp")
    updates = spark.createDataFrame([(2, "o", dt.datetime(2024, 1, 1, 2), 7), (6, "o", dt.datetime(2024, 1, 2, 2), None), (9, "o", dt.datetime(2024, 1, 3, 1), 3), (9, "p", dt.datetime(2024, 1, 3, 1), 99)], "seq long, key string, arrival_ts timestamp, v int")
    last = {r.seq: r.v for r in asof.carried(rows, updates, ["key"], "v").collect()}
    assert last == {k: None if k < 2 else 7 if k < 9 else 3 for k in range(1, 20)}
    most = {r.seq: r.v for r in asof.carried(rows, updates, ["key"], "v", largest=True).collect()}
    assert most == {k: None if k < 2 else 7 for k in range(1, 20)}


def _payloads(df):
    return [(json.loads(r.payload), (r.type, r.iata, r.payload_type, r.channel_hash)) for r in df.collect()]


def test_event_payloads_have_the_published_shapes(spark):
    some = spark.createDataFrame([(1, "#bc"), (2, "#west")], "scope_id int, name string")
    seen = spark.createDataFrame(
        [("h", "o1", "obs", "YVR", T(1), 4, 0, 1, -90, 2.5, "mqtt1", "aabb", 2, 1, True, 1), ("h", "o2", "", "SEA", T(2), 4, 0, None, -80, 1.5, "mqtt2", "", 1, 0, False, 2)],
        "packet_hash string, observer_id string, observer_name string, iata string, heard_at timestamp, payload_type int, route_type int, scope_id int, rssi int, snr float, broker string, path_bytes string, hash_size int, hop_count int, is_first boolean, observation_count long",
    )
    (first, match), (second, _) = sorted(_payloads(events.observation_event_rows(seen, some)), key=lambda p: p[0]["packet"]["observationCount"])
    assert first == {
        "packetHash": "h",
        "packet": {"payloadType": 4, "payloadTypeName": "advert", "routeType": 0, "routeTypeName": "TRANSPORT_FLOOD", "isFirstObservation": True, "observationCount": 1, "scope": "#bc"},
        "observation": {"observerId": "o1", "observerName": "obs", "iata": "YVR", "heardAt": 1704067260000, "rssi": -90, "snr": 2.5, "sourceBroker": "mqtt1", "pathBytes": "aabb", "pathLength": {"raw": "41", "hashSize": 2, "hopCount": 1}, "propagationTimeMs": 0},
    }
    assert "scope" not in second["packet"] and second["observation"]["observerName"] == "" and second["observation"]["pathLength"]["raw"] == "00"
    assert match[0] == "packetObservation" and match[2:] == (4, "")
    advert = F.struct(F.lit("aa").alias("pubkey"), F.lit(2).alias("type"), F.col("lat").alias("lat"), F.lit(0).alias("lon"), F.lit("n").alias("name"))
    adverts = spark.createDataFrame([("YVR", T(3), 1_500_000, 1, 915.0, 250.0, 10), ("SEA", T(1), 0, None, 0.0, 0.0, 0)], "iata string, arrival_ts timestamp, lat int, scope_id int, radio_freq_mhz float, bandwidth_khz float, spread_factor int").withColumn("advert", advert)
    watching = spark.createDataFrame([("aa", T(2))], "public_key string, first_seen timestamp")
    shown = {p["iata"]: (p, m) for p, m in _payloads(events.node_event_rows(adverts, some, watching))}
    assert shown["YVR"] == (
        {"nodeId": "aa", "publicKey": "aa", "name": "n", "nodeType": 2, "nodeTypeName": "repeater", "iata": "YVR", "lat": 1.5, "lng": 0.0, "isObserver": True, "iatas": [{"iata": "YVR", "lastHeard": 1704067380000}], "defaultScope": "#bc", "radio": "915.0,250,10"},
        ("nodeUpdate", "YVR", 4, ""),
    )
    assert not {"lat", "lng", "defaultScope", "radio"} & set(shown["SEA"][0]) and shown["SEA"][0]["isObserver"] is False
    text = spark.createDataFrame([("h", "ab", "f1", "me", "hi", T(0), "YVR"), ("g", "ab", None, None, None, T(0), "YVR")], "packet_hash string, channel_hash string, key_fingerprint string, sender_name string, content string, sent_at timestamp, iata string")
    said = {p["packetHash"]: (p, m) for p, m in _payloads(events.message_event_rows(text))}
    assert said["h"][0] == {"channelId": int(hashlib.md5(b"ab:f1").hexdigest()[:15], 16), "channelHash": "ab", "packetHash": "h", "senderName": "me", "content": "hi", "sentAt": 1704067200000}
    assert said["h"][1] == ("channelMessage", "YVR", 0, "ab") and said["g"][0]["content"] == ""


def test_status_events_know_place_and_scopes_by_then(spark):
    some = spark.createDataFrame([(1, "#bc"), (2, "#west"), (3, "#old")], "scope_id int, name string")
    stats = F.struct(F.col("battery").alias("battery_mv"), F.col("seq").alias("uptime_secs"))
    status = spark.createDataFrame([(2, "o", T(2), "a/x:1", "me", "915,250,10,6", 4100), (6, "o", T(6), "", "", "bad", 0), (7, "p", T(7), None, None, None, None)], "seq long, pubkey string, arrival_ts timestamp, source string, origin string, radio string, battery int").withColumn("stats", stats)
    inserted = spark.createDataFrame([(1, "o", T(1), T(1), "YVR", 2), (3, "o", T(3), T(0), "SEA", 1), (8, "o", T(8), T(8), "YYC", 3)], "seq long, observer_id string, arrival_ts timestamp, heard_at timestamp, iata string, scope_id int")
    rows = events.with_observer_context(status, inserted, some)
    got = {p["lastStatusAt"]: (p, m) for p, m in _payloads(events.status_event_rows(rows))}
    assert got[1704067320000] == (
        {"observerId": "o", "displayName": "me", "observerType": "a/x:1", "iata": "YVR", "online": True, "radio": "915.0,250,10", "scopes": ["#west"], "batteryMv": 4100, "uptimeSeconds": 2, "lastStatusAt": 1704067320000},
        ("observerStatus", "YVR", 0, ""),
    )
    later, none = got[1704067560000][0], got[1704067620000]
    assert later["iata"] == "YVR" and later["scopes"] == ["#bc", "#west"] and not {"radio", "batteryMv", "observerType"} & set(later)
    assert none == ({"observerId": "p", "displayName": "", "online": True, "scopes": [], "uptimeSeconds": 7, "lastStatusAt": 1704067620000}, ("observerStatus", "", 0, ""))
    newest = events.fold_observer_newest(inserted.filter("seq < 8"))
    before = spark.createDataFrame([("o", 3)], "observer_id string, scope_id int")
    carried_on = events.with_observer_context(status, inserted.filter("seq = 8"), some, newest=newest, observer_scopes=before)
    assert {(r.seq, r.last_iata, tuple(r.scopes)) for r in carried_on.collect()} == {(2, "YVR", ("#old",)), (6, "YVR", ("#old",)), (7, None, ())}


def test_observer_names_are_those_of_their_time(spark):
    rows = spark.createDataFrame([(1, "o", T(1)), (3, "o", T(3)), (5, "o", T(5)), (5, "p", T(5))], "seq long, observer_id string, arrival_ts timestamp")
    status = spark.createDataFrame([(2, "o", T(2), "new"), (4, "o", T(4), "")], "seq long, pubkey string, arrival_ts timestamp, origin string")
    assert {(r.seq, r.observer_name) for r in events.with_observer_name(rows.filter("observer_id = 'o'"), status).collect()} == {(1, ""), (3, "new"), (5, "new")}
    stored = spark.createDataFrame([("o", "old"), ("p", None)], "public_key string, display_name string")
    assert sorted((r.seq, r.observer_id, r.observer_name) for r in events.with_observer_name(rows, status, stored=stored).collect()) == [(1, "o", "old"), (3, "o", "new"), (5, "o", "new"), (5, "p", "")]
