"""Message envelopes, topics and configured dimensions."""

import datetime as dt

from meshobs.operators import filters, ingest
from meshobs.sources import dims, messages

NOW = dt.datetime(2026, 1, 2, 10, 5)


def rows(spark, *items):
    return spark.createDataFrame([(t, p, "mqtt1", NOW, k) for k, (t, p) in enumerate(items)], messages.MESSAGES)


def test_envelopes(spark):
    df = rows(
        spark,
        (f"{messages.TOPIC_ROOT}/YVR/aabb01/packets", '{"raw":"11 00 AB","timestamp":"2026-01-02T03:04:05.123456-07:00","len":"3","SNR":"-7.5","RSSI":-108}'),
        (f"{messages.TOPIC_ROOT}/YVR/aabb01/packets", '{"raw":"","len":"0"}'),
        (f"{messages.TOPIC_ROOT}/YVR/aabb01/status", '{"source":"org/bridge:1.1.0","origin":"roof","radio":"910.525,62.5,7,5","stats":{"uptime_secs":60,"battery_mv":4100,"noise_floor":-110}}'),
        (f"{messages.TOPIC_ROOT}/YVR/aabb01/internal", "{}"), ("other/YVR/aabb01/packets", '{"raw":"11"}'), (f"{messages.TOPIC_ROOT}/YVR/packets", "{}"),
        (f"{messages.TOPIC_ROOT}/YVR/aabb01/packets", "not json"), (f"{messages.TOPIC_ROOT}/YVR/aabb01/packets", '{"raw":"1g"}'), (f"{messages.TOPIC_ROOT}/YVR/zz/packets", '{"raw":"11"}'), (f"{messages.TOPIC_ROOT}/YVR/aabb01/packets", '{"raw":"","len":"5"}'),
    )
    found = ingest.split_messages(df)
    packets = found["packets"].collect()
    assert [(r.seq, r.raw, r.iata, r.snr_text, r.rssi_text) for r in packets] == [(0, "1100ab", "YVR", "-7.5", "-108")]
    status = found["status"].collect()
    assert [(r.seq, r.origin, r.stats.battery_mv) for r in status] == [(2, "roof", 4100)]
    assert {r.seq: r.reason for r in found["rejects"].collect()} == {6: "malformed JSON", 7: "bad hex", 8: "bad key", 9: "no packet"}


def test_read_messages_stream_and_batch(spark, tmp_path):
    rows(spark, (f"{messages.TOPIC_ROOT}/YVR/aa/packets", "{}")).write.json(str(tmp_path / "m"))
    assert messages.read_messages(spark, str(tmp_path / "m")).count() == 1
    q = messages.read_messages(spark, str(tmp_path / "m"), streaming=True).writeStream.format("memory").queryName("read_messages").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("read_messages").count() == 1


def test_event_json(spark):
    df = spark.createDataFrame([("nodeUpdate", '{"a":1}')], "type string, payload string")
    assert messages.to_event_json(df).first()["value"] == '{"v":1,"type":"event","event":"nodeUpdate","data":{"a":1}}'


def test_airports_and_allow_list(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,iata_code,iso_country,continent\n1, YVR ,CA,NA\n2,JFK,US,NA\n3,LHR,GB,EU\n4,GRU,BR,SA\n5,,CA,NA\n6,ABCD,CA,NA\n7,YVR,CA,NA\n")
    airports = dims.load_airports(spark, str(tmp_path / "a.csv"))
    assert sorted(r.iata for r in airports.collect()) == ["GRU", "JFK", "LHR", "YVR"]
    places = spark.createDataFrame([(p,) for p in ("YVR", "JFK", "LHR", "GRU", "XXX")], "iata string")
    kept = lambda **k: sorted(r.iata for r in filters.filter_allowed(places, airports, **k).collect())
    assert len(kept()) == 5 and kept(countries=["CA"]) == ["YVR"] and kept(continents=["NA"]) == ["JFK", "YVR"] and kept(countries=["CA"], continents=["EU"]) == ["LHR", "YVR"]


def test_dims(spark):
    scopes = {r.name: r for r in dims.scope_dim(spark, ["bc", "#bc", "$p"]).collect()}
    assert set(scopes) == {"#bc", "$p"} and scopes["#bc"].transport_key == "84509cfe73d94f7f6a8299e6bcdb8a3c" and scopes["#bc"].scope_id == 1
    keys = dims.key_dim(spark, ["a", "#a", "b"], [("own", "00" * 16)])
    assert keys.count() == 3
    regions, members = dims.region_dim(spark, [("west", "West", ["yvr", "YYJ"]), ("none", "None", [])])
    assert [r.iata for r in filters.region_iatas(regions, members, slug="west").collect()] == ["YVR", "YYJ"]
    assert filters.region_iatas(regions, members, region_id=1, slug="none").count() == 2


def test_parse_iatas():
    assert filters.parse_iatas("yvr") == ["YVR"] and filters.parse_iatas("yvr,yyj, yyc ,") == ["YVR", "YYJ", "YYC"]
    assert filters.parse_iatas("yvr", "sea") == ["YVR"] and filters.parse_iatas(None, "sea") == ["SEA"] and filters.parse_iatas(None) is None
