"""Golden cases of the scalar functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from meshobs.functions import expr as X

from reference_values import python_transport_code


def value(spark, column, **cols):
    row = spark.range(1)
    for name, v in cols.items():
        row = row.withColumn(name, v if not isinstance(v, (str, int, float, bool, list, type(None))) else F.lit(v))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [("3.14", 3.14), ('"42.5"', 42.5), ("", 0.0), ('"notanumber"', 0.0), ("7", 7.0), (None, 0.0)])
def test_parse_number(spark, text, want):
    assert value(spark, X.parse_number(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("org/bridge-ha", "bridge-ha"), ("bridge:1.1.0", "bridge"), ("org/bridge", "bridge"), ("bridge", "bridge"), ("", ""), ("org/", "org/")])
def test_normalize_observer_type(spark, text, want):
    assert value(spark, X.normalize_observer_type(F.lit(text))) == want


@pytest.mark.parametrize("source, version, want", [("org/ha", "some", "ha"), ("", "custom-1.0", "custom-1.0"), ("", "", ""), (None, None, "")])
def test_infer_observer_type(spark, source, version, want):
    assert value(spark, X.infer_observer_type(F.lit(source).cast("string"), F.lit(version).cast("string"))) == want


@pytest.mark.parametrize("number, want", [(0x01020304, "04030201"), (0, "00000000"), (0xDEADBEEF, "efbeadde")])
def test_u32_le(spark, number, want):
    assert value(spark, X.u32_le(F.lit(number).cast("long"))) == want


def test_names(spark):
    names = ["request", "response", "text_message", "acknowledgement", "advert", "group_text", "group_data", "anonymous_request", "path", "trace", "multipart", "control", "reserved", "reserved", "reserved", "raw_custom"]
    rows = spark.range(17).select(X.payload_type_name(F.col("id")).alias("n")).collect()
    assert [r["n"] for r in rows] == [*names, "unknown"]
    for text, want in {"req": 0, "txtmsg": 2, "text": 2, "direct": 2, "ack": 3, "ADVERT": 4, "grp_txt": 5, "group": 5, "path": 8, "trace": 9, "multi-part": 10, "control": 11, "raw": 15, "": -1, "garbage": -1}.items():
        assert value(spark, X.payload_type_from_string(F.lit(text))) == want, text
    assert [value(spark, X.route_type_name(F.lit(k))) for k in (1, 2, 0, 3, 99)] == ["FLOOD", "DIRECT", "TRANSPORT_FLOOD", "TRANSPORT_DIRECT", "unknown"]
    assert [value(spark, X.node_type_name(F.lit(k))) for k in (1, 2, 3, 4, 0, 99)] == ["companion", "repeater", "room_server", "sensor", "unknown", "unknown"]
    assert [value(spark, X.node_type_from_string(F.lit(t))) for t in ("chat", "room-server", "roomserver", "room", "REPEATER", "garbage")] == [1, 3, 3, 3, 2, 0]


def test_scopes_and_keys(spark):
    assert [value(spark, X.normalize_scope_name(F.lit(n))) for n in ("#bc", "$bc", "bc", "")] == ["#bc", "$bc", "#bc", "#"]
    assert value(spark, X.derive_scope_key(F.lit("#bc"))) == "84509cfe73d94f7f6a8299e6bcdb8a3c"
    got = value(spark, X.derive_hashtag_key(F.lit("public")))
    secret = hashlib.sha256(b"#public").digest()[:16]
    assert got.secret == secret.hex() and got.channel_hash == hashlib.sha256(secret).hexdigest()[:2] and got.key_fingerprint == hashlib.sha256(secret).hexdigest()[:16]


def test_transport_code(spark):
    import hmac

    key = bytes.fromhex("84509cfe73d94f7f6a8299e6bcdb8a3c")
    inner, outer = X.hmac_pads(F.lit(key.hex()))
    assert value(spark, X.transport_code(inner, outer, F.lit(4), F.lit(b"hello".hex()))) == 15383 == python_transport_code(key, 4, b"hello")
    for k in range(20):
        text = f"payload {k}".encode()
        want = int.from_bytes(hmac.new(key, bytes([k]) + text, hashlib.sha256).digest()[:2], "little")
        assert value(spark, X.transport_code(inner, outer, F.lit(k), F.lit(text.hex()))) == want


def test_paths_and_traces(spark):
    assert value(spark, X.split_path(F.lit("aabbccddee"), F.lit(2))) == ["aabb", "ccdd"]
    assert value(spark, X.split_path(F.lit(""), F.lit(1))) == [] and value(spark, X.split_path(F.lit("aa"), F.lit(0))) == []
    assert value(spark, X.trace_snr(F.array(F.lit(4), F.lit(255), F.lit(128)))) == [1.0, -0.25, -32.0]
    assert [value(spark, X.trace_hash_width(F.lit(k))) for k in range(5)] == [1, 2, 4, 8, 1]
    assert value(spark, X.retag_trace(F.lit('{"type":"TRACE","pathHashes":["aa"]}'))) == '{"type":"PING","pathHashes":["aa"]}'
    assert '"TRACE"' in value(spark, X.retag_trace(F.lit('{"type":"TRACE","pathHashes":["aa","bb"]}')))


def test_tail_from(spark):
    array = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert value(spark, X.tail_from(array, F.lit("b"))) == ["b", "c"]
    assert value(spark, X.tail_from(array, F.lit("a"))) == ["a", "b", "c"] == value(spark, X.tail_from(array, F.lit("x")))
    assert value(spark, X.tail_from(F.array().cast("array<string>"), F.lit("x"))) == []
    assert value(spark, X.comes_before(array, F.lit("a"), F.lit("c"))) and not value(spark, X.comes_before(array, F.lit("c"), F.lit("a")))


@pytest.mark.parametrize(
    "text, want",
    [
        ("2026-01-02T03:04:05.123456-07:00", "2026-01-02 10:04:05.123456"), ("2026-01-02T10:04:05.123456", "2026-01-02 10:04:05.123456"), ("2026-01-02T10:04:05", "2026-01-02 10:04:05"),
        ("2026-01-02T10:04:05.5", "2026-01-02 10:04:05.5"), ("2026-01-02T10:04:05Z", "2026-01-02 10:10:00"), ("garbage", "2026-01-02 10:10:00"), (None, "2026-01-02 10:10:00"),
        ("2026-01-02T09:00:00", "2026-01-02 10:10:00"), ("2026-01-02T03:04:05.123-07:00", "2026-01-02 10:10:00"),
    ],
)
def test_heard_at(spark, text, want):
    got = value(spark, X.heard_at(F.lit(text).cast("string"), F.lit("2026-01-02 10:10:00").cast("timestamp")).cast("string"))
    assert got == want


def test_radio(spark):
    assert tuple(value(spark, X.parse_radio(F.lit("910.525,62.5,7,5")))) == pytest.approx((910.525, 62.5, 7, 5))
    assert tuple(value(spark, X.parse_radio(F.lit("1,2,3")))) == (0, 0, 0, 0) and tuple(value(spark, X.parse_radio(F.lit("x,62.5,7,5")))) == (0, 62.5, 7, 5)
    assert value(spark, X.radio_preset(F.lit(915.0), F.lit(62.5), F.lit(7))) == "915,62.5,7"
    assert value(spark, X.radio_text(F.lit(910.525), F.lit(250.0), F.lit(10))) == "910.5,250,10" and value(spark, X.radio_text(F.lit(None).cast("float"), F.lit(1.0), F.lit(1))) is None


def test_header_and_flags(spark):
    header = F.lit(0b01_0101_10)
    assert [value(spark, f(header)) for f in (X.header_route, X.header_payload, X.header_version)] == [2, 5, 1]
    assert value(spark, X.raw_header(F.lit(0x11), F.lit(0x1234), F.lit(1))) == "1134120100" and value(spark, X.raw_header(F.lit(0x11), F.lit(None).cast("int"), F.lit(None).cast("int"))) == "11"
    assert value(spark, X.u16_le(F.lit("3412"))) == 0x1234
    assert value(spark, X.advert_degrees(F.lit(0x12), F.lit(49_000_000))) == 49.0 and value(spark, X.advert_degrees(F.lit(0x02), F.lit(49_000_000))) is None


def test_text(spark):
    assert value(spark, X.sanitize(F.unhex(F.lit("61fffe6200")))) == "a�b"
    assert value(spark, X.strip_hex(F.lit("11 00 AB"))) == "1100ab" and value(spark, X.strip_hex(F.lit("1g"))) is None
    got = value(spark, X.enrich_group_text(F.lit('{"type":"GROUP_TEXT"}'), F.lit("s"), F.lit('say "x"'), F.lit("2024-01-01 00:00:00").cast("timestamp")))
    import json

    assert json.loads(got) == {"type": "GROUP_TEXT", "decrypted": {"sender": "s", "content": 'say "x"', "sentAt": 1704067200000}}


def test_status_and_confidence(spark):
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    assert [value(spark, X.online_status(at(s), now)) for s in ("2024-01-01 00:06:00", "2024-01-01 00:05:00", None)] == ["online", "offline", "offline"]
    assert [value(spark, X.hop_confidence(F.lit(n).cast("int"))) for n in (0, 1, 2, None)] == ["none", "high", "ambiguous", "none"]
    assert value(spark, X.battery_volts(F.lit(4100))) == 4.1 and value(spark, X.battery_volts(F.lit(0))) is None
    assert [value(spark, X.min_firmware_version(F.lit(a), F.lit(b))) for a, b in ((True, True), (False, True), (False, False))] == ["1.14.0+", "1.11.0+", None]
