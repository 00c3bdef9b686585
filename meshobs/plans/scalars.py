"""Queries of the scalar functions and of the message envelopes, over values derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import ingest
from ..sources import messages
from .adapters import Tables
from .registry import query


def _all(df: DataFrame, row: str, /, **columns: Column) -> DataFrame:
    return df.select(row, *(c.alias(n) for n, c in columns.items()))


@query("SELECT c_custkey, md5(c_name) AS stripped, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS DOUBLE) / 4 WHEN 1 THEN CAST(c_custkey AS DOUBLE) ELSE 0.0 END AS number FROM customer")
def x1_x2_hex_and_numbers(t):
    name = F.md5("c_name")
    spaced = F.concat(F.upper(F.substring(name, 1, 6)), F.lit(" \t"), F.substring(name, 7, 32))
    key = F.col("c_custkey")
    text = F.when(key % 4 == 0, F.concat(F.lit('"'), (key / 4).cast("string"), F.lit('"'))).when(key % 4 == 1, key.cast("string")).when(key % 4 == 2, F.lit('"bad"'))
    return _all(t.customer, "c_custkey", stripped=X.to_hex(X.to_bytes(X.strip_hex(spaced))), number=X.parse_number(text))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'bridge' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN 'org/' WHEN 3 THEN 'custom-1.0' ELSE '' END AS observer_type FROM customer")
def x3_x4_observer_types(t):
    k = F.col("c_custkey") % 5
    source = F.when(k == 0, "org/bridge").when(k == 1, F.concat(F.lit("a/b/"), F.lower("c_mktsegment"), F.lit(":1.1:2"))).when(k == 2, "org/").when(k == 3, "")
    return _all(t.customer, "c_custkey", observer_type=X.infer_observer_type(source, F.when(k == 3, "custom-1.0")))


@query("""SELECT o_orderkey, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS le, CAST(o_orderkey % 65536 AS INT) AS back,
 format('{:02x}', o_orderkey % 256) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE substr(h, 7, 2) || substr(h, 5, 2) || '0100' END AS header, CAST(o_orderkey % 4 AS INT) AS route, CAST((o_orderkey // 4) % 16 AS INT) AS kind, CAST((o_orderkey // 64) % 4 AS INT) AS version
 FROM (SELECT o_orderkey, format('{:08x}', o_orderkey) AS h FROM orders)""")
def x5_x6_x7_bytes_and_headers(t):
    key, header = F.col("o_orderkey"), (F.col("o_orderkey") % 256).cast("int")
    codes = [F.when(key % 3 != 0, c) for c in ((key % 65536).cast("int"), F.lit(1))]
    return _all(t.orders, "o_orderkey", le=X.u32_le(key), back=X.u16_le(X.u32_le(key)), header=X.raw_header(header, *codes), route=X.header_route(header), kind=X.header_payload(header), version=X.header_version(header))


@query("""SELECT c_custkey, CAST(c_custkey % 16 AS INT) AS role, (c_custkey // 16) % 2 = 1 AS located, (c_custkey // 128) % 2 = 1 AS named, CASE WHEN (c_custkey // 16) % 2 = 1 THEN (c_custkey * 1000) / 1e6 END::DOUBLE AS degrees,
 concat_ws(',', CAST((CASE WHEN c_custkey % 256 > 127 THEN c_custkey % 256 - 256 ELSE c_custkey % 256 END / 4.0)::DOUBLE AS VARCHAR), '1.0') AS snr, CAST(1 << (c_custkey % 4)::INT AS INT) AS width, 4.0 + c_custkey % 3 AS volts,
 CASE WHEN c_custkey % 3 = 0 THEN '1.14.0+' WHEN c_custkey % 3 = 1 THEN '1.11.0+' END AS firmware FROM customer""")
def x11_x13_x15_x26_x27_flags(t):
    key = F.col("c_custkey")
    flags = (key % 256).cast("int")
    snr = F.array_join(F.transform(X.trace_snr(F.array(flags, F.lit(4))), lambda x: x.cast("string")), ",")
    return _all(
        t.customer, "c_custkey", role=X.advert_role(flags), located=X.advert_has(flags, "location"), named=X.advert_has(flags, "name"), degrees=X.advert_degrees(flags, key * 1000), snr=snr, width=X.trace_hash_width(flags),
        volts=X.battery_volts(((4 + key % 3) * 1000).cast("int")), firmware=X.min_firmware_version(key % 3 == 0, key % 3 < 2),
    )


@query("""SELECT event_id, CASE event_id % 5 WHEN 3 THEN ts + INTERVAL 20 MINUTE WHEN 4 THEN ts + INTERVAL 20 MINUTE ELSE ts END AS heard_at, make_timestamp((epoch_us(ts) // 900000000) * 900000000) AS slot FROM events""")
def x16_x17_times(t):
    """Times with an offset, without one, with more digits; one too far away, and one in no layout."""
    ts = F.col("ts").cast("timestamp")
    arrival = ts + F.expr("INTERVAL 20 MINUTES")
    bare = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    west = F.concat(F.date_format(ts - F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("-07:00"))
    k = F.col("event_id") % 5
    text = F.when(k == 0, west).when(k == 1, bare).when(k == 2, F.concat(bare, F.lit("00"))).when(k == 3, F.concat(bare, F.lit("Z"))).otherwise(F.date_format(ts - F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return _all(t.events, "event_id", heard_at=X.heard_at(text, arrival).cast("timestamp_ntz"), slot=X.truncate_ts(ts, 900).cast("timestamp_ntz"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 0 ELSE event_id % 100 + 0.5 END::DOUBLE AS freq, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 62.5 END::DOUBLE AS bw, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 12 END AS INT) AS sf FROM events")
def x18_radio(t):
    """Three parts make nothing, a bad part makes 0 of itself."""
    k = F.col("event_id")
    freq = F.when(k % 4 == 1, "x").otherwise(((k % 100) + 0.5).cast("string"))
    text = F.concat_ws(",", freq, F.lit(" 62.5"), (k % 12).cast("string"), F.when(k % 4 != 0, "5"))
    return t.events.select("event_id", X.parse_radio(text).alias("r")).select("event_id", F.col("r.freq").cast("double").alias("freq"), F.col("r.bw").cast("double").alias("bw"), "r.sf")


SCOPE_KEY = "84509cfe73d94f7f6a8299e6bcdb8a3c"
_PADS = [bytes(b ^ pad for b in bytes.fromhex(SCOPE_KEY).ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"""SELECT c_custkey, scope, substr(sha256(scope), 1, 32) AS key, substr(sha256(unhex(substr(sha256(scope), 1, 32))), 1, 16) AS fingerprint, c_name || 'x' AS clean,
 CASE CAST('0x' || substr(mac, 3, 2) || substr(mac, 1, 2) AS INT) WHEN 0 THEN 1 WHEN 65535 THEN 65534 ELSE CAST('0x' || substr(mac, 3, 2) || substr(mac, 1, 2) AS INT) END AS code
 FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN '$' || c_name ELSE '#' || c_name END AS scope, sha256(unhex('{_PADS[1]}' || sha256(unhex('{_PADS[0]}' || format('{{:02x}}', c_custkey % 16) || md5(c_name))))) AS mac FROM customer)""")
def x21_x22_x23_scopes_and_codes(t):
    k = F.col("c_custkey")
    name = X.normalize_scope_name(F.when(k % 3 == 0, F.concat(F.lit("$"), F.col("c_name"))).when(k % 3 == 1, F.concat(F.lit("#"), F.col("c_name"))).otherwise(F.col("c_name")))
    inner, outer = X.hmac_pads(F.lit(SCOPE_KEY))
    dirty = F.concat(F.col("c_name"), F.lit("\x00x"))
    return _all(
        t.customer, "c_custkey", scope=name, key=X.derive_scope_key(name), fingerprint=X.scope_fingerprint(X.derive_scope_key(name)), clean=X.sanitize(dirty.cast("binary")), code=X.transport_code(inner, outer, k % 16, F.md5("c_name")),
    )


@query("""SELECT packet_no, CASE WHEN trace_hops = 1 THEN '{"type":"PING","pathHashes":["aa"]}' ELSE '{"type":"TRACE","pathHashes":["aa","bb"]}' END AS retagged,
 CASE WHEN packet_no % 5 = 0 THEN '{"type":"GROUP_TEXT","decrypted":null}' ELSE '{"type":"GROUP_TEXT","decrypted":{"sender":"s","content":"hello","sentAt":' || (epoch_us(first_heard_at) // 1000) || '}}' END AS enriched FROM packets WHERE trace_tag IS NOT NULL""", "packets")
def x14_x32_payload_edits(t):
    rows = t.packets.filter("trace_tag IS NOT NULL")
    trace = F.when(F.col("trace_hops") == 1, '{"type":"TRACE","pathHashes":["aa"]}').otherwise('{"type":"TRACE","pathHashes":["aa","bb"]}')
    sent = F.when(F.col("packet_no") % 5 != 0, F.col("first_heard_at"))
    return _all(rows, "packet_no", retagged=X.retag_trace(trace), enriched=X.enrich_group_text(F.lit('{"type":"GROUP_TEXT","decrypted":null}'), F.lit("s"), F.lit("hello"), sent))


@query("""SELECT packet_no, CASE
 WHEN payload_type IN (0,1,2,8) THEN '{"raw":"' || packet_hash || '","type":"' || CASE payload_type WHEN 0 THEN 'REQUEST' WHEN 1 THEN 'RESPONSE' WHEN 2 THEN 'TEXT_MESSAGE' ELSE 'PATH' END || '","destinationHash":"' || substr(packet_hash,1,2) || '","sourceHash":"' || substr(packet_hash,3,2) || '","cipherMac":"' || substr(packet_hash,5,4) || '","ciphertext":"' || substr(packet_hash,9) || '","ciphertextLength":4,"decrypted":null}'
 WHEN payload_type IN (5,6) THEN '{"raw":"' || packet_hash || '","type":"' || CASE payload_type WHEN 5 THEN 'GROUP_TEXT' ELSE 'GROUP_DATA' END || '","channelHash":"' || substr(packet_hash,1,2) || '","cipherMac":"' || substr(packet_hash,5,4) || '","ciphertext":"' || substr(packet_hash,9) || '","ciphertextLength":4,"decrypted":null}'
 WHEN payload_type = 3 THEN '{"raw":"' || packet_hash || '","type":"ACK","checksum":"' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '"}'
 WHEN payload_type = 4 THEN '{"type":"ADVERT","raw":"' || packet_hash || '","publicKey":"' || origin_pubkey || '","timestamp":' || packet_no || ',"signature":"ab","appData":{"raw":"' || packet_hash || '","flags":{"raw":"' || f || '","deviceRole":2,"deviceRoleName":"repeater","hasLocation":' || located || ',"hasName":' || (NOT located) || ',"hasFeature1":false,"hasFeature2":false},"latitude":' || CASE WHEN located THEN '49.5' ELSE 'null' END || ',"longitude":' || CASE WHEN located THEN '-123.25' ELSE 'null' END || ',"feature1":null,"feature2":null,"name":' || CASE WHEN located THEN 'null' ELSE '"n' || origin_node || '"' END || '}}'
 WHEN payload_type = 7 THEN '{"raw":"' || packet_hash || '","type":"ANON_REQUEST","destination":' || (packet_no % 256) || ',"ephemeralPubKey":"' || origin_pubkey || '"}'
 WHEN payload_type = 9 THEN '{"raw":"' || packet_hash || '","type":"' || CASE WHEN trace_hops = 1 THEN 'PING' ELSE 'TRACE' END || '","traceTag":"' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '","authCode":7,"flags":0,"pathHashes":["' || array_to_string(list_transform(range(trace_hops), lambda x: 'aa'), '","') || '"],"snrValues":[1.0,-0.25]}'
 WHEN payload_type = 10 THEN '{"raw":"' || packet_hash || '","type":"MULTIPART","remaining":3,"wrappedType":2,"wrappedPayload":"' || substr(packet_hash,9) || '"}'
 ELSE '{"raw":"' || packet_hash || '","type":"CONTROL","flags":1,"data":"' || substr(packet_hash,9) || '"}' END AS payload
 FROM (SELECT *, format('{:08x}', packet_no) AS h, (packet_no // 12) % 2 = 0 AS located, CASE WHEN (packet_no // 12) % 2 = 0 THEN '12' ELSE '82' END AS f FROM packets)""", "packets")
def x33_payload_json(t):
    h, no = F.col("packet_hash"), F.col("packet_no")
    part = lambda a, n=100: F.substring(h, a, n)
    mac = {"mac": part(5, 4), "ciphertext": part(9)}
    located = F.floor(no / 12) % 2 == 0

    def struct(**fields: Column) -> Column:
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    null = F.lit(None).cast("int")
    decoded = {
        "envelope": struct(destination=part(1, 2), source=part(3, 2), **mac), "group": struct(channel_hash=part(1, 2), **mac), "ack": struct(crc=no), "anon": struct(destination=(no % 256).cast("int"), pubkey=F.col("origin_pubkey")),
        "advert": struct(pubkey=F.col("origin_pubkey"), type=F.lit(2), timestamp=no, signature=F.lit("ab"), app_data=h, flags=F.when(located, 0x12).otherwise(0x82), lat=F.lit(49_500_000), lon=F.lit(-123_250_000), feature1=null, feature2=null, name=F.concat(F.lit("n"), F.col("origin_node").cast("string"))),
        "trace": struct(tag=no, auth_code=F.lit(7).cast("long"), flags=F.lit(0), hashes=F.array_repeat(F.lit("aa"), F.col("trace_hops")), snr=F.array(F.lit(4), F.lit(255))),
        "multipart": struct(remaining=F.lit(3), wrapped_type=F.lit(2), wrapped_payload=part(9)), "control": struct(flags=F.lit(1), data=part(9)),
    }
    return _all(t.packets, "packet_no", payload=X.payload_json(F.col("payload_type"), h, decoded))


def _messages(t: Tables) -> DataFrame:
    """Messages as they come from a broker: every seventh is a status, some are broken."""
    k = F.col("event_id")
    kind = F.when(k % 11 == 0, "internal").when(k % 7 == 0, "status").otherwise("packets")
    place = F.lower(F.expr("substr('YVRYYJYYCYEGYOWYYZSEALHR', CAST(1 + 3*(user_id % 8) AS INT), 3)"))
    topic = F.concat_ws("/", F.when(k % 13 == 0, "other").otherwise(messages.TOPIC_ROOT), place, F.md5(F.col("user_id").cast("string")), kind)
    packet = F.when(k % 5 == 0, "not json").when(k % 5 == 1, '{"raw":"","len":"0"}').when(k % 5 == 2, '{"raw":"1g","len":"1"}').otherwise(
        F.concat(F.lit('{"raw":"11 00 '), F.upper(F.substring(F.md5(k.cast("string")), 1, 2)), F.lit('","timestamp":"x","len":"3","SNR":"-7.5","RSSI":-108}'))
    )
    status = F.concat(F.lit('{"source":"org/ha:1","origin":"n'), F.col("user_id").cast("string"), F.lit('","radio":"910.525,62.5,7,5","stats":{"uptime_secs":'), k.cast("string"), F.lit(',"battery_mv":4100}}'))
    return t.events.select(topic.alias("topic"), F.when(kind == "status", status).otherwise(packet).alias("payload"), F.lit("mqtt1").alias("broker"), F.col("ts").cast("timestamp").alias("arrival_ts"), k.alias("seq"))


@query("""SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'status' WHEN event_id % 5 = 0 THEN 'malformed JSON' WHEN event_id % 5 = 2 THEN 'bad hex' ELSE 'packet' END AS kind,
 CASE WHEN event_id % 7 = 0 OR event_id % 5 > 2 THEN substr('YVRYYJYYCYEGYOWYYZSEALHR', CAST(1 + 3*(user_id % 8) AS INT), 3) END AS iata, CASE WHEN event_id % 7 = 0 THEN 'n' || user_id || ':' || event_id || ':4100' WHEN event_id % 5 > 2 THEN '1100' || substr(md5(CAST(event_id AS VARCHAR)), 1, 2) || ':-7.5:-108' END AS content
 FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND NOT (event_id % 7 <> 0 AND event_id % 5 = 1)""")
def s2_s3_s4_envelopes(t):
    """Packets, statuses and rejects of one stream of messages; keep-alives and foreign topics are dropped."""
    found = ingest.split_messages(_messages(t))
    packets = found["packets"].select("seq", F.lit("packet").alias("kind"), "iata", F.concat_ws(":", "raw", "snr_text", "rssi_text").alias("content"))
    status = found["status"].select("seq", F.lit("status").alias("kind"), "iata", F.concat_ws(":", "origin", F.col("stats.uptime_secs").cast("string"), F.col("stats.battery_mv").cast("string")).alias("content"))
    null = F.lit(None).cast("string")
    return packets.unionByName(status).unionByName(found["rejects"].select("seq", F.col("reason").alias("kind"), null.alias("iata"), null.alias("content")))


@query("""SELECT event_id, '{"v":1,"type":"event","event":"nodeUpdate","data":{"n":' || event_id || '}}' AS value FROM events""")
def s9_event_json(t):
    rows = t.events.select("event_id", F.lit("nodeUpdate").alias("type"), F.to_json(F.struct(F.col("event_id").alias("n"))).alias("payload"))
    return messages.to_event_json(rows).select("event_id", "value")


@query("SELECT c_custkey, upper(c_mktsegment) || ',YVR' AS places, 2 AS n FROM customer")
def f2_place_lists(t):
    from ..operators.filters import parse_iatas_col

    found = parse_iatas_col(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(", yvr ,, ")))
    return t.customer.select("c_custkey", F.array_join(found, ",").alias("places"), F.size(found).alias("n"))
