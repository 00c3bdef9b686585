"""Scalar functions: each takes and returns columns and uses built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and aliases of the protocol's enumerations.
PAYLOAD_TYPES = {
    0: "request", 1: "response", 2: "text_message", 3: "acknowledgement", 4: "advert", 5: "group_text", 6: "group_data", 7: "anonymous_request",
    8: "path", 9: "trace", 10: "multipart", 11: "control", 12: "reserved", 13: "reserved", 14: "reserved", 15: "raw_custom",
}
PAYLOAD_ALIASES = {
    "request": 0, "req": 0, "response": 1, "txt_msg": 2, "txtmsg": 2, "text": 2, "direct": 2, "acknowledgement": 3, "ack": 3, "advertisement": 4, "advert": 4,
    "grp_txt": 5, "grptxt": 5, "group_text": 5, "group": 5, "grp_data": 6, "grpdata": 6, "group_data": 6, "data": 6, "anonymous_request": 7, "anon_req": 7,
    "anonreq": 7, "path": 8, "trace": 9, "multipart": 10, "multi-part": 10, "control": 11, "raw_custom": 15, "raw": 15, "custom": 15,
}
ROUTE_TYPES = {0: "TRANSPORT_FLOOD", 1: "FLOOD", 2: "DIRECT", 3: "TRANSPORT_DIRECT"}
NODE_TYPES = {1: "companion", 2: "repeater", 3: "room_server", 4: "sensor"}
NODE_ALIASES = {"companion": 1, "chat": 1, "repeater": 2, "room_server": 3, "room-server": 3, "roomserver": 3, "room": 3, "sensor": 4}
PAYLOAD_ADVERT, PAYLOAD_GROUP_TEXT, PAYLOAD_TRACE = 4, 5, 9
TRANSPORT_FLOOD, TRANSPORT_DIRECT = 0, 3
REPEATER, ROOM_SERVER = 2, 3


def _named(value: Column, names: dict[int, str], default: str) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), value.cast("int")), F.lit(default))


def _numbered(text: Column, aliases: dict[str, int], default: int) -> Column:
    pairs = [F.lit(x) for item in aliases.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(text))), F.lit(default))


#: A field of ``payload_json`` that a decrypted message replaces.
_NOT_DECRYPTED = '"decrypted":null'


# Hex and bytes


def strip_hex(text: Column) -> Column:
    """Hex digits in lower case without blanks; null if they are not whole bytes."""
    bare = F.regexp_replace(text, r"\s+", "")
    return F.lower(F.hex(F.try_to_binary(bare, F.lit("hex"))))


def to_bytes(hex_text: Column) -> Column:
    return F.try_to_binary(hex_text, F.lit("hex"))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def parse_number(text: Column) -> Column:
    """A JSON number or a quoted one, else 0."""
    return F.coalesce(F.regexp_replace(text, r'^"|"$', "").try_cast("double"), F.lit(0.0))


def normalize_observer_type(text: Column) -> Column:
    """What stands after the last ``/`` and before the first ``:``; the text itself if that is empty."""
    bare = F.substring_index(F.substring_index(text, "/", -1), ":", 1)
    return F.when(bare == "", text).otherwise(bare)


def infer_observer_type(source: Column, client_version: Column) -> Column:
    """From the source, else the client version, else empty."""
    first = F.when(F.coalesce(source, F.lit("")) != "", normalize_observer_type(source))
    return F.coalesce(first, F.when(F.coalesce(client_version, F.lit("")) != "", normalize_observer_type(client_version)), F.lit(""))


def swap_bytes(hex_text: Column, size: int) -> Column:
    """The ``size`` bytes of a hex text in reverse order."""
    return F.concat(*(F.substring(hex_text, 2 * i + 1, 2) for i in reversed(range(size))))


def u32_le(number: Column) -> Column:
    """An unsigned 32-bit number as 8 hex digits, least byte first."""
    return swap_bytes(F.lpad(F.lower(F.hex(number.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), 4)


def u16_le(hex_text: Column, at: int = 0) -> Column:
    """The unsigned 16-bit number at byte ``at`` of a hex text, least byte first."""
    return F.conv(F.concat(F.substring(hex_text, 2 * at + 3, 2), F.substring(hex_text, 2 * at + 1, 2)), 16, 10).cast("int")


def region_codes(code_1: Column, code_2: Column) -> tuple[Column, Column]:
    """Region and sub-region of a packet's transport codes; null if absent."""
    return code_1.cast("int"), code_2.cast("int")


def raw_header(header: Column, code_1: Column, code_2: Column) -> Column:
    """The header byte, and after it the transport codes where there are some."""

    def le(code: Column) -> Column:
        return swap_bytes(F.lpad(F.lower(F.hex(code.cast("long"))), 4, "0"), 2)

    return F.concat(F.lpad(F.lower(F.hex(header.cast("long"))), 2, "0"), F.coalesce(F.concat(le(code_1), le(code_2)), F.lit("")))


def header_route(header: Column) -> Column:
    """Bits 0 and 1."""
    return header.bitwiseAND(3)


def header_payload(header: Column) -> Column:
    """Bits 2 to 5."""
    return F.shiftrightunsigned(header, 2).bitwiseAND(15)


def header_version(header: Column) -> Column:
    """Bits 6 and 7."""
    return F.shiftrightunsigned(header, 6).bitwiseAND(3)


def payload_type_name(value: Column) -> Column:
    """X8."""
    return _named(value, PAYLOAD_TYPES, "unknown")


def payload_type_from_string(text: Column) -> Column:
    """-1 if unknown."""
    return _numbered(text, PAYLOAD_ALIASES, -1)


def route_type_name(value: Column) -> Column:
    """X9."""
    return _named(value, ROUTE_TYPES, "unknown")


def node_type_name(value: Column) -> Column:
    """X10."""
    return _named(value, NODE_TYPES, "unknown")


def node_type_from_string(text: Column) -> Column:
    """0 if unknown."""
    return _numbered(text, NODE_ALIASES, 0)


def advert_role(flags: Column) -> Column:
    """X11: the low nibble."""
    return flags.bitwiseAND(15)


def advert_has(flags: Column, what: str) -> Column:
    """X11: ``location``, ``feature1``, ``feature2`` or ``name``."""
    bit = {"location": 0x10, "feature1": 0x20, "feature2": 0x40, "name": 0x80}[what]
    return flags.bitwiseAND(bit) != 0


def advert_degrees(flags: Column, micro: Column) -> Column:
    """X11: degrees, only where the flags say that there is a location."""
    return F.when(advert_has(flags, "location"), micro / 1e6)


def split_path(path_bytes: Column, size: Column) -> Column:
    """Consecutive pieces of ``size`` bytes of a hex text; a remainder is dropped."""
    width = 2 * size
    count = F.floor(F.length(path_bytes) / width).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(path_bytes, i * width + 1, width))
    return F.when((size > 0) & (count > 0), pieces).otherwise(F.array().cast("array<string>"))


def trace_snr(raw: Column) -> Column:
    """Quarter decibels of each byte, which is signed."""
    return F.transform(raw, lambda b: F.when(b > 127, b - 256).otherwise(b) / 4.0)


def trace_type(hops: Column) -> Column:
    """PING with one hop, else TRACE."""
    return F.when(F.size(hops) == 1, "PING").otherwise("TRACE")


def retag_trace(payload: Column) -> Column:
    """A trace payload of one hop rewritten as PING; others as they are."""
    inner = F.regexp_replace(payload, r'"type"\s*:\s*"TRACE"', '"type":"PING"')
    return F.when(F.json_array_length(F.get_json_object(payload, "$.pathHashes")) == 1, inner).otherwise(payload)


def trace_hash_width(flags: Column) -> Column:
    """Bytes of a hop hash."""
    return F.pow(F.lit(2), flags.bitwiseAND(3)).cast("int")


def heard_at(text: Column, arrival: Column, limit_s: int = 1800) -> Column:
    """The time in one of three layouts; the arrival time if none fits or it is over ``limit_s`` away.

    With an offset exactly six fractional digits are read; without one any number of them, and the time is UTC.
    """
    offset = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}[+-]\d\d:\d\d$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
    bare = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$"), F.regexp_replace(text, r"(\.\d{6})\d+$", "$1").try_cast("timestamp"))
    parsed = F.coalesce(offset, bare)
    gap = F.abs(F.unix_micros(parsed) - F.unix_micros(arrival))
    return F.when(parsed.isNull() | (gap > limit_s * 1_000_000), arrival).otherwise(parsed)


def truncate_ts(ts: Column, seconds: int = 3600) -> Column:
    """The start of the window of ``seconds`` that holds ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def parse_radio(text: Column) -> Column:
    """``freq, bw, sf, cr`` of exactly four parts; a bad part is 0, another number of parts makes all 0."""
    parts = F.split(F.coalesce(text, F.lit("")), ",")

    def part(i: int, kind: str) -> Column:
        return F.coalesce(F.when(F.size(parts) == 4, F.trim(F.get(parts, F.lit(i))).try_cast(kind)), F.lit(0).cast(kind))

    return F.struct(part(0, "float").alias("freq"), part(1, "float").alias("bw"), part(2, "int").alias("sf"), part(3, "int").alias("cr"))


def plain_number(value: Column) -> Column:
    """A number's shortest text, without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def radio_text(freq: Column, bw: Column, sf: Column) -> Column:
    """As the interface shows it; null unless all three are set."""
    return F.when(freq.isNotNull() & bw.isNotNull() & sf.isNotNull(), F.concat_ws(",", F.format_string("%.1f", freq.cast("double")), plain_number(bw), sf.cast("string")))


def radio_preset(freq: Column, bw: Column, sf: Column) -> Column:
    """The grouping key of presets; null if a part is."""
    return F.when(freq.isNotNull() & bw.isNotNull() & sf.isNotNull(), F.concat_ws(",", plain_number(freq), plain_number(bw), sf.cast("string")))


def derive_hashtag_key(tag: Column) -> Column:
    """Secret, channel hash and fingerprint of a hashtag channel."""
    bare = F.regexp_replace(tag, "^#", "")
    return channel_key(F.substring(F.sha2(F.concat(F.lit("#"), bare), 256), 1, 32))


def channel_key(secret: Column) -> Column:
    """Channel hash and fingerprint of a secret in hex."""
    digest = F.sha2(F.unhex(secret), 256)
    return F.struct(secret.alias("secret"), F.substring(digest, 1, 2).alias("channel_hash"), F.substring(digest, 1, 16).alias("key_fingerprint"))


def channel_id(channel_hash: Column, fingerprint: Column) -> Column:
    """A number for a channel's row: 60 bits of a digest of its hash and its key's fingerprint, if it has a key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", channel_hash, fingerprint)), 1, 15), 16, 10).cast("long")


def normalize_scope_name(name: Column) -> Column:
    """With ``#`` before it unless it starts with ``#`` or ``$``."""
    return F.when(name.rlike("^[#$]"), name).otherwise(F.concat(F.lit("#"), name))


def derive_scope_key(name: Column) -> Column:
    """16 bytes in hex."""
    return F.substring(F.sha2(name, 256), 1, 32)


def scope_fingerprint(key: Column) -> Column:
    """8 bytes in hex."""
    return F.substring(F.sha2(F.unhex(key), 256), 1, 16)


def sanitize(data: Column) -> Column:
    """Bytes as text; a run of invalid ones becomes one U+FFFD, NULs go."""
    text = F.make_valid_utf8(data.cast("string"))
    return F.replace(F.regexp_replace(text, "\ufffd+", "\ufffd"), F.lit("\x00"), F.lit(""))


def hmac_pads(key_hex: Column) -> tuple[Column, Column]:
    """The inner and outer first block of HMAC-SHA256 for a 16-byte key, as hex."""

    def pad(byte: int) -> Column:
        bytes_ = [F.lpad(F.lower(F.hex(F.conv(F.substring(key_hex, 2 * i + 1, 2), 16, 10).cast("long").bitwiseXOR(F.lit(byte)))), 2, "0") for i in range(16)]
        return F.concat(*bytes_, F.lit(f"{byte:02x}" * 48))

    return pad(0x36), pad(0x5C)


def transport_code(inner_pad: Column, outer_pad: Column, payload_type: Column, payload_hex: Column) -> Column:
    """First two bytes of the HMAC of type and payload as a little-endian number; 0 and 0xFFFF are avoided."""
    message = F.concat(inner_pad, F.lpad(F.lower(F.hex(payload_type.cast("long"))), 2, "0"), payload_hex)
    digest = F.sha2(F.unhex(F.concat(outer_pad, F.sha2(F.unhex(message), 256))), 256)
    code = u16_le(digest)
    return F.when(code == 0, 1).when(code == 0xFFFF, 0xFFFE).otherwise(code)


def epoch_ms(ts: Column) -> Column:
    """X24."""
    return F.unix_millis(ts.cast("timestamp"))


def key_prefix(public_key: Column, size: int) -> Column:
    """The first ``size`` bytes of a key in hex."""
    return F.substring(public_key, 1, 2 * size)


def battery_volts(millivolts: Column) -> Column:
    """Null when 0."""
    return F.when(millivolts != 0, millivolts / 1000.0)


def min_firmware_version(paths: Column, traces: Column) -> Column:
    """X27."""
    return F.when(paths, "1.14.0+").when(traces, "1.11.0+")


def online_status(last_status_at: Column, as_of: Column, minutes: int = 5) -> Column:
    """Online if the last status is less than ``minutes`` old."""
    return F.when(last_status_at > as_of - F.make_interval(mins=F.lit(minutes)), "online").otherwise("offline")


def hop_confidence(candidates: Column) -> Column:
    """By the number of candidate nodes."""
    n = F.coalesce(candidates, F.lit(0))
    return F.when(n == 0, "none").when(n == 1, "high").otherwise("ambiguous")


def json_field(text: Column, name: str) -> Column:
    """X30."""
    return F.get_json_object(text, f"$.{name}")


def json_length(text: Column, name: str) -> Column:
    """Length of an array field, null if it is none."""
    return F.json_array_length(F.get_json_object(text, f"$.{name}"))


def first_position(array: Column, value: Column) -> Column:
    """From 1; null if the value is not there."""
    at = F.array_position(array, value)
    return F.when(at > 0, at)


def comes_before(array: Column, a: Column, b: Column) -> Column:
    """The first ``a`` stands before the first ``b``."""
    return F.coalesce(first_position(array, a) < first_position(array, b), F.lit(False))


def tail_from(array: Column, value: Column) -> Column:
    """The array from the first ``value`` on; all of it if the value is not there."""
    at = first_position(array, value)
    return F.when(at.isNull(), array).otherwise(F.slice(array, F.coalesce(at, F.lit(1)).cast("int"), F.greatest(F.size(array), F.lit(1))))


def enrich_group_text(payload: Column, sender: Column, content: Column, sent_at: Column) -> Column:
    """``decrypted`` filled from the message, where there is one and the payload is JSON."""
    message = F.to_json(F.struct(F.coalesce(sender, F.lit("")).alias("sender"), F.coalesce(content, F.lit("")).alias("content"), epoch_ms(sent_at).alias("sentAt")))
    body = F.regexp_replace(payload, r"\}\s*$", "")
    added = F.concat(body, F.when(body.rlike(r"\{\s*$"), "").otherwise(","), F.lit('"decrypted":'), message, F.lit("}"))
    joined = F.when(F.contains(payload, F.lit(_NOT_DECRYPTED)), F.replace(payload, F.lit(_NOT_DECRYPTED), F.concat(F.lit('"decrypted":'), message))).otherwise(added)
    return F.when(sent_at.isNotNull() & payload.rlike(r"^\s*\{.*\}\s*$") & F.get_json_object(payload, "$.decrypted").isNull(), joined).otherwise(payload)


#: Columns of the decoder that ``payload_json`` reads, by payload type, with the fields they need; bytes are hex text.
DECODED = {
    "envelope": "struct<destination:string,source:string,mac:string,ciphertext:string>", "group": "struct<channel_hash:string,mac:string,ciphertext:string>",
    "ack": "struct<crc:bigint>", "advert": "struct<pubkey:string,type:int,timestamp:bigint,signature:string,app_data:string,flags:int,lat:int,lon:int,feature1:int,feature2:int,name:string>",
    "anon": "struct<destination:int,pubkey:string>", "trace": "struct<tag:bigint,auth_code:bigint,flags:int,hashes:array<string>,snr:array<int>>",
    "multipart": "struct<remaining:int,wrapped_type:int,wrapped_payload:string>", "control": "struct<flags:int,data:string>",
}
# The names of kinds in the JSON.
ENVELOPES = {0: "REQUEST", 1: "RESPONSE", 2: "TEXT_MESSAGE", 8: "PATH"}
GROUPS = {5: "GROUP_TEXT", 6: "GROUP_DATA"}


def _json(**fields: Column) -> Column:
    """Fields that are unknown stay, as null."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def payload_json(payload_type: Column, raw: Column, decoded: dict[str, Column]) -> Column:
    """JSON of the decoded fields by payload type; null where the decoder could not read the payload, raw bytes for types without fields.

    ``decoded`` has a struct column for each name of ``DECODED``; names left out count as not read.
    """
    d = {n: decoded.get(n, F.lit(None).cast(kind)) for n, kind in DECODED.items()}
    n_bytes = lambda c: F.floor(F.length(c) / 2).cast("int")
    a, e, g, t, m = d["advert"], d["envelope"], d["group"], d["trace"], d["multipart"]
    flags = a["flags"]
    shown = {"hasLocation": "location", "hasName": "name", "hasFeature1": "feature1", "hasFeature2": "feature2"}
    flag_fields = F.struct(
        F.lpad(F.lower(F.hex(flags.cast("long"))), 2, "0").alias("raw"), advert_role(flags).alias("deviceRole"), node_type_name(advert_role(flags)).alias("deviceRoleName"), *(advert_has(flags, what).alias(n) for n, what in shown.items())
    )
    app_data = F.struct(
        a["app_data"].alias("raw"), flag_fields.alias("flags"), advert_degrees(flags, a["lat"]).alias("latitude"), advert_degrees(flags, a["lon"]).alias("longitude"),
        *(F.when(advert_has(flags, f), a[f]).alias(f) for f in ("feature1", "feature2")), F.when(advert_has(flags, "name"), a["name"]).alias("name"),
    )
    sealed = lambda s: {"cipherMac": s["mac"], "ciphertext": s["ciphertext"], "ciphertextLength": n_bytes(s["ciphertext"]), "decrypted": F.lit(None).cast("string")}
    kinds = {k: ("envelope", _json(raw=raw, type=F.lit(n), destinationHash=e["destination"], sourceHash=e["source"], **sealed(e))) for k, n in ENVELOPES.items()}
    kinds |= {k: ("group", _json(raw=raw, type=F.lit(n), channelHash=g["channel_hash"], **sealed(g))) for k, n in GROUPS.items()}
    kinds |= {
        3: ("ack", _json(raw=raw, type=F.lit("ACK"), checksum=u32_le(d["ack"]["crc"]))),
        PAYLOAD_ADVERT: ("advert", _json(type=F.lit("ADVERT"), raw=raw, publicKey=a["pubkey"], timestamp=a["timestamp"], signature=a["signature"], appData=app_data)),
        7: ("anon", _json(raw=raw, type=F.lit("ANON_REQUEST"), destination=d["anon"]["destination"], ephemeralPubKey=d["anon"]["pubkey"])),
        PAYLOAD_TRACE: ("trace", _json(raw=raw, type=trace_type(t["hashes"]), traceTag=u32_le(t["tag"]), authCode=t["auth_code"], flags=t["flags"], pathHashes=t["hashes"], snrValues=trace_snr(t["snr"]))),
        10: ("multipart", _json(raw=raw, type=F.lit("MULTIPART"), remaining=m["remaining"], wrappedType=m["wrapped_type"], wrappedPayload=m["wrapped_payload"])),
        11: ("control", _json(raw=raw, type=F.lit("CONTROL"), flags=d["control"]["flags"], data=d["control"]["data"])),
    }
    out = F.when(~payload_type.isin(*kinds), _json(type=F.lit("RAW"), raw=raw))
    for kind, (name, text) in kinds.items():
        out = out.when((payload_type == kind) & d[name].isNotNull(), text)
    return out
