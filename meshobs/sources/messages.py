"""The message stream: reading, splitting by topic, and unpacking envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X

MESSAGES = "topic string, payload string, broker string, arrival_ts timestamp, seq bigint"
PACKET = "raw string, timestamp string, len string, SNR string, RSSI string"
STATUS = (
    "source string, client_version string, model string, firmware_version string, origin string, radio string, "
    "stats struct<uptime_secs: bigint, battery_mv: int, noise_floor: float, queue_len: int, debug_flags: int, tx_air_secs: double, rx_air_secs: double, recv_errors: int>"
)
#: Fixed value: the first part of every topic.
TOPIC_ROOT = "meshcore"


def read_messages(spark: SparkSession, path: str, *, streaming: bool = False, fmt: str = "json", **options: str) -> DataFrame:
    """Messages as JSON lines or another file format, in batch or as a stream of files."""
    reader = spark.readStream if streaming else spark.read
    return reader.format(fmt).schema(MESSAGES).options(**options).load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, *, streaming: bool = True) -> DataFrame:
    """Messages that a bridge puts on Kafka as JSON; ``seq`` is the offset.  Needs the Kafka package on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    row = F.from_json(F.col("value").cast("string"), "topic string, payload string, broker string")
    return reader.load().select(row.alias("m"), F.col("timestamp").alias("arrival_ts"), F.col("offset").alias("seq")).select("m.*", "arrival_ts", "seq")


def parse_topic(messages: DataFrame, *, root: str = TOPIC_ROOT) -> DataFrame:
    """``iata, observer_pubkey, kind`` of topics ``root/place/key/kind``; other topics are dropped."""
    parts = F.split("topic", "/", 4)
    split = messages.withColumns({"iata": F.upper(F.get(parts, F.lit(1))), "observer_pubkey": F.lower(F.get(parts, F.lit(2))), "kind": F.get(parts, F.lit(3))})
    return split.filter((F.size(parts) == 4) & (F.get(parts, F.lit(0)) == root) & F.col("kind").isin("packets", "status"))


def parse_packet_envelope(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: packet messages with ``raw`` in hex and the envelope's texts; and the rejects with their reason.

    Keep-alives, with empty ``raw`` and a length of 0 or none, are neither.
    """
    rows = messages.filter("kind = 'packets'").withColumn("e", F.from_json("payload", PACKET))
    broken = F.col("e").isNull() | ~F.coalesce(F.col("payload"), F.lit("")).rlike(r"(?s)^\s*\{.*\}\s*$")
    raw = X.strip_hex(F.col("e.raw"))
    empty = F.coalesce(F.col("e.raw"), F.lit("")) == ""
    reason = (
        F.when(broken, "malformed JSON")
        .when(empty & F.coalesce(F.col("e.len"), F.lit("")).isin("0", ""), "keep-alive")
        .when(empty, "no packet")
        .when(raw.isNull(), "bad hex")
        .when(X.to_bytes(F.col("observer_pubkey")).isNull(), "bad key")
    )
    rows = rows.withColumn("reason", reason)
    texts = [F.col("e.timestamp").alias("timestamp_text"), F.col("e.RSSI").alias("rssi_text"), F.col("e.SNR").alias("snr_text")]
    ok = rows.filter("reason IS NULL").select("seq", "arrival_ts", "broker", "iata", "observer_pubkey", raw.alias("raw"), *texts)
    return ok, rows.filter("reason <> 'keep-alive'").select("seq", "topic", "payload", "broker", "reason")


def parse_status_envelope(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status messages with their fields; and the rejects."""
    rows = messages.filter("kind = 'status'").withColumn("e", F.from_json("payload", STATUS))
    broken = F.col("e").isNull() | ~F.coalesce(F.col("payload"), F.lit("")).rlike(r"(?s)^\s*\{.*\}\s*$")
    reason = F.when(broken, "malformed JSON").when(X.to_bytes(F.col("observer_pubkey")).isNull(), "bad key")
    rows = rows.withColumn("reason", reason)
    ok = rows.filter("reason IS NULL").select("seq", "arrival_ts", "broker", "iata", F.col("observer_pubkey").alias("pubkey"), "e.*")
    return ok, rows.filter("reason IS NOT NULL").select("seq", "topic", "payload", "broker", "reason")


def to_event_json(events: DataFrame) -> DataFrame:
    """One JSON text per event (``type, payload, ...``), as subscribers get it; ``payload`` is JSON."""
    head = F.concat(F.lit('{"v":1,"type":"event","event":'), F.to_json(F.struct("type")), F.lit(',"data":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
    return events.withColumn("value", F.regexp_replace(head, r'"event":\{"type":("[^"]*")\}', '"event":$1'))
