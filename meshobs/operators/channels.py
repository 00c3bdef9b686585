"""Channels and their messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .filters import between, equals, heard_in, limited, merge_by_key, page_by_id, page_desc, place_like
from .packets import packet_counts


def channel_candidates(packets: DataFrame, keys: DataFrame) -> DataFrame:
    """Per group text the first key in load order whose decryption succeeded.

    ``packets`` has ``packet_hash, channel_hash`` and ``opened_by``, the fingerprints of the keys that open it, as the decoder found them.
    """
    tried = packets.select("packet_hash", "channel_hash", F.explode("opened_by").alias("key_fingerprint")).join(keys, ["channel_hash", "key_fingerprint"])
    return tried.groupBy("packet_hash", "channel_hash").agg(F.min_by("key_fingerprint", "load_order").alias("key_fingerprint"), F.min_by("name", "load_order").alias("name"))


def fold_channels(group_texts: DataFrame, opened: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """A row per channel hash, and one per hash and key that opened a message.

    ``group_texts`` has ``packet_hash, channel_hash, arrival_ts``; ``opened`` ``packet_hash, channel_hash, key_fingerprint, name``.  The stored message
    count stays 0.
    """
    texts = group_texts.select("packet_hash", "channel_hash", "arrival_ts")
    bare = texts.select("channel_hash", F.lit(None).cast("string").alias("key_fingerprint"), F.lit(None).cast("string").alias("name"), "arrival_ts")
    keyed = texts.join(opened.select("packet_hash", "channel_hash", "key_fingerprint", "name"), ["packet_hash", "channel_hash"]).select(*bare.columns)
    new = bare.unionByName(keyed).groupBy("channel_hash", "key_fingerprint").agg(F.max("name").alias("name"), F.min("arrival_ts").alias("first_seen"), F.max("arrival_ts").alias("last_seen"))
    merged = merge_by_key(existing, new, ["channel_hash", "key_fingerprint"], {"name": "last_known", "first_seen": "min", "last_seen": "max"})
    tag = F.col("name").startswith("#")
    return merged.withColumns({"is_hashtag": F.coalesce(tag, F.lit(False)), "hashtag": F.when(tag, F.col("name")), "key_known": F.col("key_fingerprint").isNotNull(), "message_count": F.lit(0).cast("long")})


def fold_channel_messages(messages: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """The first message of each packet (``packet_hash, channel_hash, sender_name, content, sent_at, seq``), its text made valid."""
    rest = F.struct("channel_hash", F.coalesce("sender_name", F.lit("")).alias("sender_name"), F.coalesce("content", F.lit("")).alias("content"), "sent_at")
    new = messages.groupBy("packet_hash").agg(F.min_by(rest, "seq").alias("m")).select("packet_hash", "m.*")
    clean = new.withColumns({c: X.sanitize(F.col(c)) for c in ("sender_name", "content")})
    return merge_by_key(existing, clean, ["packet_hash"], dict.fromkeys(["channel_hash", "sender_name", "content", "sent_at"], "first"))


def mark_decrypted(packets: DataFrame, messages: DataFrame) -> DataFrame:
    """Packets with ``decrypted`` where there is a message."""
    flag = messages.select("packet_hash", F.lit(True).alias("decrypted")).dropDuplicates(["packet_hash"])
    return packets.drop("decrypted").join(flag, "packet_hash", "left").withColumn("decrypted", F.coalesce("decrypted", F.lit(False)))


def list_channels(channels: DataFrame, packets: DataFrame, obs: DataFrame, *, channel_hash: str | None = None, iata: str | None = None, cursor=None, limit: int | None = None) -> DataFrame:
    """Newest first; with a place those with traffic there; fingerprints show for hashtag channels only."""
    kept = equals(channels, channel_hash=channel_hash)
    if iata is not None:
        heard = packets.join(place_like(obs, "iata", iata).select("packet_hash"), "packet_hash", "left_semi")
        kept = kept.join(heard.select("channel_hash"), "channel_hash", "left_semi")
    shown = kept.withColumn("key_fingerprint", F.when(F.col("is_hashtag"), F.col("key_fingerprint")))
    return page_desc(shown, "last_seen", cursor=cursor, limit=limit, ties=["channel_hash", "name"])


def channel_detail(channels: DataFrame, messages: DataFrame) -> DataFrame:
    """Channels with the true number of messages beside the stored one."""
    counts = messages.groupBy("channel_hash").agg(F.count(F.lit(1)).alias("messages"))
    return channels.join(counts, "channel_hash", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def list_messages(
    messages: DataFrame, packets: DataFrame, obs: DataFrame, scopes: DataFrame, *, channel_id: int | None = None, channel_hash: str | None = None, since=None,
    iatas: Sequence[str] | None = None, scope: str | None = None, cursor: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Messages that were observed (in the places), newest id first, with their packet's count of observations."""
    found = _observed(messages, packets, obs, scopes, channel_id, channel_hash, since, iatas, scope)
    return page_by_id(found, cursor=cursor, limit=limit)


def messages_after(messages: DataFrame, packets: DataFrame, obs: DataFrame, scopes: DataFrame, *, after: int, iatas: Sequence[str] | None = None, limit: int | None = 100) -> DataFrame:
    """Messages after an id, oldest first."""
    found = _observed(messages, packets, obs, scopes, None, None, None, iatas, None)
    return limited(found.filter(F.col("id") > after).orderBy("id"), limit)


def _observed(messages, packets, obs, scopes, channel_id, channel_hash, since, iatas, scope) -> DataFrame:
    kept = between(equals(messages, channel_id=channel_id, channel_hash=channel_hash), "sent_at", since=since)
    kept = heard_in(kept, obs, "packet_hash", iatas).join(packet_counts(obs), "packet_hash")
    named = kept.join(packets.select("packet_hash", "scope_id"), "packet_hash").join(scopes.select("scope_id", F.col("name").alias("scope")), "scope_id", "left")
    return equals(named, scope=scope).select(
        "id", "channel_id", "channel_hash", "packet_hash", F.coalesce("sender_name", F.lit("")).alias("sender_name"), F.coalesce("content", F.lit("")).alias("content"),
        X.epoch_ms(F.col("sent_at")).alias("sent_ms"), "scope", "observation_count",
    )
