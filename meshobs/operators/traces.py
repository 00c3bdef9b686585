"""Trace packets: summaries by tag and routes merged over places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .filters import between, equals, heard_in, page_desc, trace_typed
from .resolve import candidates_by_prefix, count_candidates


def best_trace_payload(packets: DataFrame) -> DataFrame:
    """Per tag the payload with most hops, over all its packets; ties go to the smallest packet hash, no payload comes last."""
    hops = X.json_length(F.col("parsed_payload"), "pathHashes")
    ranked = packets.filter("trace_tag IS NOT NULL").withColumn("hops", F.coalesce(hops, F.lit(-1)))
    best = F.min(F.struct((-F.col("hops")).alias("fewest"), "packet_hash", "parsed_payload")).alias("b")
    found = ranked.groupBy("trace_tag").agg(best).select("trace_tag", F.col("b.parsed_payload").alias("best_payload"), F.greatest(-F.col("b.fewest"), F.lit(0)).alias("hops"))
    # The hashes and signal strengths of that payload; nothing can be read from another's.
    parts = F.from_json("best_payload", "pathHashes array<string>, snrValues array<float>")
    return found.withColumns({"path_hashes": parts["pathHashes"], "snr_values": parts["snrValues"]})


def trace_tags(
    packets: DataFrame, obs: DataFrame, scopes: DataFrame, *, iatas: Sequence[str] | None = None, scope: str | None = None, trace_type: str | None = None,
    since=None, until=None, cursor=None, limit: int | None = None,
) -> DataFrame:
    """Per tag first and last time, packets, places, type and best payload, newest first.

    Filters act on packets before they are grouped; without places packets that nobody observed count too.
    """
    kept = trace_typed(between(packets.filter("trace_tag IS NOT NULL"), "first_heard_at", since=since, until=until), trace_type)
    if scope is not None:
        kept = kept.join(F.broadcast(scopes.filter(F.col("name") == scope).select("scope_id")), "scope_id", "left_semi")
    kept = heard_in(kept, obs, "packet_hash", iatas)
    tags = kept.groupBy("trace_tag").agg(
        F.min("first_heard_at").alias("first_heard_at"), F.max("last_heard_at").alias("last_heard_at"), F.countDistinct("packet_hash").alias("packets"),
        F.max(X.json_field(F.col("parsed_payload"), "type")).alias("type"),
    )
    rows = obs.filter(F.col("iata").isin(list(iatas))) if iatas else obs
    heard = kept.select("packet_hash", "trace_tag").join(rows.select("packet_hash", "iata").distinct(), "packet_hash")
    places = heard.groupBy("trace_tag").agg(F.countDistinct("iata").alias("places"))
    found = tags.join(places, "trace_tag", "left").join(best_trace_payload(packets), "trace_tag", "left").withColumn("places", F.coalesce("places", F.lit(0)))
    return page_desc(found, "last_heard_at", cursor=cursor, limit=None if limit is None else limit - 1, ties=["trace_tag"])


def trace_detail(packets: DataFrame, obs: DataFrame, short_ids: DataFrame, nodes: DataFrame, *, tag: str | None = None) -> DataFrame:
    """``packet_hash, pos, hop, confidence, node_ids, iata, snr, candidates`` of each traced hop, merged over the places that heard the packet.

    ``snr`` is the hop's of ``trace_snr``, quarter decibels of signed bytes, where ``packets`` has that column and so many values.  Per hop the highest confidence wins (high, then ambiguous, then none), on ties the place that heard the packet first.  ``packets``
    has ``trace_hashes``, an array of hop hashes; a hash that is not as wide as ``trace_flags`` says resolves to nothing.
    """
    kept = equals(packets.filter("trace_tag IS NOT NULL"), trace_tag=tag)
    strengths = X.trace_snr(F.col("trace_snr")) if "trace_snr" in packets.columns else F.lit(None).cast("array<double>")
    hops = kept.select("packet_hash", "trace_flags", strengths.alias("snrs"), F.posexplode("trace_hashes").alias("pos", "raw_hop"))
    hops = hops.withColumn("snr", F.get("snrs", F.col("pos"))).drop("snrs")
    width = X.trace_hash_width(F.col("trace_flags"))
    hops = hops.withColumn("hop", F.when(F.length("raw_hop") == 2 * width, F.col("raw_hop")))
    places = obs.groupBy("packet_hash", "iata").agg(F.min(F.struct("heard_at", "id")).alias("heard"))
    resolved = count_candidates(hops.join(places, "packet_hash", "left"), short_ids, nodes)
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "ambiguous", 1).otherwise(2)
    best = F.min_by(F.struct("confidence", "iata", "candidates", F.col("hop").alias("known")), F.struct(rank.alias("rank"), "heard", "iata")).alias("b")
    chosen = resolved.groupBy("packet_hash", "pos", F.col("raw_hop").alias("hop")).agg(best, F.first("snr").alias("snr")).select("packet_hash", "pos", "hop", "snr", "b.*")
    # The candidates come last, so no aggregation carries their lists.
    ids = candidates_by_prefix(short_ids, nodes).withColumnRenamed("hop", "known")
    return chosen.join(ids, ["iata", "known"], "left").select("packet_hash", "pos", "hop", "confidence", "node_ids", "iata", "snr", "candidates")


def retag_pings(packets: DataFrame) -> DataFrame:
    """Stored trace payloads of one hop become PING."""
    trace = F.col("payload_type") == X.PAYLOAD_TRACE
    return packets.withColumn("parsed_payload", F.when(trace, X.retag_trace(F.col("parsed_payload"))).otherwise(F.col("parsed_payload")))
