"""Transport scopes: usage counts and the matching of packets to scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .filters import filter_iatas

#: A scope's row has under a kilobyte, so what is broadcast stays under 10 MB.
MAX_SCOPES = 10_000


def _counted(scopes: DataFrame, *branches: tuple[DataFrame, str]) -> DataFrame:
    """Scopes with a count per branch, 0 where it has none; each branch is counted by itself, never in a joint product."""
    out = scopes.select("scope_id", F.col("name").alias("scope"))
    for df, name in branches:
        out = out.join(df, "scope_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def _distinct(df: DataFrame, of: str, name: str, scope: str = "scope_id") -> tuple[DataFrame, str]:
    known = df.filter(F.col(scope).isNotNull())
    return known.groupBy(F.col(scope).alias("scope_id")).agg(F.countDistinct(of).alias(name)), name


def scope_stats(scopes: DataFrame, packets: DataFrame, observer_scopes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct packets, observers and nodes of each scope."""
    return _counted(scopes, _distinct(packets, "packet_hash", "packets"), _distinct(observer_scopes, "observer_id", "observers"), _distinct(nodes, "node_id", "nodes", "default_scope_id"))


def _places(observer_scopes: DataFrame, obs: DataFrame) -> DataFrame:
    """Distinct (scope, observer, place) of the observers of a scope."""
    heard = obs.select("observer_id", "iata").distinct()
    return observer_scopes.select("scope_id", "observer_id").distinct().join(heard, "observer_id")


def scopes_by_iatas(scopes: DataFrame, observer_scopes: DataFrame, obs: DataFrame, nodes: DataFrame, *, iatas: Sequence[str] | None = None) -> DataFrame:
    """Observers, nodes and places of each scope; with places only scopes whose observers heard something there.

    The count of nodes does not depend on the places.
    """
    heard = _places(observer_scopes, filter_iatas(obs, iatas))
    observers = heard if iatas else observer_scopes
    counted = _counted(scopes, _distinct(observers, "observer_id", "observers"), _distinct(nodes, "node_id", "nodes", "default_scope_id"), _distinct(heard, "iata", "places"))
    return counted.join(heard.select("scope_id").distinct(), "scope_id", "left_semi") if iatas else counted


def scope_detail(scopes: DataFrame, packets: DataFrame, observer_scopes: DataFrame, obs: DataFrame, nodes: DataFrame, *, name: str | None = None) -> DataFrame:
    """A10: all counts of a scope and its sorted places."""
    wanted = scopes if name is None else scopes.filter(F.col("name") == name)
    places = _places(observer_scopes, obs).filter("iata IS NOT NULL").groupBy("scope_id").agg(F.sort_array(F.collect_set("iata")).alias("iatas"))
    counted = scope_stats(wanted, packets, observer_scopes, nodes).join(places, "scope_id", "left")
    counted = counted.withColumn("iatas", F.coalesce("iatas", F.array().cast("array<string>")))
    return counted.withColumn("places", F.size("iatas").cast("long"))


def list_scopes(scopes: DataFrame) -> DataFrame:
    """R17."""
    return scopes.orderBy("name")


def match_scope(packets: DataFrame, scopes: DataFrame) -> DataFrame:
    """The first scope by name whose transport code is the packet's; only for transport routes.

    ``packets`` has one row per ``packet_hash`` with ``route_type, payload_type, raw_payload, transport_code_1``.  Scopes are a configured
    list, of which ``MAX_SCOPES`` at most are accepted; each carries its two HMAC blocks, so a code costs two hashes.  The list is tried against every
    packet where the packet lies, which takes neither a shuffle of packets nor a row per packet and scope between tasks.
    """
    if scopes.limit(MAX_SCOPES + 1).count() > MAX_SCOPES:
        raise ValueError(f"more than {MAX_SCOPES} scopes")
    inner, outer = X.hmac_pads(F.col("transport_key"))
    keyed = F.broadcast(scopes.select("scope_id", F.col("name").alias("scope"), inner.alias("_inner"), outer.alias("_outer")))
    routed = packets.filter(F.col("route_type").isin(X.TRANSPORT_FLOOD, X.TRANSPORT_DIRECT) & F.col("transport_code_1").isNotNull())
    code = X.transport_code(F.col("_inner"), F.col("_outer"), F.col("payload_type"), F.col("raw_payload"))
    tried = routed.select("packet_hash", "payload_type", "raw_payload", "transport_code_1").join(keyed, code == F.col("transport_code_1"))
    first = tried.groupBy("packet_hash").agg(F.min_by("scope_id", "scope").alias("scope_id"), F.min("scope").alias("scope"))
    return packets.join(first, "packet_hash", "left")
