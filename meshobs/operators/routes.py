"""Known routes: building, pruning, lists and searches within and across places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .filters import equals, limited, merge_by_key, page_desc
from .resolve import came, unique_paths, within


def build_known_routes(obs: DataFrame, intervals: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """``node_ids, iata, hash_prefix, hop_count, first_seen, last_seen, observation_count`` of paths of two hops or more that resolve uniquely when they come.

    ``obs`` holds every arrival, second copies included, with ``path_bytes`` and ``hash_size``; ``intervals`` is what ``unique_intervals`` gives.
    """
    found = obs.join(unique_paths(obs, intervals), ["iata", "path_bytes", "hash_size"]).filter(within(came(obs)))
    routes = found.groupBy("node_ids", "iata").agg(
        F.min_by("hash_prefix", F.struct("heard_at", "id")).alias("hash_prefix"), F.min("heard_at").alias("first_seen"), F.max("heard_at").alias("last_seen"), F.count(F.lit(1)).alias("observation_count")
    )
    routes = merge_by_key(existing, routes, ["node_ids", "iata"], {"hash_prefix": "first", "first_seen": "min", "last_seen": "max", "observation_count": "sum"})
    return routes.withColumn("hop_count", F.size("node_ids"))


def with_route_id(routes: DataFrame) -> DataFrame:
    """``id`` from the key, the same in every run."""
    return routes.withColumn("id", F.xxhash64("iata", "node_ids"))


def expand_hops(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Routes with ``hops``, an ordered array of ``pos, node_id, hash, name, public_key``; unknown nodes have nulls."""
    hops = routes.select("id", F.posexplode(F.arrays_zip("node_ids", "hash_prefix")).alias("pos", "h")).select("id", "pos", F.col("h.node_ids").alias("node_id"), F.col("h.hash_prefix").alias("hash"))
    named = hops.join(nodes.select("node_id", "name", "public_key"), "node_id", "left")
    listed = named.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", "hash", "name", "public_key"))).alias("hops"))
    return routes.join(listed, "id", "left")


def list_routes(routes: DataFrame, nodes: DataFrame, *, iata: str | None = None, hop_count: int | None = None, cursor=None, limit: int | None = None) -> DataFrame:
    """Newest first."""
    page = page_desc(equals(routes, iata=iata, hop_count=hop_count), "last_seen", cursor=cursor, limit=None if limit is None else limit - 1, ties=["iata", "node_ids"])
    return expand_hops(page, nodes).orderBy(F.desc("last_seen"), "iata", "node_ids")


def search_routes(routes: DataFrame, nodes: DataFrame, *, iata: str, from_hash: str, to_hash: str, limit: int | None = None) -> DataFrame:
    """The part from the first ``from_hash`` to the first ``to_hash`` of routes where that comes later; short full routes first."""
    found = routes.filter((F.col("iata") == iata) & X.comes_before(F.col("hash_prefix"), F.lit(from_hash), F.lit(to_hash)))
    start, end = (F.array_position("hash_prefix", F.lit(h)).cast("int") for h in (from_hash, to_hash))
    cut = found.withColumns({"start": start, "size": end - start + 1, "full_hop_count": F.col("hop_count")})
    cut = cut.withColumns({c: F.slice(c, F.col("start"), F.col("size")) for c in ("node_ids", "hash_prefix")}).withColumn("hop_count", F.col("size")).drop("start", "size")
    return expand_hops(limited(cut.orderBy("full_hop_count", F.desc("last_seen"), "node_ids"), limit), nodes).orderBy("full_hop_count", F.desc("last_seen"), "node_ids")


def routes_by_node(routes: DataFrame, nodes: DataFrame, *, iata: str, node_id) -> DataFrame:
    """Routes of a place through a node."""
    found = routes.filter((F.col("iata") == iata) & F.array_contains("node_ids", F.lit(node_id)))
    return expand_hops(found, nodes).orderBy("hop_count", F.desc("last_seen"), "node_ids")


def _only_node(short_ids: DataFrame, nodes: DataFrame, iata: str, prefix: str) -> DataFrame:
    """The node of a prefix in a place, if there is exactly one."""
    relays = nodes.filter(F.col("node_type").isin(X.REPEATER, X.ROOM_SERVER)).select("node_id")
    hit = short_ids.filter((F.col("iata") == iata) & (F.substring("prefix_4", 1, len(prefix)) == prefix)).join(relays, "node_id", "left_semi")
    return hit.agg(F.min("node_id").alias("node_id"), F.countDistinct("node_id").alias("n")).filter("n = 1").select("node_id")


def cross_iata_routes(routes: DataFrame, edges: DataFrame, short_ids: DataFrame, nodes: DataFrame, *, from_hash: str, from_iata: str, to_hash: str, to_iata: str) -> DataFrame:
    """``source, cross_from, cross_to, target, total_hops``: ways from a node of one place to a node of another over one edge between places.

    Both ends must resolve to one node.  A way runs along a route of the first from its start to a hop that has an edge recorded in
    the other place, over that edge, and along the other's shortest route through the edge's end.
    """
    ends = [_only_node(short_ids, nodes, p, h) for p, h in ((from_iata, from_hash), (to_iata, to_hash))]
    sources = routes.filter(F.col("iata") == from_iata).join(F.broadcast(ends[0]), F.array_contains("node_ids", F.col("node_id")))  # one row at most
    targets = routes.filter(F.col("iata") == to_iata).join(F.broadcast(ends[1]), F.array_contains("node_ids", F.col("node_id")))  # one row at most
    hops = sources.select("node_ids", F.posexplode("node_ids").alias("pos", "cross_from"))
    crossed = hops.join(edges.filter(F.col("iata") == to_iata).select(F.col("node_id").alias("cross_from"), F.col("neighbor_id").alias("cross_to")), "cross_from")
    ranked = targets.select("hop_count", (-X.epoch_ms(F.col("last_seen"))).alias("age"), F.col("node_ids").alias("route"), F.col("node_id").alias("wanted"))
    lying = ranked.withColumn("cross_to", F.explode("route")).groupBy("cross_to", "wanted").agg(F.min(F.struct("hop_count", "age", "route")).alias("best"))
    joined = crossed.join(lying, "cross_to").withColumn("route", F.col("best.route"))
    at, last = F.array_position("route", F.col("cross_to")).cast("int"), F.array_position("route", F.col("wanted")).cast("int")
    cut = joined.withColumns({"at": at, "last": last}).filter("at <= last")
    out = cut.select(F.slice("node_ids", 1, F.col("pos") + 1).alias("source"), "cross_from", "cross_to", F.slice("route", F.col("at"), F.col("last") - F.col("at") + 1).alias("target")).distinct()
    return out.withColumn("total_hops", F.size("source") + 1 + F.size("target")).orderBy("total_hops", "source", "target")


def reconfirm_routes(routes: DataFrame, short_ids: DataFrame, *, by_width: bool = False) -> DataFrame:
    """Routes without hops whose node has no short id in the place, or whose prefix equals more than one there.

    Prefixes are compared whole with four-byte ids, so shorter ones are never ambiguous unless ``by_width``.
    """
    hops = routes.select("id", "iata", F.explode(F.arrays_zip("node_ids", "hash_prefix")).alias("h")).select("id", "iata", F.col("h.node_ids").alias("node_id"), F.col("h.hash_prefix").alias("hop"))
    lost = hops.join(short_ids.select("node_id", "iata"), ["node_id", "iata"], "left_anti").select("id")
    widths = (1, 2, 3, 4) if by_width else (4,)
    prefixes = short_ids.select("iata", "node_id", F.explode(F.array(*(X.key_prefix(F.col("prefix_4"), n) for n in widths))).alias("hop"))
    shared = prefixes.groupBy("iata", "hop").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("iata", "hop")
    ambiguous = hops.join(shared, ["iata", "hop"], "left_semi").select("id")
    return routes.join(lost.union(ambiguous).distinct(), "id", "left_anti")
