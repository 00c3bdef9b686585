"""All queries of the library by name, and the SQL that each must equal.

Queries run the operators over domain tables derived from the given ones and flatten arrays to text, so that results compare
column by column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import channels, filters, ingest, maintenance, neighbors, nodes, observers, packets, resolve, routes, scopes, sketches, stats, traces
from ..sources import dims
from ..streaming import jobs
from .adapters import AS_OF, Tables, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *views: str) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register a function of the domain tables under its name, with its equivalent in SQL over ``views``."""

    def register(f: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views)
        return run

    return register


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def plain(df: DataFrame, ts: str) -> DataFrame:
    """With a time column that has no zone, as the given tables have."""
    return df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def joined(array: str) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",").alias(array)


T0 = f"TIMESTAMP '{AS_OF}'"
PLACES = ["YVR", "SEA"]
IN_PLACES = "('YVR','SEA')"

# -- statistics --------------------------------------------------------------------------------------------------------


@query(f"SELECT iata, date_trunc('hour', heard_at)::TIMESTAMP AS hour, count(*) AS observations, count(DISTINCT packet_hash) AS packets, count(DISTINCT observer_id) AS observers FROM obs WHERE heard_at > {T0} - INTERVAL 7 DAY GROUP BY ALL", "obs")
def a1_hourly_stats(t):
    return plain(stats.hourly_stats(t.obs, as_of=as_of()), "hour")


@query(f"SELECT iata, date_trunc('hour', heard_at)::TIMESTAMP AS hour, count(*) AS observations, count(DISTINCT packet_hash) AS packets, count(DISTINCT observer_id) AS observers FROM obs WHERE heard_at > {T0} - INTERVAL 7 DAY AND iata IN {IN_PLACES} AND date_trunc('hour', heard_at) >= {T0} - INTERVAL 48 HOUR GROUP BY ALL", "obs")
def a1_hourly_series(t):
    return plain(stats.hourly_series(stats.hourly_stats(t.obs, as_of=as_of()), as_of=as_of(), hours=48, iatas=PLACES), "hour")


@query(f"SELECT count(DISTINCT packet_hash) AS packets, count(*) AS observations, count(DISTINCT observer_id) AS observers, count(DISTINCT iata) AS places FROM obs WHERE heard_at > {T0} - INTERVAL 24 HOUR", "obs")
def a2_stats_overview(t):
    return stats.stats_overview(t.obs, as_of=as_of())


def _near(estimate: str, exact: str) -> Column:
    """Whether an estimate is within 5% of the exact number, or one off."""
    return (F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(1), F.col(exact) * 0.05)).alias(f"{exact}_near")


def sketched_hours(t: Tables) -> DataFrame:
    """Hours of two halves by id, merged: hours that both have are unions of sketches."""
    return sketches.merge_hours(sketches.hourly_sketches(t.obs.filter("id % 2 = 0")), sketches.hourly_sketches(t.obs.filter("id % 2 = 1")))


@query("SELECT iata, date_trunc('hour', heard_at)::TIMESTAMP AS hour, count(*) AS observations, count(DISTINCT packet_hash) AS packets, count(DISTINCT observer_id) AS observers, true AS packets_near, true AS observers_near FROM obs GROUP BY ALL", "obs")
def t3_sketched_hours(t):
    """Exact counts of each hour, and whether the merged sketches give them."""
    exact = stats.distinct_counts(t.obs.select("iata", F.date_trunc("hour", "heard_at").alias("hour"), "packet_hash", "observer_id"), ["iata", "hour"])
    guess = sketches.sketched_counts(sketched_hours(t), ["iata", "hour"]).select("iata", "hour", F.col("observations").alias("n"), F.col("packets").alias("p"), F.col("observers").alias("o"))
    both = exact.join(guess, ["iata", "hour"], "left")
    return plain(both.select("iata", "hour", F.col("n").alias("observations"), "packets", "observers", _near("p", "packets"), _near("o", "observers")), "hour")


@query(f"SELECT iata, count(*) AS observations, count(DISTINCT packet_hash) AS packets, count(DISTINCT observer_id) AS observers, true AS packets_near, true AS observers_near FROM obs WHERE date_trunc('hour', heard_at) >= {T0} - INTERVAL 7 DAY GROUP BY iata", "obs")
def a2_sketched_week(t):
    """A week per place from hours alone, beside exact counts from rows."""
    since = as_of() - F.expr("INTERVAL 7 DAYS")
    exact = stats.distinct_counts(t.obs.filter(F.date_trunc("hour", "heard_at") >= since), ["iata"])
    guess = sketches.sketched_counts(sketched_hours(t), ["iata"], since=since).select("iata", F.col("observations").alias("n"), F.col("packets").alias("p"), F.col("observers").alias("o"))
    return exact.join(guess, "iata", "left").select("iata", F.col("n").alias("observations"), "packets", "observers", _near("p", "packets"), _near("o", "observers"))


NAMES = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in X.PAYLOAD_TYPES.items()) + ") AS names(payload_type, name)"


@query(f"SELECT payload_type, count(*) AS observations, name FROM obs JOIN packets USING (packet_hash) JOIN {NAMES} USING (payload_type) WHERE heard_at >= {T0} - INTERVAL 10 DAY GROUP BY payload_type, name", "obs", "packets")
def a3_payload_breakdown(t):
    return stats.payload_breakdown(t.obs, t.packets, since=as_of() - F.expr("INTERVAL 10 DAYS"))


TYPE_NAME = "CASE node_type WHEN 1 THEN 'companion' WHEN 2 THEN 'repeater' WHEN 3 THEN 'room_server' WHEN 4 THEN 'sensor' ELSE 'unknown' END"


@query(f"SELECT node_type, count(DISTINCT node_id) AS nodes, {TYPE_NAME} AS name FROM nodes GROUP BY node_type", "nodes")
def a4_node_types(t):
    return stats.node_types(t.nodes, t.node_iatas)


@query(f"SELECT node_type, count(DISTINCT node_id) AS nodes, {TYPE_NAME} AS name FROM nodes WHERE node_id IN (SELECT node_id FROM node_iatas WHERE iata IN {IN_PLACES}) GROUP BY node_type", "nodes", "node_iatas")
def a4_node_types_in_places(t):
    return stats.node_types(t.nodes, t.node_iatas, iatas=PLACES)


LAST = "SELECT observer_id, arg_max(iata, (heard_at, id)) AS iata FROM obs GROUP BY observer_id"


@query(f"WITH last AS ({LAST}) SELECT o.observer_id, count(*) AS observations, any_value(v.display_name) AS display_name, any_value(last.iata) AS iata FROM obs o JOIN observers v USING (observer_id) JOIN last ON last.observer_id = o.observer_id WHERE o.heard_at >= {T0} - INTERVAL 10 DAY GROUP BY o.observer_id ORDER BY observations DESC, o.observer_id LIMIT 10", "obs", "observers")
def a5_top_observers(t):
    return stats.top_observers(t.obs, t.observers, since=as_of() - F.expr("INTERVAL 10 DAYS"))


@query(f"SELECT node_id, name, node_type, iata, observation_count FROM node_iatas JOIN nodes USING (node_id) WHERE last_heard > {T0} - INTERVAL 7 DAY ORDER BY observation_count DESC, node_id, iata LIMIT 10", "node_iatas", "nodes")
def a6_top_nodes(t):
    return stats.top_nodes(t.node_iatas, t.nodes, as_of=as_of())


@query(f"WITH last AS ({LAST}) SELECT last.iata, preset, count(*) AS devices, 'observers' AS kind FROM observers JOIN last USING (observer_id) WHERE preset IS NOT NULL GROUP BY ALL UNION ALL SELECT iata, '915,250,10', count(*), 'nodes' FROM nodes JOIN node_iatas USING (node_id) WHERE node_type <> 1 GROUP BY iata", "obs", "observers", "nodes", "node_iatas")
def a7_radio_presets(t):
    radios = t.nodes.withColumn("preset", F.when(F.col("node_type") != 1, X.radio_preset(F.lit(915.0), F.lit(250.0), F.lit(10))))
    return stats.radio_presets(t.observers, t.obs, radios, t.node_iatas)


@query("""SELECT s.scope_id, s.name AS scope, (SELECT count(DISTINCT packet_hash) FROM packets p WHERE p.scope_id = s.scope_id) AS packets,
 (SELECT count(DISTINCT observer_id) FROM observer_scopes o WHERE o.scope_id = s.scope_id) AS observers, (SELECT count(DISTINCT node_id) FROM nodes n WHERE n.default_scope_id = s.scope_id) AS nodes FROM scopes s""", "scopes", "packets", "observer_scopes", "nodes")
def a8_scope_stats(t):
    return scopes.scope_stats(t.scopes, t.packets, t.observer_scopes, t.nodes)


SCOPE_PLACES = "heard AS (SELECT DISTINCT x.scope_id, x.observer_id, o.iata FROM observer_scopes x JOIN obs o USING (observer_id) {where})"


def _scopes_by(where: str, observers_from: str, only: str) -> str:
    return f"""WITH {SCOPE_PLACES.format(where=where)} SELECT s.scope_id, s.name AS scope, (SELECT count(DISTINCT observer_id) FROM {observers_from} o WHERE o.scope_id = s.scope_id) AS observers,
 (SELECT count(DISTINCT node_id) FROM nodes n WHERE n.default_scope_id = s.scope_id) AS nodes, (SELECT count(DISTINCT iata) FROM heard h WHERE h.scope_id = s.scope_id) AS places FROM scopes s {only}"""


@query(_scopes_by("", "observer_scopes", ""), "scopes", "observer_scopes", "obs", "nodes")
def a9_scopes_by_iatas(t):
    return scopes.scopes_by_iatas(t.scopes, t.observer_scopes, t.obs, t.nodes)


@query(_scopes_by(f"WHERE o.iata IN {IN_PLACES}", "heard", "WHERE s.scope_id IN (SELECT scope_id FROM heard)"), "scopes", "observer_scopes", "obs", "nodes")
def a9_scopes_in_places(t):
    return scopes.scopes_by_iatas(t.scopes, t.observer_scopes, t.obs, t.nodes, iatas=PLACES)


@query(f"""WITH {SCOPE_PLACES.format(where='')} SELECT s.scope_id, s.name AS scope, (SELECT count(DISTINCT packet_hash) FROM packets p WHERE p.scope_id = s.scope_id) AS packets,
 (SELECT count(DISTINCT observer_id) FROM observer_scopes o WHERE o.scope_id = s.scope_id) AS observers, (SELECT count(DISTINCT node_id) FROM nodes n WHERE n.default_scope_id = s.scope_id) AS nodes,
 (SELECT count(DISTINCT iata) FROM heard h WHERE h.scope_id = s.scope_id) AS places, coalesce((SELECT string_agg(DISTINCT iata, ',' ORDER BY iata) FROM heard h WHERE h.scope_id = s.scope_id), '') AS iatas FROM scopes s""", "scopes", "packets", "observer_scopes", "obs", "nodes")
def a10_scope_detail(t):
    found = scopes.scope_detail(t.scopes, t.packets, t.observer_scopes, t.obs, t.nodes)
    return found.withColumn("iatas", F.array_join("iatas", ","))


TRACED_SQL = """traced AS (SELECT *, CASE WHEN trace_tag IS NOT NULL THEN '{"type":"' || CASE WHEN trace_hops = 1 THEN 'PING' ELSE 'TRACE' END || '","pathHashes":["' || replace(hashes, ',', '","') || '"],"snrValues":[' || snrs || ']}' END AS parsed_payload
 FROM (SELECT *, substr('aa,bb,cc,dd', 1, 3 * trace_hops - 1) AS hashes, substr('1.5,-0.25,-32.0,2.0', 1, CAST(substr('03091519', 2 * trace_hops - 1, 2) AS INT)) AS snrs FROM packets) q)"""


def traced(t: Tables) -> DataFrame:
    """Packets with a trace payload: JSON with one hash per hop."""
    return t.spark.sql(TRACED_SQL.removeprefix("traced AS (")[:-1].replace("FROM packets", "FROM {packets}").replace("'{\"type\"", "'{{\"type\"").replace("']}'", "']}}'"), packets=t.packets)


def _tags(df: DataFrame) -> DataFrame:
    """With the best payload's hashes and signal strengths as text."""
    return df.withColumns({"hashes": F.array_join("path_hashes", ","), "snrs": F.array_join(F.transform("snr_values", lambda x: x.cast("string")), ",")}).drop("best_payload", "path_hashes", "snr_values")


def _trace_tags(where: str) -> str:
    return f"""WITH {TRACED_SQL} SELECT k.trace_tag, min(k.first_heard_at) AS first_heard_at, max(k.last_heard_at) AS last_heard_at, count(DISTINCT k.packet_hash) AS packets,
 max(CASE WHEN k.trace_hops = 1 THEN 'PING' ELSE 'TRACE' END) AS type, count(DISTINCT o.iata) AS places, any_value(b.hops) AS hops, any_value(b.hashes) AS hashes, any_value(b.snrs) AS snrs
 FROM traced k LEFT JOIN obs o ON o.packet_hash = k.packet_hash JOIN (SELECT trace_tag, CAST(max(trace_hops) AS INT) AS hops, arg_min(hashes, (-trace_hops, packet_hash)) AS hashes, arg_min(snrs, (-trace_hops, packet_hash)) AS snrs FROM traced WHERE trace_tag IS NOT NULL GROUP BY trace_tag) b ON b.trace_tag = k.trace_tag
 WHERE k.trace_tag IS NOT NULL {where} GROUP BY k.trace_tag"""


@query(_trace_tags(""), "packets", "obs")
def a11_trace_tags(t):
    return _tags(traces.trace_tags(traced(t), t.obs, t.scopes))


@query(_trace_tags(f"AND k.trace_hops > 1 AND k.first_heard_at >= TIMESTAMP '2024-01-10' AND o.iata IN {IN_PLACES}"), "packets", "obs")
def r10_list_traces(t):
    return _tags(traces.trace_tags(traced(t), t.obs, t.scopes, iatas=PLACES, trace_type="trace", since=day("2024-01-10 00:00:00")))


@query("SELECT packet_hash, count(*) AS observation_count FROM obs GROUP BY packet_hash", "obs")
def a12_packet_counts(t):
    return packets.packet_counts(t.obs)


@query("""SELECT observer_id, date_trunc('day', reported_at)::TIMESTAMP + to_hours(CAST(floor(hour(reported_at) / 6) * 6 AS INT)) AS bucket, CAST(round(avg(battery_mv)) AS INT) AS battery_mv, avg(CAST(round(noise_floor * 1000) AS BIGINT)) AS noise_floor,
 CAST(round(avg(queue_len)) AS INT) AS queue_len, greatest(max(airtime_tx) - min(airtime_tx), 0) AS airtime_tx, greatest(max(airtime_rx) - min(airtime_rx), 0) AS airtime_rx, greatest(max(recv_errors) - min(recv_errors), 0) AS recv_errors,
 max(uptime_s) AS uptime_s FROM telemetry GROUP BY ALL""", "telemetry")
def a13_telemetry_buckets(t):
    return plain(observers.telemetry_buckets(t.telemetry.withColumn("noise_floor", F.round(F.col("noise_floor") * 1000).cast("long")), hours=6), "bucket")


@query("SELECT id, observer_id, reported_at::TIMESTAMP AS reported_at, battery_mv, queue_len FROM telemetry WHERE reported_at >= TIMESTAMP '2024-01-20' AND id > 100", "telemetry")
def r7_observer_telemetry(t):
    found = observers.observer_telemetry(t.telemetry, since=day("2024-01-20 00:00:00"), after_id=100)
    return plain(found.select("id", "observer_id", "reported_at", "battery_mv", "queue_len"), "reported_at")


@query("SELECT node_id, string_agg(iata || ':' || (epoch_us(last_heard) // 1000), ',' ORDER BY last_heard DESC, iata DESC) AS places FROM node_iatas GROUP BY node_id", "node_iatas")
def a14_node_places(t):
    return nodes.node_places(t.node_iatas).select("node_id", F.array_join(F.transform("places", lambda p: F.concat(p["iata"], F.lit(":"), p["last_heard_ms"].cast("string"))), ",").alias("places"))


@query("SELECT observer_id, string_agg(DISTINCT name, ',' ORDER BY name) AS scopes FROM observer_scopes JOIN scopes USING (scope_id) GROUP BY observer_id", "observer_scopes", "scopes")
def a15_observer_scope_names(t):
    return observers.observer_scope_names(t.observer_scopes, t.scopes).select("observer_id", joined("scopes"))


# -- packets and observations ------------------------------------------------------------------------------------------


@query("SELECT packet_hash, count(*) AS observation_count, arg_max(observer_id, (heard_at, id)) AS observer_id, arg_max(iata, (heard_at, id)) AS iata FROM obs GROUP BY packet_hash", "obs")
def j3_latest_observation(t):
    return packets.latest_observation(t.obs)


@query(LAST, "obs")
def j4_observer_last_iata(t):
    return observers.observer_last_iata(t.obs)


@query("SELECT p.packet_hash, p.payload_type, o.id, o.iata, s.name AS scope FROM packets p JOIN obs o USING (packet_hash) LEFT JOIN scopes s USING (scope_id)", "packets", "obs", "scopes")
def j1_j2_packet_observations(t):
    rows = t.packets.select("packet_hash", "payload_type", "scope_id").join(t.obs.select("packet_hash", "id", "iata"), "packet_hash")
    return rows.join(t.scopes.select("scope_id", F.col("name").alias("scope")), "scope_id", "left").drop("scope_id")


@query("SELECT id, packet_hash, epoch_us(heard_at) // 1000 - epoch_us(min(heard_at) OVER (PARTITION BY packet_hash)) // 1000 AS propagation_ms FROM obs", "obs")
def w1_propagation(t):
    return packets.propagation_ms(t.obs).select("id", "packet_hash", "propagation_ms")


@query("SELECT packet_hash, epoch_us(max(heard_at)) // 1000 - epoch_us(min(heard_at)) // 1000 AS spread_ms FROM obs GROUP BY packet_hash", "obs")
def w2_packet_spread(t):
    return packets.packet_spread(t.obs)


@query("SELECT id, packet_hash, row_number() OVER (PARTITION BY packet_hash ORDER BY id) AS observation_count, row_number() OVER (PARTITION BY packet_hash ORDER BY id) = 1 AS is_first FROM obs", "obs")
def w3_observation_events(t):
    return packets.observation_events(t.obs, order="id").select("id", "packet_hash", "observation_count", "is_first")


ROUTE_NAME = "CASE route_type WHEN 0 THEN 'TRANSPORT_FLOOD' WHEN 1 THEN 'FLOOD' WHEN 2 THEN 'DIRECT' WHEN 3 THEN 'TRANSPORT_DIRECT' ELSE 'unknown' END"


def _list_packets(where: str, tail: str = "") -> str:
    return f"""WITH l AS (SELECT packet_hash, count(*) AS n, arg_max(observer_id, (heard_at, id)) AS observer_id, arg_max(iata, (heard_at, id)) AS iata FROM obs GROUP BY packet_hash)
 SELECT p.packet_hash, p.payload_type, names.name AS payload_name, p.route_type, {ROUTE_NAME} AS route_name, s.name AS scope, (epoch_us(p.first_heard_at) // 1000) AS first_ms, (epoch_us(p.last_heard_at) // 1000) AS last_ms,
 l.n AS observation_count, l.observer_id, l.iata, v.display_name AS observer_name FROM packets p JOIN {NAMES} ON names.payload_type = p.payload_type LEFT JOIN scopes s ON s.scope_id = p.scope_id JOIN l ON l.packet_hash = p.packet_hash
 LEFT JOIN observers v ON v.observer_id = l.observer_id WHERE {where} {tail}"""


@query(_list_packets("true"), "packets", "obs", "observers", "scopes")
def r1_list_packets(t):
    return packets.list_packets(t.packets, t.obs, t.observers, t.scopes)


@query(_list_packets(f"p.payload_type = 3 AND p.route_type = 3 AND s.name = '#bc' AND p.first_heard_at >= TIMESTAMP '2024-01-05' AND p.first_heard_at < TIMESTAMP '2024-01-28' AND p.packet_hash IN (SELECT packet_hash FROM obs WHERE iata IN {IN_PLACES})", "ORDER BY p.first_heard_at DESC, p.packet_hash LIMIT 21"), "packets", "obs", "observers", "scopes")
def r1_list_packets_page(t):
    return packets.list_packets(
        t.packets, t.obs, t.observers, t.scopes, payload_type=3, route_type=3, iatas=PLACES, scope="#bc", since=day("2024-01-05 00:00:00"), cursor=day("2024-01-28 00:00:00"), limit=20
    )


@query("""SELECT o.id, o.packet_hash, p.payload_type, p.route_type, s.name AS scope, count(*) OVER (PARTITION BY o.packet_hash) AS observation_count, o.observer_id, v.display_name AS observer_name, o.iata, (epoch_us(o.heard_at) // 1000) AS heard_ms
 FROM obs o JOIN packets p USING (packet_hash) LEFT JOIN scopes s ON s.scope_id = p.scope_id LEFT JOIN observers v ON v.observer_id = o.observer_id QUALIFY o.id > 500 ORDER BY o.id LIMIT 100""", "obs", "packets", "scopes", "observers")
def r2_packets_after(t):
    return packets.packets_after(t.packets, t.obs, t.observers, t.scopes, after=500)


@query("SELECT o.id, o.packet_hash, p.origin_pubkey, p.payload_type, o.observer_id, v.display_name AS observer_name, o.iata, o.heard_at FROM obs o JOIN packets p USING (packet_hash) LEFT JOIN observers v USING (observer_id)", "obs", "packets", "observers")
def r4_node_observations(t):
    return packets.node_observations(t.obs, t.packets, t.observers)


@query("SELECT o.id, o.observer_id, o.packet_hash, o.iata, o.heard_at, p.origin_pubkey, n.name AS node_name FROM obs o JOIN packets p USING (packet_hash) LEFT JOIN nodes n ON n.public_key = p.origin_pubkey WHERE p.payload_type = 4", "obs", "packets", "nodes")
def r4_observer_adverts(t):
    return observers.observer_adverts(t.obs, t.packets, t.nodes)


# -- resolution, routes, neighbours ------------------------------------------------------------------------------------

RESOLVED = """cand AS (SELECT s.iata, substr(s.prefix_4, 1, 2*w.n) AS hop, count(*) AS n, min(s.node_id) AS node_id FROM short_ids s JOIN nodes USING (node_id), (VALUES (1),(2),(3),(4)) w(n) WHERE node_type IN (2,3) GROUP BY ALL),
resolved AS (SELECT h.*, coalesce(c.n, 0) AS candidates, c.node_id FROM hops h LEFT JOIN cand c ON c.iata = h.iata AND c.hop = h.hop)"""
ROUTES_SQL = RESOLVED + """, ways AS (SELECT r.id, any_value(r.packet_hash) AS packet_hash, r.iata, list(r.node_id ORDER BY pos) AS node_ids, list(r.hop ORDER BY pos) AS hash_prefix FROM resolved r GROUP BY r.id, r.iata HAVING min(candidates) = 1 AND max(candidates) = 1 AND count(*) >= 2),
routes AS (SELECT node_ids, w.iata, arg_min(hash_prefix, (o.heard_at, o.id)) AS hash_prefix, min(o.heard_at) AS first_seen, max(o.heard_at) AS last_seen, count(*) AS observation_count, CAST(len(node_ids) AS INT) AS hop_count FROM ways w JOIN obs o USING (id) GROUP BY node_ids, w.iata)"""
EDGES_SQL = RESOLVED + """, edges AS (SELECT p.origin_node AS node_id, r.node_id AS neighbor_id, o.iata, min(o.heard_at) AS first_seen, max(o.heard_at) AS last_seen, count(*) AS observation_count
 FROM obs o JOIN packets p USING (packet_hash) JOIN nodes n ON n.node_id = p.origin_node JOIN resolved r ON r.id = o.id WHERE p.payload_type = 4 AND n.node_type IN (2,3) AND r.pos = 0 AND r.candidates = 1 GROUP BY ALL)"""
PATH_VIEWS = ("obs", "packets", "nodes", "short_ids", "hops")


def resolved(t: Tables) -> DataFrame:
    return resolve.resolve_paths(t.paths, t.short_ids, t.nodes)


def intervals(t: Tables) -> DataFrame:
    return resolve.unique_intervals(resolve.relay_prefixes(t.short_ids, t.nodes))


def capabilities(t: Tables) -> DataFrame:
    return resolve.node_capabilities(t.paths.join(t.packets.select("packet_hash", "payload_type"), "packet_hash"), resolve.relay_prefixes(t.short_ids, t.nodes))


def known_routes(t: Tables) -> DataFrame:
    return routes.with_route_id(routes.build_known_routes(t.paths, intervals(t)))


def adverts(t: Tables) -> DataFrame:
    heard = t.paths.join(t.packets.filter("payload_type = 4").select("packet_hash", F.col("origin_node").alias("node_id")), "packet_hash")
    return heard.join(t.nodes.select("node_id", "node_type", "public_key"), "node_id")


def edges(t: Tables) -> DataFrame:
    return neighbors.fold_neighbors(adverts(t), intervals(t))


def flat(df: DataFrame) -> DataFrame:
    """Routes with their arrays as text."""
    return df.select("iata", joined("node_ids"), joined("hash_prefix"), "hop_count", "first_seen", "last_seen", "observation_count")


FLAT = "iata, array_to_string(node_ids, ',') AS node_ids, array_to_string(hash_prefix, ',') AS hash_prefix, hop_count, first_seen, last_seen, observation_count"
CONFIDENCE = "CASE candidates WHEN 0 THEN 'none' WHEN 1 THEN 'high' ELSE 'ambiguous' END"


@query(f"WITH {RESOLVED} SELECT id, packet_hash, iata, CAST(pos AS INT) AS pos, hop, CAST(candidates AS INT) AS candidates, {CONFIDENCE} AS confidence, CASE WHEN candidates > 0 THEN node_id END AS first_node FROM resolved", *PATH_VIEWS)
def j6_resolve_paths(t):
    return resolved(t).select("id", "packet_hash", "iata", "pos", "hop", "candidates", "confidence", F.get("node_ids", F.lit(0)).alias("first_node"))


@query(f"WITH {RESOLVED} SELECT node_id, bool_or(t <> 9 AND s IN (2,3)) AS multibyte_paths, bool_or(t = 9 AND s IN (2,4)) AS multibyte_traces FROM (SELECT c.node_id, p.payload_type AS t, o.hash_size AS s FROM hops h JOIN obs o USING (id) JOIN packets p ON p.packet_hash = o.packet_hash JOIN (SELECT s.iata, substr(s.prefix_4, 1, 2*w.n) AS hop, s.node_id FROM short_ids s JOIN nodes USING (node_id), (VALUES (1),(2),(3),(4)) w(n) WHERE node_type IN (2,3)) c ON c.iata = h.iata AND c.hop = h.hop) WHERE (t <> 9 AND s IN (2,3)) OR (t = 9 AND s IN (2,4)) GROUP BY node_id", *PATH_VIEWS)
def a28_node_capabilities(t):
    return capabilities(t)


@query(f"WITH {EDGES_SQL} SELECT * FROM edges", *PATH_VIEWS)
def a29_neighbors(t):
    return edges(t)


@query(f"WITH {EDGES_SQL} SELECT node_id, count(*) AS neighbor_count FROM edges GROUP BY node_id", *PATH_VIEWS)
def a16_neighbor_counts(t):
    return neighbors.neighbor_counts(edges(t))


@query(f"WITH {EDGES_SQL} SELECT e.node_id, e.neighbor_id, CAST(sum(observation_count) AS BIGINT) AS observation_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen, arg_max(iata, (last_seen, iata)) AS iata, any_value(n.name) AS neighbor_name, any_value(n.node_type) AS neighbor_type FROM edges e LEFT JOIN nodes n ON n.node_id = e.neighbor_id GROUP BY ALL", *PATH_VIEWS)
def a17_neighbors_merged(t):
    return neighbors.node_neighbors_merged(edges(t), t.nodes)


@query(f"WITH {ROUTES_SQL} SELECT {FLAT} FROM routes", *PATH_VIEWS)
def a30_known_routes(t):
    return flat(known_routes(t))


@query("SELECT origin_node AS node_id, iata, min(heard_at) AS first_heard, max(heard_at) AS last_heard, count(*) AS observation_count FROM obs JOIN packets USING (packet_hash) JOIN nodes ON nodes.node_id = origin_node WHERE payload_type = 4 GROUP BY ALL", "obs", "packets", "nodes")
def a26_node_iatas(t):
    return nodes.fold_node_iatas(adverts(t))


@query("SELECT DISTINCT origin_node AS node_id, iata, substr(public_key,1,8) AS prefix_4, substr(public_key,1,2) AS prefix_1, substr(public_key,1,4) AS prefix_2, substr(public_key,1,6) AS prefix_3 FROM obs JOIN packets USING (packet_hash) JOIN nodes ON nodes.node_id = origin_node WHERE payload_type = 4", "obs", "packets", "nodes")
def a27_short_ids(t):
    return nodes.fold_short_ids(adverts(t))


#: Nodes with a negative balance count as lost.
SOME_IDS = "some_ids AS (SELECT * FROM known_ids)"


@query(f"""WITH {ROUTES_SQL}, {SOME_IDS}, h AS (SELECT node_ids AS k, iata, unnest(node_ids) AS node_id, unnest(hash_prefix) AS hop FROM routes),
 w AS (SELECT iata, substr(prefix_4, 1, 2*n) AS hop FROM some_ids, (VALUES (1),(2),(3),(4)) v(n) GROUP BY ALL HAVING count(*) > 1),
 bad AS (SELECT k, h.iata FROM h LEFT JOIN some_ids s ON s.node_id = h.node_id AND s.iata = h.iata WHERE s.node_id IS NULL UNION SELECT k, h.iata FROM h JOIN w ON w.iata = h.iata AND w.hop = h.hop)
 SELECT {FLAT} FROM routes r WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.k = r.node_ids AND b.iata = r.iata)""", *PATH_VIEWS, "known_ids")
def j11_reconfirm_routes(t):
    return flat(routes.reconfirm_routes(known_routes(t), t.known_ids, by_width=True))


@query(f"WITH {EDGES_SQL}, {SOME_IDS} SELECT e.* FROM edges e JOIN some_ids s ON s.node_id = e.neighbor_id AND s.iata = e.iata WHERE (SELECT count(*) FROM some_ids x WHERE x.iata = s.iata AND x.prefix_4 = s.prefix_4) = 1", *PATH_VIEWS, "known_ids")
def j12_reconfirm_neighbors(t):
    return neighbors.reconfirm_neighbors(edges(t), t.known_ids)


@query(f"WITH {EDGES_SQL}, k AS (SELECT node_id, CASE WHEN node_id % 5 = 0 THEN 1 ELSE node_type END AS node_type FROM nodes WHERE node_id IN (SELECT node_id FROM known_ids)) SELECT e.* FROM edges e WHERE node_id NOT IN (SELECT node_id FROM k WHERE node_type NOT IN (2,3)) AND neighbor_id NOT IN (SELECT node_id FROM k WHERE node_type NOT IN (2,3))", *PATH_VIEWS, "known_ids")
def j13_clean_neighbors(t):
    some = t.nodes.join(t.known_ids.select("node_id"), "node_id", "left_semi").withColumn("node_type", F.when(F.col("node_id") % 5 == 0, 1).otherwise(F.col("node_type")))
    return neighbors.clean_neighbors(edges(t), some)


@query(f"SELECT (SELECT count(*) FROM packets WHERE last_heard_at >= {T0} - INTERVAL 20 DAY) AS packets, (SELECT count(*) FROM obs WHERE packet_hash IN (SELECT packet_hash FROM packets WHERE last_heard_at >= {T0} - INTERVAL 20 DAY)) AS observations, (SELECT count(*) FROM telemetry WHERE reported_at >= {T0} - INTERVAL 15 DAY) AS telemetry", "packets", "obs", "telemetry")
def j14_prune_old(t):
    kept = maintenance.prune_old(t.packets, t.obs, t.telemetry, as_of=as_of(), packet_retention="20 days", telemetry_retention="15 days")
    counts = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in zip(kept, ("packets", "observations", "telemetry"), strict=True)]
    return counts[0].join(counts[1], how="cross").join(counts[2], how="cross")  # one row each


@query(f"WITH {EDGES_SQL} SELECT e.*, n.name AS neighbor_name, n.node_type AS neighbor_type FROM edges e JOIN nodes n ON n.node_id = e.neighbor_id WHERE iata <> 'YVR'", *PATH_VIEWS)
def j15_cross_iata_neighbors(t):
    return neighbors.cross_iata_neighbors(edges(t), t.nodes, iata="YVR")


def _hops_text(df: DataFrame) -> Column:
    return F.array_join(F.transform("hops", lambda h: F.concat_ws(":", h["node_id"].cast("string"), h["hash"], h["name"])), ",").alias("hops")


HOPS_TEXT = "(SELECT string_agg(concat_ws(':', CAST(u.n AS VARCHAR), u.h, n.name), ',' ORDER BY u.i) FROM (SELECT unnest(node_ids) AS n, unnest(hash_prefix) AS h, unnest(range(len(node_ids))) AS i) u LEFT JOIN nodes n ON n.node_id = u.n) AS hops"


@query(f"WITH {ROUTES_SQL} SELECT iata, hop_count, last_seen, observation_count, {HOPS_TEXT} FROM routes WHERE hop_count = 3 AND iata = 'LHR'", *PATH_VIEWS)
def r13_list_routes(t):
    found = routes.list_routes(known_routes(t), t.nodes, iata="LHR", hop_count=3)
    return found.select("iata", "hop_count", "last_seen", "observation_count", _hops_text(found))


P = "substr(md5('n' || '{}'), 1, 4)"
#: Two nodes that follow each other on paths of the adapters' hops.
SEARCH = (87, 223)


@query(f"WITH {ROUTES_SQL} SELECT iata, full_hop_count, CAST(len(node_ids) AS INT) AS hop_count, array_to_string(node_ids, ',') AS node_ids, last_seen FROM (SELECT iata, hop_count AS full_hop_count, last_seen, node_ids[list_position(hash_prefix, f):list_position(hash_prefix, g)] AS node_ids FROM (SELECT *, {P.format(SEARCH[0])} AS f, {P.format(SEARCH[1])} AS g FROM routes) WHERE iata = 'LHR' AND list_position(hash_prefix, f) > 0 AND list_position(hash_prefix, f) < list_position(hash_prefix, g))", *PATH_VIEWS)
def r14_search_routes(t):
    import hashlib

    f, g = (hashlib.md5(f"n{k}".encode()).hexdigest()[:4] for k in SEARCH)
    found = routes.search_routes(known_routes(t), t.nodes, iata="LHR", from_hash=f, to_hash=g)
    return found.select("iata", "full_hop_count", "hop_count", joined("node_ids"), "last_seen")


@query(f"WITH {ROUTES_SQL} SELECT iata, hop_count, last_seen, observation_count, {HOPS_TEXT} FROM routes WHERE iata = 'LHR' AND list_contains(node_ids, 31)", *PATH_VIEWS)
def r15_routes_by_node(t):
    found = routes.routes_by_node(known_routes(t), t.nodes, iata="LHR", node_id=31)
    return found.select("iata", "hop_count", "last_seen", "observation_count", _hops_text(found))


CROSS_FROM, CROSS_TO = 32, 593


@query(f"""WITH {ROUTES_SQL}, {EDGES_SQL.removeprefix(RESOLVED + ', ')},
 one AS (SELECT min(node_id) AS node_id FROM short_ids JOIN nodes USING (node_id) WHERE iata = 'YVR' AND node_type IN (2,3) AND prefix_4 = substr(md5('n{CROSS_FROM}'),1,8) HAVING count(DISTINCT node_id) = 1),
 two AS (SELECT min(node_id) AS node_id FROM short_ids JOIN nodes USING (node_id) WHERE iata = 'YYJ' AND node_type IN (2,3) AND prefix_4 = substr(md5('n{CROSS_TO}'),1,8) HAVING count(DISTINCT node_id) = 1),
 s AS (SELECT r.node_ids, unnest(r.node_ids) AS cross_from, unnest(range(1, len(r.node_ids) + 1)) AS pos FROM routes r, one WHERE r.iata = 'YVR' AND list_contains(r.node_ids, one.node_id)),
 tg AS (SELECT r.node_ids, r.hop_count, r.last_seen, two.node_id AS wanted, unnest(r.node_ids) AS cross_to FROM routes r, two WHERE r.iata = 'YYJ' AND list_contains(r.node_ids, two.node_id)),
 b AS (SELECT cross_to, wanted, arg_min(node_ids, (hop_count, -(epoch_us(last_seen) // 1000), node_ids)) AS route FROM tg GROUP BY ALL)
 SELECT DISTINCT array_to_string(s.node_ids[1:s.pos], ',') AS source, s.cross_from, e.neighbor_id AS cross_to, array_to_string(b.route[list_position(b.route, e.neighbor_id):list_position(b.route, b.wanted)], ',') AS target,
 CAST(s.pos + 1 + list_position(b.route, b.wanted) - list_position(b.route, e.neighbor_id) + 1 AS INT) AS total_hops
 FROM s JOIN edges e ON e.node_id = s.cross_from AND e.iata = 'YYJ' JOIN b ON b.cross_to = e.neighbor_id WHERE list_position(b.route, e.neighbor_id) <= list_position(b.route, b.wanted)""", *PATH_VIEWS)
def r16_cross_iata_routes(t):
    import hashlib

    f, g = (hashlib.md5(f"n{k}".encode()).hexdigest()[:8] for k in (CROSS_FROM, CROSS_TO))
    found = routes.cross_iata_routes(known_routes(t), edges(t), t.short_ids, t.nodes, from_hash=f, from_iata="YVR", to_hash=g, to_iata="YYJ")
    return found.select(joined("source"), "cross_from", "cross_to", joined("target"), "total_hops")


TRACE_HASHES = "substr(md5('n' || CAST((packet_no*31 + {i}*17) % n_nodes AS STRING)),1,2)"


@query(f"""WITH cand AS (SELECT s.iata, substr(s.prefix_4, 1, 2) AS hop, count(*) AS n, min(s.node_id) AS node_id FROM short_ids s JOIN nodes USING (node_id) WHERE node_type IN (2,3) GROUP BY ALL),
 h AS (SELECT packet_hash, CAST(i AS INT) AS pos, {TRACE_HASHES.format(i='i')} AS hop FROM packets, (SELECT count(*) AS n_nodes FROM customer) c, (VALUES (0),(1),(2),(3)) v(i) WHERE trace_tag IS NOT NULL AND i < trace_hops),
 pl AS (SELECT packet_hash, iata, min((heard_at, id)) AS heard FROM obs GROUP BY ALL),
 m AS (SELECT h.packet_hash, h.pos, h.hop, pl.iata, pl.heard, coalesce(c.n, 0) AS candidates, c.node_id FROM h LEFT JOIN pl USING (packet_hash) LEFT JOIN cand c ON c.iata = pl.iata AND c.hop = h.hop),
 k AS (SELECT *, row_number() OVER (PARTITION BY packet_hash, pos ORDER BY CASE candidates WHEN 1 THEN 0 WHEN 0 THEN 2 ELSE 1 END, heard, iata) AS rn FROM m)
 SELECT packet_hash, pos, hop, {CONFIDENCE} AS confidence, iata, CASE WHEN candidates > 0 THEN node_id END AS first_node,
 CASE WHEN pos + 1 < hops THEN (CASE WHEN b > 127 THEN b - 256 ELSE b END) / 4.0 END::DOUBLE AS snr FROM (SELECT k.*, p.trace_hops AS hops, (p.packet_no + 7 * k.pos) % 256 AS b FROM k JOIN packets p USING (packet_hash)) WHERE rn = 1""", "packets", "obs", "short_ids", "nodes")
def r12_trace_detail(t):
    found = traces.trace_detail(_traced_hashes(t), t.obs, t.short_ids, t.nodes)
    return found.select("packet_hash", "pos", "hop", "confidence", "iata", F.get("node_ids", F.lit(0)).alias("first_node"), "snr")


def _traced_hashes(t: Tables) -> DataFrame:
    """Packets with the hashes and signal bytes of traces, the last hop without a signal."""
    hashes = F.slice(F.array(*(F.expr(TRACE_HASHES.format(i=i)) for i in range(4))), 1, F.col("trace_hops"))
    signals = F.slice(F.array(*(((F.col("packet_no") + 7 * i) % 256).cast("int") for i in range(4))), 1, F.col("trace_hops") - 1)
    traced_row = F.col("trace_tag").isNotNull()
    n_nodes = t.customer.agg(F.count(F.lit(1)).alias("n_nodes"))
    return t.packets.join(F.broadcast(n_nodes), how="cross").withColumns({"trace_hashes": F.when(traced_row, hashes), "trace_flags": F.lit(0), "trace_snr": F.when(traced_row, signals)}).drop("n_nodes")


# -- devices, channels, messages, dimensions ---------------------------------------------------------------------------


@query(f"WITH {EDGES_SQL} SELECT n.node_id, n.name, {TYPE_NAME} AS node_type_name, s.name AS default_scope, coalesce((SELECT count(*) FROM edges e WHERE e.node_id = n.node_id), 0) AS neighbor_count, coalesce((SELECT count(*) FROM node_iatas i WHERE i.node_id = n.node_id), 0) AS n_places, o.observer_id IS NOT NULL AS is_observer FROM nodes n LEFT JOIN scopes s ON s.scope_id = n.default_scope_id LEFT JOIN observers o ON o.public_key = n.public_key", *PATH_VIEWS, "node_iatas", "scopes", "observers")
def r5_list_nodes(t):
    found = nodes.list_nodes(t.nodes, t.node_iatas, t.observers, edges(t), t.scopes)
    return found.select("node_id", "name", "node_type_name", "default_scope", "neighbor_count", F.size("places").cast("long").alias("n_places"), "is_observer")


CAPABLE = "SELECT node_id, bool_or(t <> 9 AND s IN (2,3)) AS multibyte_paths, bool_or(t = 9 AND s IN (2,4)) AS multibyte_traces FROM (SELECT c.node_id, p.payload_type AS t, o.hash_size AS s FROM hops h JOIN obs o USING (id) JOIN packets p ON p.packet_hash = o.packet_hash JOIN (SELECT s.iata, substr(s.prefix_4, 1, 2*w.n) AS hop, s.node_id FROM short_ids s JOIN nodes USING (node_id), (VALUES (1),(2),(3),(4)) w(n) WHERE node_type IN (2,3)) c ON c.iata = h.iata AND c.hop = h.hop) WHERE (t <> 9 AND s IN (2,3)) OR (t = 9 AND s IN (2,4)) GROUP BY node_id"


@query(f"WITH cap AS ({CAPABLE}) SELECT n.node_id, n.name, s.name AS default_scope, multibyte_paths, multibyte_traces FROM nodes n JOIN cap USING (node_id) LEFT JOIN scopes s ON s.scope_id = n.default_scope_id WHERE node_type = 2 AND n.node_id IN (SELECT node_id FROM node_iatas WHERE iata IN {IN_PLACES}) AND n.name ILIKE '%customer%' AND multibyte_paths AND NOT multibyte_traces", *PATH_VIEWS, "node_iatas", "scopes")
def r5_filtered_nodes(t):
    """Type, places, name and both capability flags."""
    able = capabilities(t)
    found = nodes.list_nodes(
        t.nodes.join(able, "node_id", "left"), t.node_iatas, t.observers, t.obs.limit(0).select(F.lit(0).alias("node_id")), t.scopes, node_type=2, iatas=PLACES, name="customer", multibyte_paths=True, multibyte_traces=False
    )
    return found.select("node_id", "name", "default_scope", "multibyte_paths", "multibyte_traces")


@query(f"WITH {EDGES_SQL}, m AS (SELECT node_id, neighbor_id, sum(observation_count) AS n, max(last_seen) AS last_seen FROM edges GROUP BY ALL) SELECT n.node_id, (SELECT string_agg(m.neighbor_id || ':' || CAST(m.n AS BIGINT), ',' ORDER BY (epoch_us(m.last_seen) // 1000) DESC, m.neighbor_id DESC) FROM m WHERE m.node_id = n.node_id) AS neighbors FROM nodes n", *PATH_VIEWS)
def r5_node_profile(t):
    found = nodes.node_profile(t.nodes, t.node_iatas, t.observers, edges(t), t.scopes)
    return found.select("node_id", F.array_join(F.transform("neighbors", lambda x: F.concat_ws(":", x["neighbor_id"].cast("string"), x["observation_count"].cast("string"))), ",").alias("neighbors"))


def _observers_sql(where: str) -> str:
    return f"""WITH last AS ({LAST}), sc AS (SELECT observer_id, string_agg(DISTINCT name, ',' ORDER BY name) AS scopes FROM observer_scopes JOIN scopes USING (scope_id) GROUP BY observer_id)
 SELECT v.observer_id, display_name, observer_type, last_seen, CASE WHEN last_status_at > {T0} - INTERVAL 5 MINUTE THEN 'online' ELSE 'offline' END AS status, last.iata, coalesce(scopes, '') AS scopes FROM observers v LEFT JOIN last ON last.observer_id = v.observer_id LEFT JOIN sc ON sc.observer_id = v.observer_id WHERE {where}"""


@query(_observers_sql("true"), "obs", "observers", "observer_scopes", "scopes")
def r6_list_observers(t):
    found = observers.list_observers(t.observers, None, t.observer_scopes, t.scopes, t.obs, as_of=as_of())
    return found.select("observer_id", "display_name", "observer_type", "last_seen", "status", "iata", joined("scopes"))


@query(_observers_sql(f"observer_type = 'bridge' AND display_name ILIKE '%S-1%' AND last.iata IN {IN_PLACES} AND v.observer_id IN (SELECT observer_id FROM observer_scopes JOIN scopes USING (scope_id) WHERE name = '#bc') AND last_status_at <= {T0} - INTERVAL 5 MINUTE AND v.observer_id IN (SELECT observer_id FROM obs WHERE source_broker = 'mqtt1')"), "obs", "observers", "observer_scopes", "scopes")
def r6_filtered_observers(t):
    brokers = t.obs.select("observer_id", F.col("source_broker").alias("broker_name")).distinct()
    found = observers.list_observers(
        t.observers, brokers, t.observer_scopes, t.scopes, t.obs, as_of=as_of(), observer_type="bridge", name="S-1", iatas=PLACES, scope="#bc", status="offline", broker="mqtt1"
    )
    return found.select("observer_id", "display_name", "observer_type", "last_seen", "status", "iata", joined("scopes"))


@query("SELECT v.observer_id, (SELECT string_agg(b.source_broker, ',' ORDER BY b.seen DESC, b.source_broker DESC) FROM (SELECT source_broker, max(heard_at) AS seen FROM obs o WHERE o.observer_id = v.observer_id GROUP BY source_broker) b) AS brokers, observation_count FROM observers v", "obs", "observers")
def r6_observer_profile(t):
    rows = t.obs.select(F.col("observer_id").alias("observer_pubkey"), F.col("heard_at").alias("arrival_ts"), F.col("source_broker").alias("broker"))
    brokers = observers.fold_observer_brokers(rows).withColumnRenamed("observer_pubkey", "observer_id")
    return observers.observer_profile(t.observers, brokers, t.observer_scopes, t.scopes, t.obs, as_of=as_of()).select("observer_id", joined("brokers"), "observation_count")


@query("SELECT user_id AS public_key, 'unknown' AS observer_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) - 1 AS observation_count FROM events GROUP BY user_id")
def a20_fold_observers(t):
    return observers.fold_observers(t.events.select(F.col("user_id").alias("observer_pubkey"), F.col("ts").alias("arrival_ts")))


@query("SELECT observer_id AS observer_pubkey, source_broker AS broker_name, min(heard_at) AS first_seen, max(heard_at) AS last_seen, max(heard_at) AS last_packet_at FROM obs GROUP BY ALL", "obs")
def a22_observer_brokers(t):
    """Folded in two halves, the second onto the first."""
    rows = t.obs.select(F.col("observer_id").alias("observer_pubkey"), F.col("heard_at").alias("arrival_ts"), F.col("source_broker").alias("broker"), "id")
    return observers.fold_observer_brokers(rows.filter("id % 2 = 1"), existing=observers.fold_observer_brokers(rows.filter("id % 2 = 0")))


@query("SELECT observer_id, scope_id, first_seen, last_seen FROM observer_scopes", "observer_scopes")
def a23_observer_scopes(t):
    return observers.fold_observer_scopes(t.obs.join(t.packets.select("packet_hash", "scope_id"), "packet_hash"))


@query("SELECT packet_hash, arg_min(source_broker, id) AS raw_payload, min(heard_at) AS first_heard_at, max(heard_at) AS last_heard_at, min(id) >= 5000 AS inserted FROM obs GROUP BY packet_hash", "obs")
def a18_fold_packets(t):
    """The later part of the observations folded onto the earlier."""
    rows = t.obs.select("packet_hash", F.col("id").alias("seq"), F.col("heard_at").alias("arrival_ts"), F.col("source_broker").alias("raw_payload"))
    return packets.fold_packets(rows.filter("seq >= 5000"), existing=packets.fold_packets(rows.filter("seq < 5000")).drop("inserted"))


@query("SELECT packet_hash, observer_id, heard_at, arg_min(source_broker, id) AS source_broker FROM obs GROUP BY ALL", "obs")
def a19_dedup_observations(t):
    """Every observation arrives twice, the second time through another broker."""
    rows = t.obs.select("packet_hash", "observer_id", "heard_at", F.col("id").alias("seq"), "source_broker")
    again = rows.withColumns({"seq": F.col("seq") + 1_000_000_000, "source_broker": F.lit("other")})
    return packets.dedup_observations(rows.unionByName(again)).drop("seq")


@query("SELECT channel_hash, CAST(NULL AS VARCHAR) AS key_fingerprint, min(first_heard_at) AS first_seen, max(first_heard_at) AS last_seen, false AS key_known, CAST(0 AS BIGINT) AS message_count FROM packets WHERE payload_type = 5 GROUP BY channel_hash UNION ALL SELECT channel_hash, 'f' || channel_hash, min(first_heard_at), max(first_heard_at), true, 0 FROM packets WHERE payload_type = 5 AND packet_no % 2 = 0 GROUP BY channel_hash UNION ALL SELECT channel_hash, 'g' || channel_hash, min(first_heard_at), max(first_heard_at), true, 0 FROM packets WHERE payload_type = 5 AND packet_no % 2 = 1 AND packet_no % 3 = 0 GROUP BY channel_hash", "packets")
def a31_fold_channels(t):
    """Even packets open with two keys, of which the first loaded counts; some odd ones with the second alone."""
    texts = t.packets.filter("payload_type = 5").withColumn("arrival_ts", F.col("first_heard_at"))
    first, second = (F.concat(F.lit(p), F.col("channel_hash")) for p in "fg")
    opened_by = F.when(F.col("packet_no") % 2 == 0, F.array(second, first)).when(F.col("packet_no") % 3 == 0, F.array(second)).otherwise(F.array().cast("array<string>"))
    hashes = texts.select("channel_hash").distinct()
    keys = hashes.select("channel_hash", first.alias("key_fingerprint"), F.lit("#one").alias("name"), F.lit(1).alias("load_order")).unionByName(
        hashes.select("channel_hash", second.alias("key_fingerprint"), F.lit("two").alias("name"), F.lit(2).alias("load_order"))
    )
    found = channels.fold_channels(texts, channels.channel_candidates(texts.withColumn("opened_by", opened_by), keys))
    return found.select("channel_hash", "key_fingerprint", "first_seen", "last_seen", "key_known", "message_count")


@query("SELECT packet_hash, any_value(channel_hash) AS channel_hash, arg_min(sender_name, id) AS sender_name, arg_min(content, id) AS content, any_value(sent_at) AS sent_at FROM messages GROUP BY packet_hash", "messages")
def a32_channel_messages(t):
    twice = t.messages.withColumn("seq", F.col("id")).unionByName(t.messages.withColumns({"seq": F.col("id") + 1_000_000_000_000, "content": F.lit("second")}))
    return channels.fold_channel_messages(twice)


CHANNELS = "SELECT DISTINCT channel_hash FROM packets WHERE channel_hash IS NOT NULL"


@query(f"SELECT channel_hash, min(first_heard_at) AS first_seen, max(first_heard_at) AS last_seen FROM packets WHERE channel_hash IS NOT NULL GROUP BY channel_hash HAVING channel_hash IN (SELECT channel_hash FROM packets JOIN obs USING (packet_hash) WHERE iata ILIKE 'yvr')", "packets", "obs")
def r8_list_channels(t):
    texts = t.packets.filter("payload_type = 5").withColumn("arrival_ts", F.col("first_heard_at"))
    none = texts.limit(0).select("packet_hash", "channel_hash", F.lit("").alias("key_fingerprint"), F.lit("").alias("name"))
    return channels.list_channels(channels.fold_channels(texts, none), t.packets, t.obs, iata="yvr").select("channel_hash", "first_seen", "last_seen")


@query(f"SELECT c.channel_hash, (SELECT count(*) FROM messages m WHERE m.channel_hash = c.channel_hash) AS messages FROM ({CHANNELS}) c", "packets", "messages")
def r8_channel_detail(t):
    return channels.channel_detail(t.packets.filter("channel_hash IS NOT NULL").select("channel_hash").distinct(), t.messages)


def _messages(where: str) -> str:
    return f"""SELECT m.id, m.channel_id, m.channel_hash, m.packet_hash, m.sender_name, m.content, (epoch_us(m.sent_at) // 1000) AS sent_ms, s.name AS scope, (SELECT count(*) FROM obs o WHERE o.packet_hash = m.packet_hash) AS observation_count
 FROM messages m JOIN packets p ON p.packet_hash = m.packet_hash LEFT JOIN scopes s ON s.scope_id = p.scope_id WHERE {where}"""


@query(_messages(f"m.sent_at >= TIMESTAMP '2024-01-03' AND m.packet_hash IN (SELECT packet_hash FROM obs WHERE iata IN {IN_PLACES})"), "messages", "packets", "obs", "scopes")
def r9_list_messages(t):
    return channels.list_messages(t.messages, t.packets, t.obs, t.scopes, since=day("2024-01-03 00:00:00"), iatas=PLACES)


@query(_messages("m.id > 10 ORDER BY m.id LIMIT 100"), "messages", "packets", "obs", "scopes")
def r9_messages_after(t):
    return channels.messages_after(t.messages, t.packets, t.obs, t.scopes, after=10)


@query("SELECT region_id, slug, name, iata FROM regions JOIN region_iatas USING (region_id)", "regions", "region_iatas")
def r17_region_members(t):
    return dims.region_members(t.regions, t.region_iatas)


@query("SELECT region_id, slug, name FROM regions", "regions")
def r17_list_regions(t):
    return dims.list_regions(t.regions)


@query("SELECT scope_id, name FROM scopes", "scopes")
def r17_list_scopes(t):
    return scopes.list_scopes(t.scopes)


@query("SELECT iata, min(heard_at) AS since FROM obs GROUP BY iata", "obs")
def r17_list_iatas(t):
    return dims.list_iatas(t.obs.groupBy("iata").agg(F.min("heard_at").alias("since")))


@query("SELECT iata, count(*) AS n FROM obs WHERE iata IN (SELECT iata FROM region_iatas JOIN regions USING (region_id) WHERE slug = 'asia') GROUP BY iata", "obs", "region_iatas", "regions")
def f3_region_observations(t):
    places = filters.region_iatas(t.regions, t.region_iatas, slug="asia")
    return filters.filter_region(t.obs, places).groupBy("iata").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT iata, count(*) AS n FROM obs WHERE iata IN ('YVR','YYJ','YYC','YEG','LHR') GROUP BY iata", "obs")
def f4_allowed_places(t):
    """Canada's west by country code and Europe by continent; places without an airport row are dropped."""
    rows = t.obs.select("iata").distinct()
    country = F.when(F.col("iata").isin("YVR", "YYJ", "YYC", "YEG"), "CA").when(F.col("iata") == "LHR", "GB").when(F.col("iata") == "SEA", "US")
    airports = rows.withColumns({"country": country, "continent": F.when(F.col("iata") == "LHR", "EU").otherwise("NA")}).filter("country IS NOT NULL")
    return filters.filter_allowed(t.obs, airports, countries=["CA"], continents=["EU"]).groupBy("iata").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, iata, heard_at FROM obs WHERE heard_at < TIMESTAMP '2024-01-15' ORDER BY heard_at DESC, id LIMIT 51", "obs")
def p1_page_desc(t):
    return filters.page_desc(t.obs.select("id", "iata", "heard_at"), "heard_at", cursor=day("2024-01-15 00:00:00"), limit=50, ties=["id"])


@query("SELECT id, iata FROM obs WHERE id < 700 ORDER BY id DESC LIMIT 50", "obs")
def p2_page_by_id(t):
    return filters.page_by_id(t.obs.select("id", "iata"), cursor=700)


@query("SELECT observer_id, CAST(sum(n) AS BIGINT) AS n, max(last) AS last, min(first) AS first FROM (SELECT observer_id, count(*) AS n, max(heard_at) AS last, min(heard_at) AS first FROM obs GROUP BY observer_id) GROUP BY observer_id", "obs")
def s7_merge_by_key(t):
    parts = [t.obs.filter(f"id % 2 = {k}").groupBy("observer_id").agg(F.count(F.lit(1)).alias("n"), F.max("heard_at").alias("last"), F.min("heard_at").alias("first")) for k in (0, 1)]
    return filters.merge_by_key(parts[0], parts[1], ["observer_id"], {"n": "sum", "last": "max", "first": "min"})


@query("SELECT c_custkey, substr(sha256('#' || c_name), 1, 32) AS secret, substr(sha256(unhex(substr(sha256('#' || c_name), 1, 32))), 1, 2) AS channel_hash, substr(sha256(unhex(substr(sha256('#' || c_name), 1, 32))), 1, 16) AS key_fingerprint FROM customer")
def x20_hashtag_keys(t):
    return t.customer.select("c_custkey", X.derive_hashtag_key(F.col("c_name")).alias("k")).select("c_custkey", "k.*")


SUBS = "subs AS (SELECT * FROM (VALUES ('a', ['YVR'], CAST([] AS INT[])), ('a', ['YVR','SEA'], CAST([] AS INT[])), ('b', CAST([] AS VARCHAR[]), [4]), ('c', ['LHR'], [5, 9]), ('d', CAST([] AS VARCHAR[]), CAST([] AS INT[]))) v(client_id, iatas, payload_types))"


@query(f"WITH {SUBS} SELECT client_id, count(*) AS events FROM (SELECT DISTINCT o.id, s.client_id FROM obs o JOIN packets p USING (packet_hash) JOIN subs s ON (len(s.iatas) = 0 OR list_contains(s.iatas, o.iata)) AND (len(s.payload_types) = 0 OR list_contains(s.payload_types, p.payload_type))) GROUP BY client_id", "obs", "packets")
def t8_match_subscriptions(t):
    rows = [("a", ["YVR"], []), ("a", ["YVR", "SEA"], []), ("b", [], [4]), ("c", ["LHR"], [5, 9]), ("d", [], [])]
    subs = t.spark.createDataFrame([(*r, [], []) for r in rows], "client_id string, iatas array<string>, payload_types array<int>, channel_hashes array<string>, events array<string>")
    events = t.obs.join(t.packets.select("packet_hash", "payload_type", "channel_hash"), "packet_hash").select(F.col("id").alias("event_id"), F.lit("packetObservation").alias("type"), "iata", "payload_type", "channel_hash")
    return jobs.match_subscriptions(events, subs).groupBy("client_id").agg(F.count(F.lit(1)).alias("events"))


CLOCK = "CAST(floor(event_id / 4) AS BIGINT) % 90 - 45"


@query(f"SELECT event_id AS id, CASE WHEN abs(m) <= 30 THEN ts + to_minutes(CAST(m AS INT)) ELSE ts END AS heard_at FROM (SELECT event_id, ts, {CLOCK} AS m FROM events)")
def t2_clamped_times(t):
    """Observers' clocks are up to 45 minutes off; beyond half an hour the arrival counts."""
    late = t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("arrival_ts"), F.expr(CLOCK).alias("m"))
    text = F.date_format(F.col("arrival_ts") + F.make_dt_interval(mins=F.col("m").cast("int")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return plain(jobs.clamp_times(late.withColumn("timestamp_text", text)).select("id", "heard_at"), "heard_at")


@query("""WITH s AS (SELECT c_custkey AS id, c_custkey % 9 AS a, n_regionkey AS b FROM customer JOIN nation ON n_nationkey = c_nationkey),
 m AS (SELECT s.id, i.iata FROM s JOIN region_iatas i ON i.region_id IN (s.a, s.b) UNION SELECT id, substr('YVRYYJYYCYEGYOWYYZSEALHR', CAST(1 + 3*(id % 8) AS INT), 3) FROM s)
 SELECT CAST(id AS VARCHAR) AS client_id, string_agg(iata, ',' ORDER BY iata) AS iatas FROM m GROUP BY id""", "region_iatas")
def t9_subscription_places(t):
    """A place of each client's own and the members of two regions, by number (unknown ones are skipped) and by name; a client per customer."""
    nation = t.nation.join(t.regions, F.col("n_regionkey") == F.col("region_id")).select(F.col("n_nationkey").alias("c_nationkey"), "slug")
    place = F.expr("substr('YVRYYJYYCYEGYOWYYZSEALHR', CAST(1 + 3*(c_custkey % 8) AS INT), 3)")
    subs = t.customer.join(nation, "c_nationkey").select(
        F.col("c_custkey").cast("string").alias("client_id"), F.lit("s").alias("subscription_id"), F.array(place).alias("iatas"), F.array((F.col("c_custkey") % 9).cast("int")).alias("region_ids"), F.array("slug").alias("region_slugs")
    )
    return jobs.expand_subscription_places(subs, t.regions, t.region_iatas).select("client_id", F.array_join("iatas", ",").alias("iatas"))


# -- at volume ---------------------------------------------------------------------------------------------------------


@query("SELECT place_id, count(*) AS observations, count(DISTINCT packet_id) AS packets, count(DISTINCT observer_id) AS observers FROM star_obs GROUP BY place_id", "star_obs")
def star_place_stats(t):
    return stats.distinct_counts(t.star_obs.select("place_id", F.col("packet_id").alias("packet_hash"), "observer_id"), ["place_id"])


@query("SELECT payload_type, count(*) AS observations, p.name FROM (SELECT packet_id, o.payload_type, n.name FROM star_packets o JOIN " + NAMES.replace("AS names", "AS n") + " USING (payload_type)) p JOIN star_obs USING (packet_id) GROUP BY ALL", "star_obs", "star_packets")
def star_payload_breakdown(t):
    rows = t.star_obs.select(F.col("packet_id").alias("packet_hash"), "heard_at")
    return stats.payload_breakdown(rows, t.star_packets.withColumnRenamed("packet_id", "packet_hash"), since=None)


@query("SELECT packet_id AS packet_hash, count(*) AS observation_count, arg_max(observer_id, (heard_at, observer_id)) AS observer_id, arg_max(place_id, (heard_at, observer_id)) AS iata FROM star_obs GROUP BY packet_id", "star_obs")
def star_latest_observation(t):
    rows = t.star_obs.select(F.col("packet_id").alias("packet_hash"), "heard_at", F.col("observer_id").alias("id"), "observer_id", F.col("place_id").alias("iata"))
    return packets.latest_observation(rows)


@query(None)
def r3_packet_detail(t):
    """One row per observation of the nested detail."""
    heard = t.paths.withColumn("rssi", (F.col("id") % 90).cast("int"))
    traced_packets = _traced_hashes(t)
    found = packets.packet_detail(traced_packets, heard, t.observers, t.scopes, t.messages, t.short_ids, t.nodes)
    rows = found.select("packet_hash", "scope", "spread_ms", F.size("route").alias("route_hops"), F.explode("observations").alias("o"))
    return rows.select("packet_hash", "scope", "spread_ms", F.when(F.col("route_hops") > 0, F.col("route_hops")).alias("route_hops"), "o.id", "o.observer_name", "o.iata", "o.rssi", "o.source_broker", "o.hash_size", "o.propagation_ms", F.array_join(F.transform("o.path", lambda x: x["confidence"]), ",").alias("path"))


ORACLES["r3_packet_detail"] = with_views(
    f"""WITH {RESOLVED}, pt AS (SELECT id, string_agg({CONFIDENCE}, ',' ORDER BY pos) AS path FROM resolved GROUP BY id)
 SELECT o.packet_hash, s.name AS scope, epoch_us(max(o.heard_at) OVER w) // 1000 - epoch_us(min(o.heard_at) OVER w) // 1000 AS spread_ms, p.trace_hops AS route_hops, o.id, v.display_name AS observer_name, o.iata, CAST(o.id % 90 AS INT) AS rssi, o.source_broker, o.hash_size, epoch_us(o.heard_at) // 1000 - epoch_us(min(o.heard_at) OVER w) // 1000 AS propagation_ms, pt.path
 FROM obs o JOIN packets p USING (packet_hash) LEFT JOIN scopes s ON s.scope_id = p.scope_id LEFT JOIN observers v ON v.observer_id = o.observer_id LEFT JOIN pt ON pt.id = o.id WINDOW w AS (PARTITION BY o.packet_hash)""",
    *PATH_VIEWS, "scopes", "observers",
)


from . import ingested, scalars  # noqa: E402, F401  their queries register themselves
