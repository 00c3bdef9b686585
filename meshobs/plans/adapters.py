"""Domain tables derived from the star-schema tables, so that every operator can be run and checked on them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

#: Views in SQL that both Spark and DuckDB read; each may use those before it.
VIEWS = {
    "obs": """SELECT event_id AS id, CAST(floor(event_id/4) AS BIGINT) AS packet_no,
  substr(md5(CAST(CAST(floor(event_id/4) AS BIGINT) AS STRING)),1,16) AS packet_hash,
  user_id AS observer_id, substr('YVRYYJYYCYEGYOWYYZSEALHR', CAST(1 + 3*(user_id % 8) AS INT), 3) AS iata, ts AS heard_at,
  CAST(1 + CAST(floor(event_id/4) AS BIGINT) % 3 AS INT) AS hash_size, CAST(event_id % 5 AS INT) AS hop_count,
  value AS snr, CASE WHEN event_id % 2 = 0 THEN 'mqtt1' ELSE 'mqtt2' END AS source_broker
FROM events""",
    "packets": """SELECT packet_hash, packet_no, CAST(packet_no % 12 AS INT) AS payload_type, CAST(packet_no % 4 AS INT) AS route_type,
  CASE WHEN packet_no % 4 IN (0,3) AND packet_no % 5 <> 0 THEN CAST(1 + packet_no % 3 AS INT) END AS scope_id,
  packet_no % n AS origin_node, md5('n' || CAST(packet_no % n AS STRING)) AS origin_pubkey,
  CASE WHEN packet_no % 12 = 5 THEN substr(md5('c' || CAST(packet_no % 7 AS STRING)),1,2) END AS channel_hash,
  CASE WHEN packet_no % 12 = 9 THEN substr(md5('t' || CAST(CAST(floor(packet_no/36) AS BIGINT) AS STRING)),1,8) END AS trace_tag,
  CASE WHEN packet_no % 12 = 9 THEN CAST(1 + CAST(floor(packet_no/12) AS BIGINT) % 4 AS INT) END AS trace_hops,
  first_heard_at, last_heard_at
FROM (SELECT packet_hash, packet_no, min(heard_at) AS first_heard_at, max(heard_at) AS last_heard_at FROM obs GROUP BY packet_hash, packet_no) p CROSS JOIN (SELECT count(*) AS n FROM customer) c""",
    "nodes": """SELECT c_custkey AS node_id, md5('n' || CAST(c_custkey AS STRING)) AS public_key,
  substr('YVRYYJYYCYEGYOWYYZSEALHR', CAST(1 + 3*(c_custkey % 8) AS INT), 3) AS home_iata, c_name AS name,
  CASE WHEN CAST(floor(c_custkey/8) AS BIGINT) % 6 = 0 THEN 1 WHEN CAST(floor(c_custkey/8) AS BIGINT) % 6 = 5 THEN 4
       WHEN CAST(floor(c_custkey/8) AS BIGINT) % 2 = 0 THEN 2 ELSE 3 END AS node_type,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(1 + c_custkey % 3 AS INT) END AS default_scope_id
FROM customer""",
    "short_ids": "SELECT node_id, home_iata AS iata, substr(public_key,1,8) AS prefix_4 FROM nodes",
    "hops": """SELECT o.id, o.packet_hash, o.iata, h.pos,
  substr(md5('n' || CAST(8*((o.packet_no*31 + h.pos*17) % c.n) + (o.observer_id % 8) AS STRING)),1,2*o.hash_size) AS hop
FROM obs o CROSS JOIN (SELECT CAST(floor(count(*)/8) AS BIGINT) AS n FROM customer) c JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) h ON h.pos < o.hop_count""",
    "observers": """SELECT observer_id, CASE WHEN observer_id % 4 = 0 THEN md5('n' || CAST(observer_id AS STRING)) ELSE md5('o' || CAST(observer_id AS STRING)) END AS public_key, 'obs-' || CAST(observer_id AS STRING) AS display_name,
  CASE WHEN observer_id % 3 = 0 THEN 'unknown' WHEN observer_id % 3 = 1 THEN 'bridge' ELSE 'ha' END AS observer_type,
  CASE WHEN observer_id % 10 = 0 THEN NULL ELSE CASE WHEN observer_id % 2 = 0 THEN '910.525,62.5,7' ELSE '915,250,10' END END AS preset,
  max(heard_at) AS last_status_at, max(heard_at) AS last_seen, count(*) - 1 AS observation_count
FROM obs GROUP BY observer_id""",
    "scopes": "SELECT 1 AS scope_id, '#bc' AS name UNION ALL SELECT 2, '#west' UNION ALL SELECT 3, '$private' UNION ALL SELECT 4, '#unused'",
    "observer_scopes": """SELECT o.observer_id, p.scope_id, min(o.heard_at) AS first_seen, max(o.heard_at) AS last_seen
FROM obs o JOIN packets p ON p.packet_hash = o.packet_hash WHERE p.scope_id IS NOT NULL GROUP BY o.observer_id, p.scope_id""",
    "node_iatas": """SELECT p.origin_node AS node_id, o.iata, min(o.heard_at) AS first_heard, max(o.heard_at) AS last_heard, count(*) AS observation_count
FROM obs o JOIN packets p ON p.packet_hash = o.packet_hash WHERE p.payload_type = 4 GROUP BY p.origin_node, o.iata""",
    "known_ids": "SELECT s.node_id, s.iata, s.prefix_4 FROM short_ids s JOIN customer c ON c.c_custkey = s.node_id WHERE c.c_acctbal >= 0",
    "telemetry": """SELECT event_id AS id, user_id AS observer_id, date_trunc('hour', ts) AS reported_at, CAST(3000 + event_id % 1200 AS INT) AS battery_mv,
  value AS airtime_tx, value * 2 AS airtime_rx, -120 + value / 10 AS noise_floor, event_id * 60 AS uptime_s, CAST(event_id % 9 AS INT) AS queue_len,
  CAST(event_id % 50 AS INT) AS recv_errors FROM events""",
    "messages": """SELECT c.conv_id*1000 + c.turn AS id, CAST(1 + p.packet_no % 7 AS INT) AS channel_id, p.packet_hash, p.channel_hash, c.role AS sender_name, c.text AS content, p.first_heard_at AS sent_at
FROM conversations c CROSS JOIN (SELECT count(*) AS n FROM packets WHERE payload_type = 5) g JOIN packets p ON p.packet_no = 12*((c.conv_id*8 + c.turn) % g.n) + 5""",
    "regions": "SELECT r_regionkey AS region_id, lower(r_name) AS slug, r_name AS name FROM region",
    "region_iatas": """SELECT CAST(i % 5 AS INT) AS region_id, substr('YVRYYJYYCYEGYOWYYZSEALHR', 1 + 3*i, 3) AS iata
FROM (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) t""",
    "star_obs": """SELECT l.l_orderkey AS packet_id, l.l_suppkey AS observer_id, CAST(s.s_nationkey AS BIGINT) AS place_id, l.l_shipdate AS heard_at, l.l_quantity AS snr
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "star_packets": """SELECT o_orderkey AS packet_id, CAST(substr(o_orderpriority,1,1) AS INT) AS payload_type, o_orderstatus AS route, o_custkey AS origin_node, o_orderdate AS first_heard_at FROM orders""",
}
#: The views and tables that each view reads.
NEEDS = {
    "obs": ["events"], "packets": ["obs", "customer"], "nodes": ["customer"], "short_ids": ["nodes"], "hops": ["obs", "customer"], "observers": ["obs"], "scopes": [], "observer_scopes": ["obs", "packets"],
    "node_iatas": ["obs", "packets"], "telemetry": ["events"], "messages": ["conversations", "packets"], "known_ids": ["short_ids", "customer"], "regions": ["region"], "region_iatas": [], "star_obs": ["lineitem", "supplier"], "star_packets": ["orders"],
}


class Tables:
    """The domain tables over one folder of Parquet tables; ``tables.obs`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # times of the tables have no zone and mean UTC

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NEEDS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in self._known:
            self._known[name] = self._view(name)
        return self._known[name]

    def _view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        frames = {n: getattr(self, n) for n in NEEDS[name]}
        for n in frames:
            sql = _rename(sql, n)
        return self.spark.sql(sql, **frames)

    @property
    def paths(self) -> DataFrame:
        """Observations with ``path_bytes`` put together from the hops view."""
        steps = F.array_sort(F.collect_list(F.struct("pos", "hop")))
        joined = self.hops.groupBy("id").agg(F.array_join(F.transform(steps, lambda x: x["hop"]), "").alias("path_bytes"))
        return self.obs.join(joined, "id", "left").withColumn("path_bytes", F.coalesce("path_bytes", F.lit("")))


def _rename(sql: str, name: str) -> str:
    """Spark names a DataFrame argument ``{name}``."""
    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views, and those they need, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name in VIEWS and name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}" if ctes else body
    return f"WITH {ctes}\n{body}" if ctes else body
