"""Resolving hop prefixes to known nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X


def candidates_by_prefix(short_ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """``iata, hop, node_ids``: repeaters and room servers by place and each prefix of 1 to 4 bytes.

    Candidates are gathered per prefix before any join, so hops never multiply; a hop's own length keeps the widths apart.
    """
    relays = short_ids.join(nodes.filter(F.col("node_type").isin(X.REPEATER, X.ROOM_SERVER)).select("node_id"), "node_id", "left_semi")
    prefixes = F.explode(F.array(*(X.key_prefix(F.col("prefix_4"), n) for n in (1, 2, 3, 4)))).alias("hop")
    return relays.select("iata", "node_id", prefixes).groupBy("iata", "hop").agg(F.sort_array(F.collect_set("node_id")).alias("node_ids"))


def count_candidates(hops: DataFrame, short_ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hops`` with ``candidates`` and ``confidence`` but without the candidates, whose lists grow with the nodes of a place."""
    prefixes = F.explode(F.array(*(X.key_prefix(F.col("prefix_4"), n) for n in (1, 2, 3, 4)))).alias("hop")
    relays = short_ids.join(nodes.filter(F.col("node_type").isin(X.REPEATER, X.ROOM_SERVER)).select("node_id"), "node_id", "left_semi")
    counts = relays.select("iata", prefixes, "node_id").groupBy("iata", "hop").agg(F.count_distinct("node_id").cast("int").alias("candidates"))
    found = hops.join(counts, ["iata", "hop"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return found.withColumn("confidence", X.hop_confidence(F.col("candidates")))


def relay_prefixes(short_ids: DataFrame, nodes: DataFrame, *, node_iatas: DataFrame | None = None) -> DataFrame:
    """``iata, hop, node_id, first_heard`` of repeaters and room servers by each prefix of 1 to 4 bytes.

    ``first_heard`` is when ``node_iatas`` says that the place first heard the node; null without it, which stands for always.
    """
    relays = short_ids.select("node_id", "iata", "prefix_4").join(nodes.filter(F.col("node_type").isin(X.REPEATER, X.ROOM_SERVER)).select("node_id"), "node_id", "left_semi")
    if node_iatas is not None:
        relays = relays.join(node_iatas.select("node_id", "iata", "first_heard"), ["node_id", "iata"])
    else:
        relays = relays.withColumn("first_heard", F.lit(None).cast("timestamp"))
    prefixes = F.explode(F.array(*(X.key_prefix(F.col("prefix_4"), n) for n in (1, 2, 3, 4)))).alias("hop")
    return relays.select("iata", prefixes, "node_id", "first_heard").distinct()


def unique_intervals(prefixes: DataFrame) -> DataFrame:
    """J6 as of arrival: ``iata, hop, node_id, since, until`` of prefixes that stand for one node at some time.

    A prefix is unique from when its place hears the first of its nodes until it hears the second, so its first two times say all, whatever
    the number of candidates; two rows of a key at most leave a task.  Null ends are open.
    """
    order = Window.partitionBy("iata", "hop").orderBy("first_heard", "node_id")
    two = prefixes.withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
    found = two.groupBy("iata", "hop").agg(
        F.min_by("node_id", "_n").alias("node_id"), F.min("first_heard").alias("since"), F.max(F.when(F.col("_n") == 2, F.col("first_heard"))).alias("until"), F.max("_n").alias("_n")
    )
    return found.filter("_n = 1 OR since < until").drop("_n")


def came(df: DataFrame) -> Column:
    """When a row came; observations without an arrival time count as come when heard."""
    return F.col("arrival_ts" if "arrival_ts" in df.columns else "heard_at")


def within(when: Column) -> Column:
    """Whether ``when`` lies in the row's ``since`` and ``until``."""
    return (F.col("since").isNull() | (when >= F.col("since"))) & (F.col("until").isNull() | (when < F.col("until")))


def unique_paths(obs: DataFrame, intervals: DataFrame) -> DataFrame:
    """``iata, path_bytes, hash_size, node_ids, hash_prefix, since, until`` of distinct paths of two hops or more, all of them unique at some time.

    Each distinct path is resolved once, however many observations it has: it is unique while all its hops are.
    """
    hops = F.floor(F.length("path_bytes") / (2 * F.col("hash_size")))
    key = ["iata", "path_bytes", "hash_size"]
    paths = obs.select(*key).withColumn("n_hops", hops).filter("n_hops >= 2").distinct()
    steps = paths.select(*key, "n_hops", F.posexplode(X.split_path(F.col("path_bytes"), F.col("hash_size"))).alias("pos", "hop")).join(intervals, ["iata", "hop"])
    whole = steps.groupBy(*key, "n_hops").agg(
        F.sort_array(F.collect_list(F.struct("pos", "hop", "node_id"))).alias("steps"), F.max("since").alias("since"), F.min("until").alias("until")
    )
    known = whole.filter("size(steps) = n_hops AND (since IS NULL OR until IS NULL OR since < until)")
    return known.select(*key, F.col("steps.node_id").alias("node_ids"), F.col("steps.hop").alias("hash_prefix"), "since", "until")


def explode_hops(obs: DataFrame) -> DataFrame:
    """``id, packet_hash, iata, pos, hop`` of observations with ``path_bytes`` and ``hash_size``."""
    return obs.select("id", "packet_hash", "iata", F.posexplode(X.split_path(F.col("path_bytes"), F.col("hash_size"))).alias("pos", "hop"))


def resolve_hops(hops: DataFrame, short_ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hops`` with ``node_ids`` and ``confidence``.

    Distinct (place, hop) pairs are few, 256 per place for one byte; they are resolved once and joined back.
    """
    found = hops.join(candidates_by_prefix(short_ids, nodes), ["iata", "hop"], "left")
    n = F.coalesce(F.size("node_ids"), F.lit(0))
    return found.withColumns({"candidates": F.greatest(n, F.lit(0)), "confidence": X.hop_confidence(F.greatest(n, F.lit(0)))})


def resolve_paths(obs: DataFrame, short_ids: DataFrame, nodes: DataFrame, *, node_iatas: DataFrame | None = None, as_of_arrival: bool = False) -> DataFrame:
    """The hops of every observation with confidence and candidates, in the observation's place.

    With ``as_of_arrival`` a candidate counts only if ``node_iatas`` says that it was heard there by then.
    """
    hops = explode_hops(obs)
    if not as_of_arrival:
        return resolve_hops(hops, short_ids, nodes)
    known = short_ids.join(node_iatas.select("node_id", "iata", "first_heard"), ["node_id", "iata"])
    relays = known.join(nodes.filter(F.col("node_type").isin(X.REPEATER, X.ROOM_SERVER)).select("node_id"), "node_id", "left_semi")
    prefixes = F.explode(F.array(*(X.key_prefix(F.col("prefix_4"), n) for n in (1, 2, 3, 4)))).alias("hop")
    by_prefix = relays.select("iata", prefixes, F.struct("first_heard", "node_id").alias("c")).groupBy("iata", "hop").agg(F.collect_list("c").alias("cs"))
    timed = hops.join(obs.select("id", "arrival_ts"), "id").join(by_prefix, ["iata", "hop"], "left")
    fit = F.sort_array(F.transform(F.filter(F.coalesce("cs", F.array().cast(by_prefix.schema["cs"].dataType)), lambda c: c["first_heard"] <= F.col("arrival_ts")), lambda c: c["node_id"]))
    timed = timed.withColumn("node_ids", fit).drop("cs", "arrival_ts")
    return timed.withColumns({"candidates": F.size("node_ids"), "confidence": X.hop_confidence(F.size("node_ids"))})


def node_capabilities(obs: DataFrame, prefixes: DataFrame, *, existing: DataFrame | None = None) -> DataFrame:
    """``node_id, multibyte_paths, multibyte_traces`` for every candidate of every hop of two bytes or more; true stays true.

    ``obs`` has ``payload_type``, ``prefixes`` is what ``relay_prefixes`` gives.  Observations without such hops go first; the others are counted down to the last
    time that each prefix of a place came in either kind, and only those few rows meet the candidates.
    """
    trace = F.col("payload_type") == X.PAYLOAD_TRACE
    kinds = {"multibyte_paths": ~trace & F.col("hash_size").isin(2, 3), "multibyte_traces": trace & F.col("hash_size").isin(2, 4)}
    wide = obs.withColumns(kinds).filter("multibyte_paths OR multibyte_traces")
    hops = wide.select("iata", F.explode(X.split_path(F.col("path_bytes"), F.col("hash_size"))).alias("hop"), *kinds, came(obs).alias("came"))
    last = hops.groupBy("iata", "hop").agg(*(F.max(F.when(F.col(k), F.col("came"))).alias(k) for k in kinds))
    met = last.join(prefixes, ["iata", "hop"])
    by_then = {k: F.col(k).isNotNull() & (F.col("first_heard").isNull() | (F.col("first_heard") <= F.col(k))) for k in kinds}
    seen = met.select("node_id", *(c.alias(k) for k, c in by_then.items())).filter("multibyte_paths OR multibyte_traces")
    seen = seen if existing is None else seen.unionByName(existing.select(*seen.columns))
    return seen.groupBy("node_id").agg(*(F.bool_or(k).alias(k) for k in kinds))
