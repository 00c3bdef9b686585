"""Configured dimensions: airports, places, regions, scopes and channel keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X


def load_airports(spark: SparkSession, csv: str) -> DataFrame:
    """``iata, country, continent`` from an airport list in CSV with columns ``iata_code, iso_country, continent``."""
    raw = spark.read.csv(csv, header=True)
    cols = {c.lower(): c for c in raw.columns}
    named = raw.select(*(F.trim(F.col(f"`{cols[c]}`")).alias(n) for c, n in (("iata_code", "iata"), ("iso_country", "country"), ("continent", "continent"))))
    one = named.filter("length(iata) = 3 AND country <> '' AND continent <> ''").groupBy(F.upper("iata").alias("iata")).agg(F.min(F.struct("country", "continent")).alias("p"))
    return one.select("iata", "p.country", "p.continent")  # of a place listed twice, one row whole


def iata_dim(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """``iata, display_name, approx_lat, approx_lng``; a place named twice keeps its last details."""
    found = spark.createDataFrame(list({r[0].upper(): (r[0].upper(), *r[1:]) for r in rows}.values()), "iata string, display_name string, approx_lat double, approx_lng double")
    return found


def region_dim(spark: SparkSession, rows: Sequence[tuple[str, str, Sequence[str]]]) -> tuple[DataFrame, DataFrame]:
    """Regions ``region_id, slug, name, display_order`` and members ``region_id, iata`` from (slug, name, places)."""
    regions = [(k, slug, name, k) for k, (slug, name, _) in enumerate(rows, 1)]
    members = [(k, p.upper()) for k, (_, _, places) in enumerate(rows, 1) for p in dict.fromkeys(places)]
    return spark.createDataFrame(regions, "region_id int, slug string, name string, display_order int"), spark.createDataFrame(members, "region_id int, iata string")


def scope_dim(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``scope_id, name, transport_key, key_fingerprint``; names are normalised and count once."""
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names, 1)], "k int, name string").withColumn("name", X.normalize_scope_name(F.col("name")))
    first = rows.groupBy("name").agg(F.min("k").alias("scope_id")).withColumn("transport_key", X.derive_scope_key(F.col("name")))
    return first.select("scope_id", "name", "transport_key", X.scope_fingerprint(F.col("transport_key")).alias("key_fingerprint"))


def key_dim(spark: SparkSession, hashtags: Sequence[str], keys: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """``channel_hash, key_fingerprint, secret, name, load_order`` of hashtag channels and of explicit (name, secret) pairs; equal keys count once."""
    tags = [(k, t if t.startswith("#") else f"#{t}", None) for k, t in enumerate(hashtags)]
    rows = spark.createDataFrame([*tags, *((len(tags) + k, n, s.lower()) for k, (n, s) in enumerate(keys))], "load_order int, name string, secret string")
    derived = F.when(F.col("secret").isNull(), X.derive_hashtag_key(F.col("name"))).otherwise(X.channel_key(F.col("secret")))
    found = rows.select("load_order", "name", derived.alias("k")).select("load_order", "name", "k.*")
    return found.groupBy("channel_hash", "key_fingerprint", "secret").agg(F.min_by("name", "load_order").alias("name"), F.min("load_order").alias("load_order"))


def list_iatas(iatas: DataFrame) -> DataFrame:
    """R17."""
    return iatas.orderBy("iata")


def list_regions(regions: DataFrame) -> DataFrame:
    """By display order, then name."""
    order = ["display_order", "name"] if "display_order" in regions.columns else ["name"]
    return regions.orderBy(*order)


def region_members(regions: DataFrame, members: DataFrame) -> DataFrame:
    """Places of each region, in order."""
    return regions.join(members, "region_id").orderBy("region_id", "iata")
