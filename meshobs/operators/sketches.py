"""Distinct counts that merge: per place and hour a sketch of the packets and one of the observers.

A sketch has a fixed size, and the union of two is the sketch of both inputs together.  So hours fold across batches, any window reads hours
and not rows, and places add up, none of which exact distinct counts can do.  The exact jobs are in ``stats``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import filter_iatas, merge_by_key

#: Bits of a sketch's size: 2**14 registers, a relative error of 0.8% (one standard deviation); small counts are exact.
PRECISION = 14
KEY = ["iata", "hour"]
#: How hours of two batches merge.
RULES = {"observations": "sum", "packets": "sketch", "observers": "sketch"}


def hourly_sketches(obs: DataFrame) -> DataFrame:
    """``iata, hour, observations`` and sketches of the distinct ``packets`` and ``observers``."""
    hours = obs.groupBy("iata", F.date_trunc("hour", "heard_at").alias("hour"))
    return hours.agg(F.count(F.lit(1)).alias("observations"), F.hll_sketch_agg("packet_hash", PRECISION).alias("packets"), F.hll_sketch_agg("observer_id", PRECISION).alias("observers"))


def merge_hours(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Hours of earlier batches with those of a new one."""
    return merge_by_key(existing, new, KEY, RULES)


def sketched_counts(hours: DataFrame, by: Sequence[str] = (), *, since=None, iatas: list[str] | None = None) -> DataFrame:
    """A1, A2: observations, and estimates of distinct packets, observers and places, of the hours from ``since`` on, for each ``by`` or in all."""
    wanted = filter_iatas(hours, iatas)
    wanted = wanted if since is None else wanted.filter(F.col("hour") >= since)
    union = {c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in ("packets", "observers")}
    return wanted.groupBy(*by).agg(F.coalesce(F.sum("observations"), F.lit(0)).alias("observations"), *union.values(), F.countDistinct("iata").alias("places"))
