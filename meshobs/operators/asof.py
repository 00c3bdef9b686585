"""Values as they stood when a row came, in arrival order, without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, updates: DataFrame, keys: Sequence[str], value: str, *, largest: bool = False) -> DataFrame:
    """``rows`` with ``value``: of ``updates`` whose ``seq`` is not above the row's, per key, the last ``value`` that is not null, or the ``largest``.

    Both have the keys, ``seq`` and ``arrival_ts``.  They are cut into days: within a day a window carries the value on, and what stands at the
    start of a day comes from a table of one row per key and day.  So the rows of a busy key spread over its days.
    """
    kind = updates.schema[value].dataType
    left = rows.select(*keys, "seq", F.to_date("arrival_ts").alias("_day"), F.struct(*(F.col(c) for c in rows.columns)).alias("_row"), F.lit(None).cast(kind).alias("_value"))
    right = updates.select(*keys, "seq", F.to_date("arrival_ts").alias("_day"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value")).filter(F.col("_value").isNotNull())
    both = left.unionByName(right)
    daily = right.groupBy(*keys, "_day").agg((F.max("_value") if largest else F.max_by("_value", "seq")).alias("_of_day"))
    days = both.select(*keys, "_day").distinct().join(daily, [*keys, "_day"], "left")
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys, "_day").orderBy("seq", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    running = (lambda c, w: F.max(c).over(w)) if largest else (lambda c, w: F.last(c, ignorenulls=True).over(w))
    days = days.select(*keys, "_day", running("_of_day", before).alias("_carried"))
    found = both.withColumn("_now", running("_value", so_far)).filter("_row IS NOT NULL").join(days, [*keys, "_day"])
    use = F.greatest("_now", "_carried") if largest else F.coalesce("_now", "_carried")
    return found.select("_row.*", use.alias(value))
