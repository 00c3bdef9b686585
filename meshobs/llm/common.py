"""What the training-data operators share: the scratch folder, row keys and gapless ranks.

Every intermediate result that is read more than once is written as a Parquet table below
``spark.checkpoint.dir``, the folder that driver and executors share.  A lost executor then costs
only the tasks it ran, never the steps before them.
"""

from __future__ import annotations

import gc
import tempfile
from uuid import uuid4

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whether shuffle files go when a query ends, and not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII blanks that separate words: ``[\x20\x09-\x0D]``.  ``bytes.split()`` splits at exactly these.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Parquet tables of one run, in a folder of their own below the shared one."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid4().hex}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and read it back, which cuts its lineage; shuffles of the write are deleted with its end."""
        conf, kept = self.spark.conf, self.spark.conf.get(CLEAN, "false")
        conf.set(CLEAN, "true")
        try:
            df.write.options(**options).parquet(f"{self.path}/{name}")
        finally:
            conf.set(CLEAN, kept)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that are no longer read, and let the cleaner remove finished shuffles."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()


def with_row_key(docs: DataFrame, columns: list[str], scratch: Scratch, whole: list[str] | None = None) -> DataFrame:
    """``columns`` plus ``rk``, a long that names one row, and ``row``, a struct of the columns ``whole``.

    ``rk`` is ``doc_id`` where that is unique and never null.  Else a copy numbered row by row is
    written first, so that repeated rows and rows without an id still count one by one.
    """
    ids = docs.agg(
        F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.countDistinct("doc_id").alias("ids")
    ).first()
    docs = docs.select(*columns, *([F.struct(*(F.col(f"`{c}`") for c in whole)).alias("row")] if whole else []))
    if ids["n"] == ids["known"] == ids["ids"]:
        return docs.withColumn("rk", F.col("doc_id").cast("long"))
    return scratch.save(docs.withColumn("rk", F.monotonically_increasing_id()), "keyed")


def gapless_rank(
    df: DataFrame, group: list[str], order: list[Column | str], n_rows: int, out: str, rows_per_bucket: int = 20_000
) -> DataFrame:
    """Number the rows of each group from 0 without a gap, in column ``out``.

    No task holds a whole group: rows are hashed into buckets on the order columns, ranked in their
    bucket, and shifted by the sizes of the buckets before it.  ``order`` fixes the numbers; rows that
    tie in it are interchangeable.
    """
    buckets = max(1, -(-n_rows // rows_per_bucket))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    keys = [*group, "_bucket"]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*cols)) - 1)
    return ranked.join(shift, keys).withColumn(out, F.col("_rank") + F.col("_shift")).drop("_bucket", "_rank", "_shift")


def pack(values: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed: high planes are nearly empty."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(grams: np.ndarray) -> bytes:
    return pack(np.diff(grams, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def add_up(grams: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts in order, and their counts, from runs that are in order."""
    g, c = np.concatenate(grams), np.concatenate(n)
    order = np.argsort(g, kind="stable")
    g = g[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[first], np.add.reduceat(c[order], first)
