"""Tables that micro-batches keep below a folder, one folder per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..operators.filters import RULES, merge_by_key


class Store:
    """Folders ``table/batch=N`` below ``path``.  A batch writes its own folder only, over what an earlier try left there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _numbers(self, table: str, kind: str, before: int | None) -> list[int]:
        """Whole folders, which a marker file shows."""
        fs, root = self._fs(f"{self.path}/{table}" if table else self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        whole = [n for n in found if fs.exists(self._fs(f"{root.toString()}/{kind}={n}/_SUCCESS")[1])]
        return sorted(n for n in whole if before is None or n < before)

    def _read(self, table: str, numbers: list[int]) -> DataFrame | None:
        """Rows of some batches, with their ``batch``."""
        if not numbers:
            return None
        folders = [f"{self.path}/{table}/batch={n}" for n in numbers]
        schema = self.spark.read.parquet(folders[-1]).schema
        return self.spark.read.schema(schema.add("batch", IntegerType())).option("basePath", f"{self.path}/{table}").parquet(*folders)

    def append(self, table: str, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={number}")

    def read_batch(self, table: str, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}/batch={number}")

    def appended(self, table: str, before: int | None) -> DataFrame | None:
        """The rows of all batches before a number."""
        found = self._read(table, self._numbers(table, "batch", before))
        return None if found is None else found.drop("batch")

    def merged(self, table: str, keys: list[str], rules: Callable[[list[str]], dict[str, str]], before: int | None = None) -> DataFrame | None:
        """One row per key: what the batches wrote of it, merged in their order."""
        rows = self._read(table, self._numbers(table, "batch", before))
        if rows is None:
            return None
        how = rules([c for c in rows.columns if c not in (*keys, "batch")])
        return rows.withColumnRenamed("batch", "_age").groupBy(*keys).agg(*(RULES[rule](c).alias(c) for c, rule in how.items()))

    def compact(self, table: str, df: DataFrame, number: int) -> None:
        """Replace the batches before ``number`` by ``df``, which was read from them and written elsewhere since.  Batch ``number`` itself may be run again, so its folder stays its own."""
        self.append(table, df, number - 1)
        self.forget(table, number - 2)

    def append_by_day(self, table: str, df: DataFrame, ts: str, number: int) -> None:
        """The rows of a batch in partitions of its own, ``day=D/batch=N``; one that is run again replaces exactly these."""
        parts = df.withColumns({"day": F.to_date(ts), "batch": F.lit(number)})
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.path}/{table}")

    def by_day(self, table: str, since: Column | None = None, until: Column | None = None) -> DataFrame | None:
        """The rows of all batches; days outside of ``since`` and ``until`` are not read."""
        fs, root = self._fs(f"{self.path}/{table}")
        if not fs.exists(root) or not any(s.getPath().getName().startswith("day=") for s in fs.listStatus(root)):
            return None
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        for bound, keep in ((since, lambda b: F.col("day") >= F.to_date(b)), (until, lambda b: F.col("day") <= F.to_date(b))):
            rows = rows if bound is None else rows.filter(keep(bound))
        return rows.drop("day", "batch")

    def drop_days(self, table: str, before: str) -> list[str]:
        """Remove the folders of days before ``before`` (``YYYY-MM-DD``); their names."""
        fs, root = self._fs(f"{self.path}/{table}")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        old = sorted(n for n in names if n.startswith("day=") and n[4:] < before)
        for n in old:
            fs.delete(self._fs(f"{self.path}/{table}/{n}")[1], True)
        return old

    def latest(self, table: str, before: int | None) -> DataFrame | None:
        """What the newest batch wrote."""
        numbers = self._numbers(table, "batch", before)
        return self.spark.read.parquet(f"{self.path}/{table}/batch={numbers[-1]}") if numbers else None

    def forget(self, table: str, upto: int) -> None:
        for n in self._numbers(table, "batch", upto + 1):
            fs, old = self._fs(f"{self.path}/{table}/batch={n}")
            fs.delete(old, True)

    def write_delta(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/delta={number}")

    def folded(self, keys: list[str], rules: dict[str, str], upto: int | None = None, base_before: int | None = None) -> DataFrame:
        """The last base (before ``base_before``), merged with the deltas after it up to batch ``upto`` in their order."""
        bases = self._numbers("", "base", base_before)
        deltas = [n for n in self._numbers("", "delta", None if upto is None else upto + 1) if not bases or n > bases[-1]]
        out = self.spark.read.parquet(f"{self.path}/base={bases[-1]}") if bases else None
        for n in deltas:
            out = merge_by_key(out, self.spark.read.parquet(f"{self.path}/delta={n}"), keys, rules)
        return out

    def compact_deltas(self, keys: list[str], rules: dict[str, str], number: int) -> None:
        """Write the table at batch ``number`` as a base; remove what the base before it had replaced."""
        older = self._numbers("", "base", number)
        self.folded(keys, rules, number, number).write.mode("overwrite").parquet(f"{self.path}/base={number}")
        if older:
            for kind, before in (("base", older[-1]), ("delta", older[-1] + 1)):
                for n in self._numbers("", kind, before):
                    fs, old = self._fs(f"{self.path}/{kind}={n}")
                    fs.delete(old, True)
