"""Exact deduplication through a log-structured merge index of text digests.

* **Memtables and runs.**  Each task gathers rows in a memtable and flushes it as a run sorted by
  digest; a run is a stretch of a Parquet file whose digest column has min/max statistics and Parquet
  Bloom filters.  Deduplicating one table never looks a digest up in them: it merges all runs at once.
* **Compaction.**  Runs merge into one entry per digest that keeps the preferred row (most code
  points, then smallest identifier) and the group's size.  It is an aggregation with map-side combine, so a
  group of copies with a third of all rows moves one entry per task.
* **Byte verification.**  Digests with more than one row are hits.  Their texts are compared byte by
  byte: a digest's texts are equal if and only if their smallest and largest are.  A digest that two
  texts share is split by the texts themselves.

Nulls: a null text counts as empty; empty and blank texts are equal to each other.  A null ``doc_id``
sorts after all others.  Repeated rows count one by one and come out one by one.  Other columns of the
input are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, with_row_key

ROWS = "rk long, doc_id long, n_chars long, digest binary, sha string"


def _parts(batch: pa.RecordBatch, digest_bytes: int) -> tuple[list, list, list, list]:
    text = pc.fill_null(batch.column("text"), "")
    bare = [b"".join(x.split()) for x in text.cast(pa.binary()).to_pylist()]
    sha = [hashlib.sha256(x) for x in bare]
    return pc.utf8_length(text).to_pylist(), [x.digest()[:digest_bytes] for x in sha], [x.hexdigest() for x in sha], bare


def flush_runs(docs: DataFrame, memtable_rows: int = 100_000, digest_bytes: int = 16) -> DataFrame:
    """One row for each of ``docs`` (``rk, doc_id, text``), in runs sorted by digest."""

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[tuple] = []

        def run() -> pa.RecordBatch:
            table.sort(key=lambda r: r[3])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = zip(*table, strict=True) if table else [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rk", "doc_id", "n_chars", "digest", "sha"]
            )

        for batch in batches:
            chars, digest, sha, _ = _parts(batch, digest_bytes)
            table += zip(batch.column("rk").to_pylist(), batch.column("doc_id").to_pylist(), chars, digest, sha, strict=True)
            if len(table) >= memtable_rows:
                yield run()
                table.clear()
        yield run()

    return docs.select("rk", F.col("doc_id").cast("long"), "text").mapInArrow(flush, ROWS)


def compact(runs: DataFrame, *keys: str) -> DataFrame:
    """One entry per digest: the row that stays and the group's size."""
    preferred = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rk")
    merged = runs.groupBy(*(keys or ["digest"])).agg(F.min(preferred).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return merged.select(*(keys or ["digest"]), F.col("best.rk").alias("keep_rk"), F.col("best.doc_id").alias("keep_id"), "group_size")


def _hit_texts(docs: DataFrame, hits: np.ndarray, digest_bytes: int) -> DataFrame:
    """Digest and bare text of the rows whose digest the filter of hits lets through."""
    held = docs.sparkSession.sparkContext.broadcast(hits)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, digest, _, bare = _parts(batch, digest_bytes)
            if not digest:
                continue
            first = np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in digest), np.int64)
            for at in np.array_split(np.flatnonzero(bloom.maybe(held.value, first.view(np.uint64))), max(1, len(bare) // 500)):
                yield pa.RecordBatch.from_arrays([pa.array([digest[i] for i in at], pa.binary()), pa.array([bare[i] for i in at], pa.binary())], ["digest", "bare"])

    return docs.select("text").mapInArrow(texts, "digest binary, bare binary")


def _first_bytes(digests: DataFrame) -> DataFrame:
    def longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(x[:8].ljust(8, b"\0") for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64))], ["k"])

    return digests.mapInArrow(longs, "k long")


def _split(docs: DataFrame, runs: DataFrame, shared: DataFrame, digest_bytes: int) -> DataFrame:
    """The runs again, with the bare text in ``split`` where different texts share a digest."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, digest, sha, bare = _parts(batch, digest_bytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rk"), batch.column("doc_id"), pa.array(chars, pa.int64()), pa.array(digest, pa.binary()), pa.array(sha, pa.string()), pa.array(bare, pa.binary())],
                ["rk", "doc_id", "n_chars", "digest", "sha", "split"],
            )

    again = docs.select("rk", F.col("doc_id").cast("long"), "text").mapInArrow(texts, f"{ROWS}, split binary")
    return runs.join(shared, "digest", "left_anti").unionByName(again.join(shared, "digest", "left_semi"))


def index_rows(docs: DataFrame, scratch: Scratch, memtable_rows: int = 100_000, digest_bytes: int = 16) -> DataFrame:
    """``rk, doc_id, keep_rk, keep_id, group_size, sha`` for each of ``docs`` (``rk, doc_id, text``)."""
    runs = scratch.save(flush_runs(docs, memtable_rows, digest_bytes), "runs", **{"parquet.bloom.filter.enabled#digest": "true"})
    index = scratch.save(compact(runs), "index")
    hits = index.filter("group_size > 1").select("digest")
    if n_hits := hits.count():
        texts = _hit_texts(docs, bloom.build(_first_bytes(hits), n_hits), digest_bytes)
        checked = texts.groupBy("digest").agg((F.min("bare") != F.max("bare")).alias("differs"))
        shared = scratch.save(checked.filter("differs").select("digest"), "shared")
        if not shared.isEmpty():
            bare = F.lit(None).cast("binary").alias("split")
            runs = scratch.save(_split(docs, runs.select("*", bare), shared, digest_bytes), "runs-split")
            index = scratch.save(compact(runs, "digest", "split"), "index-split")
            return runs.alias("r").join(
                index.alias("i"), (F.col("r.digest") == F.col("i.digest")) & F.col("r.split").eqNullSafe(F.col("i.split"))
            ).select("rk", "doc_id", "keep_rk", "keep_id", "group_size", "sha")
    return runs.join(index, "digest").select("rk", "doc_id", "keep_rk", "keep_id", "group_size", "sha")


def exact_dedup(docs: DataFrame, memtable_rows: int = 100_000, digest_bytes: int = 16) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    ``digest_bytes`` is how much of the SHA-256 the index keeps; byte verification makes any length right.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = index_rows(with_row_key(docs, ["doc_id", "text"], scratch), scratch, memtable_rows, digest_bytes)
    return rows.select("doc_id", "keep_id", "group_size", (F.col("rk") == F.col("keep_rk")).alias("kept"), F.col("sha").alias("text_sha256"))


def survivors(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the row that stays of each group of equal texts."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    keyed = with_row_key(docs, ["doc_id", "text"], scratch, columns)
    stay = index_rows(keyed, scratch).filter("rk = keep_rk").select("rk")
    return keyed.join(stay, "rk", "left_semi").select("row.*")
