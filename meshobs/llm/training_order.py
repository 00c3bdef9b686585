"""Training-order materialisation: every sequence gets a global slot by a keyed permutation.

Texts become token ids.  Documents are dealt to streams by a hash of their id, and lie in order of their ids in each; a stream's ids, with an end token after
every document, are cut into sequences of fixed length (a stream's last one is filled up with the end token).  Sequences are
numbered through all streams, so the numbers depend on the documents and the number of streams alone, not on how files or tasks split them.  A Feistel network with
a secret key permutes the numbers: it is a bijection of the smallest even-bit range that holds them, and numbers it throws beyond the end are permuted again until
they fall inside (cycle-walking).  No sort, no random numbers to store: a slot can be computed from a number alone
and a number from a slot.  Rows are then partitioned by ranges of slots, some shards to a partition, and written in slot order as records of a
fixed stride, so a reader seeks to ``slot * stride`` and goes on sequentially.

Nulls: a null text is empty; an empty text adds only its end token.  A null ``doc_id`` stays null.  Repeated rows count
one by one, and copies of one row are dealt to streams singly; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import mix64
from .bpe_ids import json_coder
from .common import Scratch

ROUNDS = 6
#: Records that a dictionary for compressing the others is made from, and its bytes; it decides how small they get, never what they hold.
DICTIONARY_RECORDS, DICTIONARY_BYTES = 2000, 112_640
#: Bytes of text in a stream, and the most streams and partitions.
STREAM, STREAMS, PARTITIONS = 16 << 20, 65_536, 20_000
#: Copies of one row that a task makes.
COPIES = 1000
RECORD = "slot long, shard int, byte_offset long, seq long, doc_id long, start long, n_tokens int, record_crc32 long, record binary"


def round_keys(key: str) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(key.encode()).digest() * 2, "<u8")[:ROUNDS]


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def _feistel(x: np.ndarray, n: int, keys: np.ndarray, back: bool) -> np.ndarray:
    half = np.uint64(_half_bits(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix64(left ^ k) & mask), left
        else:
            left, right = right, left ^ (mix64(right ^ k) & mask)
    return left << half | right


def permute(x: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """The permutation of ``range(n)`` that ``key`` names, or its inverse."""
    keys, out = round_keys(key), np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _feistel(out[todo], n, keys, back)
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def dealt_documents(docs: DataFrame, streams: int | None) -> tuple[DataFrame, int]:
    """``stream, doc_id, tie, text`` and the number of streams; ``tie`` orders rows of one id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.countDistinct("doc_id").alias("ids"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    if streams is None:
        streams = min(max(1, seen["size"] // STREAM), STREAMS)
    if seen["n"] == seen["known"] == seen["ids"]:
        rows = rows.withColumn("tie", F.lit(""))
    else:  # copies of one row are alike: each gets its number, so that many of them do not meet in one stream
        same = rows.groupBy("doc_id", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
        # Many copies are made by many tasks, some to each.
        some = same.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("doc_id", "sha", "part")
        copies = F.sequence(F.col("part") * COPIES + 1, F.least("n", (F.col("part") + 1) * COPIES))
        rows = some.select("doc_id", "text", "sha", F.explode(copies).alias("copy")).withColumn("tie", F.format_string("%s-%012d", "sha", "copy"))
    return rows.select(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(streams)).cast("int").alias("stream"), "doc_id", "tie", "text"), streams


def token_rows(dealt: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``stream, doc_id, tie, ids``: 16-bit ids of each document and its end."""
    if end_id >= 1 << 16:
        raise ValueError("records hold 16-bit ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = json_coder(tokenizer), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 500):
                ids = [np.frombuffer(coder(t.as_py()), "<u4").astype("<u2").tobytes() + end for t in texts[at : at + 500]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[at : at + 500] for c in ("stream", "doc_id", "tie")), pa.array(ids, pa.binary())], ["stream", "doc_id", "tie", "ids"])

    return dealt.mapInArrow(encode, "stream int, doc_id long, tie string, ids binary")


def cut_sequences(docs: DataFrame, tokenizer: str, length: int, end_id: int, streams: int | None) -> DataFrame:
    """Fixed-length sequences with their stream and place in it, and where they start."""
    dealt, streams = dealt_documents(docs, streams)
    # A task takes whole streams, one after the other; it holds one sequence and one document at a time.
    ordered = token_rows(dealt, tokenizer, end_id).repartition(streams, "stream").sortWithinPartitions("stream", "doc_id", "tie")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stream", "local", "doc_id", "start", "n_tokens", "record"]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        out: list[tuple] = []
        stream, local, rest, at = None, 0, np.empty(0, "<u2"), (None, 0)

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 6
            found = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            out.clear()
            return found

        def finish() -> None:
            if len(rest):
                out.append((stream, local, *at, len(rest), np.concatenate((rest, np.full(length - len(rest), end_id, "<u2"))).tobytes()))

        for batch in batches:
            for s, doc, raw in zip(*(batch.column(c) for c in ("stream", "doc_id", "ids")), strict=True):
                if (s := s.as_py()) != stream:
                    finish()
                    stream, local, rest = s, 0, np.empty(0, "<u2")
                doc, ids = doc.as_py(), np.frombuffer(raw.as_buffer(), "<u2")
                if not len(rest):
                    at = (doc, 0)
                taken = length - len(rest)
                tokens = np.concatenate((rest, ids))
                whole = len(tokens) // length
                for k in range(whole):
                    out.append((stream, local, *at, length, tokens[k * length : (k + 1) * length].tobytes()))
                    at, local = (doc, taken + k * length), local + 1
                rest = tokens[whole * length :]
                if len(out) >= 500:
                    yield batch_of()
        finish()
        yield batch_of()

    return ordered.select("stream", "doc_id", "ids").mapInArrow(cut, "stream int, local long, doc_id long, start long, n_tokens int, record binary")


def training_order(docs: DataFrame, tokenizer: str, key: str, length: int = 1024, end_id: int = 50256, shard_records: int = 4096, streams: int | None = None) -> DataFrame:
    """One record per sequence, partitioned by ranges of slots and sorted by slot.

    ``seq`` is the sequence's number, ``slot`` its place in training order; ``byte_offset`` is the place in its
    shard, ``doc_id`` and ``start`` name its first token, ``n_tokens`` counts those that are not filling.
    """
    return _ordered(docs, tokenizer, key, length, end_id, shard_records, streams, zipped=False)[0]


def dictionary(sequences: DataFrame) -> bytes:
    """A dictionary for records, from some of them; empty if there are too few."""
    some = [bytes(r["record"]) for r in sequences.select("record").take(DICTIONARY_RECORDS)]
    if len(some) < DICTIONARY_RECORDS // 4:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, some).as_bytes()


def _coder(words: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


def _ordered(docs: DataFrame, tokenizer: str, key: str, length: int, end_id: int, shard_records: int, streams: int | None, zipped: bool) -> tuple[DataFrame, bytes]:
    """``training_order``, its records compressed one by one if ``zipped``, and the dictionary that unpacks them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "training-order")
    sequences = scratch.save(cut_sequences(docs, tokenizer, length, end_id, streams), "sequences", compression="zstd", **{"parquet.compression.codec.zstd.level": "9"})
    scratch.drop()
    words = dictionary(sequences) if zipped else b""
    base, n = {}, 0
    for r in sequences.groupBy("stream").count().orderBy("stream").collect():  # STREAMS rows at most
        base[r["stream"]], n = n, n + r["count"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stream, local = batch.column("stream").to_numpy(), batch.column("local").to_numpy()
                seq = np.fromiter((base[p] for p in stream.tolist()), np.int64, len(stream)) + local
                slot = permute(seq, n, key)
                records = batch.column("record")
                crc = [zlib.crc32(r.as_buffer()) for r in records]
                if zipped:
                    zip_one = zstandard.ZstdCompressor(level=9, **_coder(words)).compress
                    records = pa.array([zip_one(r.as_buffer()) for r in records], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array((slot // shard_records).astype(np.int32)), pa.array(slot % shard_records * 2 * length), pa.array(seq), *(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64()), records],
                    ["slot", "shard", "byte_offset", "seq", "doc_id", "start", "n_tokens", "record_crc32", "record"],
                )

    # Slots are evenly spread by the permutation, so ranges of shards are even partitions without a look at the data.
    n_shards = max(1, -(-n // shard_records))
    n_parts = min(n_shards, PARTITIONS)
    part = F.floor(F.col("shard").cast("long") * n_parts / n_shards).cast("int")
    return sequences.mapInArrow(place, RECORD).repartitionById(n_parts, part).sortWithinPartitions("slot"), words


INDEX = "slot long, shard int, byte_offset long, seq long, doc_id long, start long, n_tokens int, record_crc32 long"


def write_shards(ordered: DataFrame, folder: str, zipped: bool = False, words: bytes = b"") -> DataFrame:
    """Write the records as ``shard-NNNNNN.bin`` files below ``folder``, a path or URI that every executor reaches.

    ``zipped`` records are unpacked with the dictionary ``words``.  A file appears under its name only when whole, so a task that is run again replaces it with the same bytes.
    Returns the rows without their records; running it writes the files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        file, shard, unzip = None, None, zstandard.ZstdDecompressor(**_coder(words)).decompress

        def close() -> None:
            file.close()
            fs.move(f"{root}/.{attempt}-{shard:06d}", f"{root}/shard-{shard:06d}.bin")

        for batch in batches:
            for s, record in zip(batch.column("shard").to_pylist(), batch.column("record"), strict=True):
                if s != shard:
                    if file:
                        close()
                    shard, file = s, fs.open_output_stream(f"{root}/.{attempt}-{s:06d}")
                file.write(unzip(record.as_buffer()) if zipped else record.as_buffer())
            yield batch.select([f.split()[0] for f in INDEX.split(", ")])
        if file:
            close()

    return ordered.mapInArrow(write, INDEX)


def read_back(spark: SparkSession, folder: str, n_records: int, length: int = 1024, shard_records: int = 4096) -> DataFrame:
    """``slot, stored_crc32`` of every record in the files, each shard read from its start to its end."""
    n_shards = -(-n_records // shard_records)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                first = shard * shard_records
                found = read_from(folder, first, min(shard_records, n_records - first), length, shard_records)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(found))), pa.array([zlib.crc32(r.tobytes()) for r in found], pa.int64())], ["slot", "stored_crc32"])

    return spark.range(0, n_shards, 1, max(1, min(n_shards, PARTITIONS))).mapInArrow(read, "slot long, stored_crc32 long")


def materialise(docs: DataFrame, tokenizer: str, key: str, folder: str | None = None, length: int = 1024, shard_records: int = 4096, **options: int) -> DataFrame:
    """Write the shards of ``training_order`` below ``folder`` and return their index, with ``stored_crc32`` as read from the files again.

    Reading the index fails if a record is missing from the files or differs from what was written.  Writing onto a folder that has
    shards replaces them, on file systems whose ``move`` replaces a file: local ones, HDFS and object stores.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "training-shards")
    folder = folder or f"{scratch.path if '://' in scratch.path else 'file://' + scratch.path}/shards"
    ordered, words = _ordered(docs, tokenizer, key, length, options.pop("end_id", 50256), shard_records, options.pop("streams", None), zipped=True)
    index = scratch.save(write_shards(ordered, folder, zipped=True, words=words), "index")
    both = index.join(read_back(spark, folder, index.count(), length, shard_records), "slot", "left")
    wrong = F.raise_error(F.format_string("record %d is not in the files as it was written", "slot"))
    return both.withColumn("stored_crc32", F.when(F.col("stored_crc32") == F.col("record_crc32"), F.col("stored_crc32")).otherwise(wrong))


def read_from(folder: str, slot: int, count: int, length: int = 1024, shard_records: int = 4096) -> np.ndarray:
    """``count`` sequences from ``slot`` on, as a reader that resumes would take them."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    stride, out = 2 * length, []
    while count > 0:
        name = f"{root}/shard-{slot // shard_records:06d}.bin"
        take = min(count, shard_records - slot % shard_records)
        with fs.open_input_file(name) as file:
            file.seek(slot % shard_records * stride)
            found = file.read(take * stride)
        if not found:
            break
        out.append(np.frombuffer(found, "<u2").reshape(-1, length))
        slot, count = slot + len(out[-1]), count - len(out[-1])
    return np.concatenate(out) if out else np.empty((0, length), "<u2")
