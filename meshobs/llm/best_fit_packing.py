"""Minimum bin slack packing of token pieces into sequences.

Documents become pieces of at most ``capacity`` tokens.  What packing needs to know of them is the number
of pieces per length, a table of at most ``capacity`` rows at any input size.  On it, bin after bin, a bitset
subset-sum program finds the fullest feasible combination that holds the longest remaining piece; the
combination is removed as often as the remaining counts allow, and the next one is sought.  Ranks within each
length, computed by Spark without gathering a length in one task, then deal the pieces to the bins.

Nulls: a null text is empty and, like an empty text, a piece of the end token alone.  Rows with a null or
repeated ``doc_id`` are packed one by one.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_ids import json_coder
from .common import Scratch, gapless_rank


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece; only a document's first may be shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = json_coder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = coder(text) + end
                stops = range(len(ids) // 4 % capacity or capacity, len(ids) // 4 + 1, capacity)
                for k, stop in enumerate(stops):
                    start = stops[k - 1] if k else 0
                    out.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``, long lengths first among equals.

    ``reach[i]`` is the bitset of the sums that the first ``i`` lengths can make.
    """
    mask = (1 << (room + 1)) - 1
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    reach, done = [1], 0
    for n in lengths:
        sums = reach[-1]
        left, step = min(counts[n], room // n), 1
        while left:  # binary splitting of the multiplicity
            take = min(step, left)
            sums |= (sums << (n * take)) & mask
            left, step = left - take, step * 2
        reach.append(sums)
        done += 1
        if sums >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    chosen: dict[int, int] = {}
    for i in range(done, 0, -1):
        n = lengths[i - 1]
        while not reach[i - 1] >> total & 1:
            chosen[n] = chosen.get(n, 0) + 1
            total -= n
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how many bins each fills; together they use up ``counts``."""
    left = {n: c for n, c in counts.items() if c}
    plan: list[tuple[dict[int, int], int]] = []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = fullest(left, capacity - longest)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        bins = min(left[n] // m for n, m in combination.items())
        for n, m in combination.items():
            left[n] -= m * bins
            if not left[n]:
                del left[n]
        plan.append((combination, bins))
    return plan


def pack(pieces: DataFrame, order: list, capacity: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is a piece's size, ``order`` names one piece."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    # For each length, stretches of ranks: the first rank, sequence, offset in it and pieces per bin.
    stretches: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    used, base = dict.fromkeys(counts, 0), 0
    for combination, bins in plan_bins(counts, capacity):
        offset = 0
        for n, m in sorted(combination.items(), reverse=True):
            stretches[n].append((used[n], base, offset, m))
            used[n] += m * bins
            offset += n * m
        base += bins
    tables = {n: np.array(s, np.int64) for n, s in stretches.items()}
    fields = [f.name for f in pieces.schema.fields]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = batch.column("_in_length").to_numpy(), batch.column("length").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at, table = np.flatnonzero(length == n), tables[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + inside // row[:, 3]
                offset[at] = row[:, 2] + inside % row[:, 3] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(sequence), pa.array(offset)], [*fields, "sequence_id", "offset"])

    ranked = gapless_rank(pieces, ["length"], order, sum(counts.values()), "_in_length")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*fields, "_in_length").mapInArrow(deal, f"{kinds}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    scratch = Scratch(docs.sparkSession, "best-fit-packing")
    pieces = scratch.save(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
