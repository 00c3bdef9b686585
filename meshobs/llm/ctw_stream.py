"""Language-model scores by context-tree weighting over the bytes of whole texts.

A text is one stream: its lower-cased words, each followed by a blank, and one end.  The trees are those of ``ctw_scoring``, but a
context is the last ``depth`` bytes of the stream, across blanks (blanks stand before the text's start), so the order of words counts.  There
are no nodes per language: the deepest context's estimate is the leaf.  ``score`` is the base-10 logarithm of the text's probability.

Work is spread by where it belongs.  Texts are packed in blocks.  A block counts its distinct contexts and bytes, and its distinct words,
and sends them packed to the part that the context's last two bytes, or the word's hash, name.  A part adds up its blocks' counts and weighs its trees; the two
uppermost depths, of bounded size, come from the parts' sums.  What a part finds goes back to each block, packed as the block's own, so
tables grow with the distinct contexts of blocks, and no join sees a row per byte.

Nulls: a null text is empty and scores its end.  A null ``doc_id`` is trained on and not held out.  Repeated rows are learnt
from and scored one by one.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, add_up, pack, pack_sorted, unpack, unpack_sorted
from .ctw_scoring import DEPTH, END, Top, weigh_group

#: Bytes of text in a block, and of a block's text looked at together.
BLOCK = 20 << 20
PIECE = 1 << 20
#: Parts by bytes of text, within bounds.
PART, PARTS = 2 << 20, (64, 8192)


def stream_of(words: list[bytes]) -> bytes:
    return b" ".join([*words, bytes([END])])


def stream_contexts(streams: list[bytes], depth: int) -> np.ndarray:
    """For each byte of each stream, the ``depth`` bytes before it and itself in one number."""
    pad = b" " * depth
    data = np.frombuffer(b"".join(pad + s for s in streams), np.uint8)
    n = len(data) - depth
    grams = np.zeros(n, np.uint64)
    for k in range(depth + 1):
        grams <<= np.uint64(8)
        grams |= data[k : k + n]
    starts = np.cumsum(np.fromiter((len(s) + depth for s in streams), np.int64, len(streams)))[:-1]
    own = np.ones(n, bool)
    own[(starts[:, None] - depth + np.arange(depth)).ravel()] = False
    return grams[own]


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(grams)
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[first], np.diff(np.append(first, len(g)))


def _pieces(streams: list[bytes]) -> Iterator[list[bytes]]:
    piece, size = [], 0
    for s in streams:
        piece.append(s)
        size += len(s)
        if size >= PIECE:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def count_block(streams: list[bytes], held: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct contexts and bytes, with their counts in training texts, 0 where only held-out texts have them."""
    grams, n = [], []
    for out in (False, True):
        for piece in _pieces([s for s, h in zip(streams, held, strict=True) if h == out]):
            g, c = _distinct(stream_contexts(piece, depth))
            grams.append(g), n.append(c * (not out))
            if sum(map(len, grams[1:])) > 2_000_000:
                grams, n = ([x] for x in add_up(grams, n))
    return add_up(grams, n)


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``block, doc_ids, held, size, data``: texts in blocks, their streams one after the other."""
    names, kinds = ["block", "doc_ids", "held", "size", "data"], (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary())

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        size, ids, held, streams = 0, [], [], []

        def finish() -> pa.RecordBatch:
            row = (part << 32 | number, ids, held, size, zstandard.ZstdCompressor(level=1).compress(b"".join(streams)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                streams.append(stream_of((text or b"").lower().split()))
                ids.append(doc)
                held.append(doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0)
                size += len(streams[-1])
                if size >= block_bytes:
                    yield finish()
                    number, size, ids, held, streams = number + 1, 0, [], [], []
        if ids:
            yield finish()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(block, "block long, doc_ids array<long>, held array<boolean>, size long, data binary")


def _streams(data: bytes) -> list[bytes]:
    end = bytes([END])
    return [s + end for s in zstandard.ZstdDecompressor().decompress(data).split(end)[:-1]]


def chunks_of(blocks: DataFrame, depth: int, parts: int) -> DataFrame:
    """``block, words, part, keys, n``: what each block sends to each part; ``keys`` are words or contexts."""
    names, kinds = ["block", "words", "part", "keys", "n"], (pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, held = batch.column("block")[i].as_py(), batch.column("held")[i].as_py()
                streams, rows, words = _streams(batch.column("data")[i].as_py()), [], Counter()
                for s, out in zip(streams, held, strict=True):
                    if out:
                        words.update(dict.fromkeys(s.split(), 0))
                    else:
                        words.update(s.split())
                by_part: dict[int, list[bytes]] = {}
                for w in words:
                    by_part.setdefault(zlib.crc32(w) % parts, []).append(w)
                for part, own in by_part.items():
                    rows.append((block, True, part, zstandard.ZstdCompressor(level=1).compress(b" ".join(own)), pack(np.array([words[w] for w in own]))))
                del words, by_part
                grams, n = count_block(streams, held, depth)
                part_of = ((grams >> np.uint64(8) & np.uint64(0xFFFF)) * np.uint64(2654435761) >> np.uint64(12) & np.uint64(0xFFFF)) % np.uint64(parts)
                order = np.argsort(part_of.astype(np.uint16), kind="stable")
                cuts = np.searchsorted(part_of[order], np.arange(parts + 1, dtype=np.uint64))
                for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if a < b:
                        rows.append((block, False, part, pack_sorted(grams[order[a:b]]), pack(n[order[a:b]])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return blocks.select("block", "held", "data").mapInArrow(chunk, "block long, words boolean, part int, keys binary, n binary")


def _part(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The contexts of each chunk, and those of all with their counts."""
    own = [unpack_sorted(k) for k in table["keys"].to_pylist()]
    return own, *add_up(own, [unpack(n).astype(np.int64) for n in table["n"].to_pylist()])


def context_scores(chunks: DataFrame, scratch: Scratch, depth: int) -> DataFrame:
    """``block, words, keys, values``: base-10 logarithms of each block's contexts and bytes."""
    groups = chunks.filter("NOT words").groupBy("part")

    def tops(table: pa.Table) -> pa.Table:
        _, grams, n = _part(table)
        found = weigh_group(grams, n[:, None].astype(np.float64), depth)[1]
        node, zeros, ones, weighted = (np.concatenate(x) for x in zip(*found, strict=True))
        node, at = np.unique(node, return_inverse=True)
        return pa.table({"node": node.astype(np.int64), **{k: np.bincount(at, v, len(node)) for k, v in (("zeros", zeros), ("ones", ones), ("weighted", weighted))}})

    sums = groups.applyInArrow(tops, "node long, zeros double, ones double, weighted double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).toArrow()  # 65,536 rows at most
    scratch.drop()
    top = Top(*(sums[c].to_numpy() for c in ("node", "zeros", "ones", "weighted")))

    def logarithms(table: pa.Table) -> pa.Table:
        own, grams, n = _part(table)
        lp = top.log10(grams, weigh_group(grams, n[:, None].astype(np.float64), depth)[0])[:, 0].astype("<f4")
        values = [zstandard.ZstdCompressor(level=1).compress(lp[np.searchsorted(grams, g)].tobytes()) for g in own]
        return pa.table({"block": table["block"], "words": table["words"], "keys": table["keys"], "values": pa.array(values, pa.binary())})

    return groups.applyInArrow(logarithms, "block long, words boolean, keys binary, values binary")


def word_counts(chunks: DataFrame) -> DataFrame:
    """``block, words, keys, values``: training occurrences of each block's words; and, once a part, the part's ``total`` and ``distinct``."""

    def count(table: pa.Table) -> pa.Table:
        own = [zstandard.ZstdDecompressor().decompress(k).split(b" ") for k in table["keys"].to_pylist()]
        seen: dict[bytes, int] = {}
        for words, n in zip(own, table["n"].to_pylist(), strict=True):
            for w, k in zip(words, unpack(n).tolist(), strict=True):
                seen[w] = seen.get(w, 0) + k
        values = [pack(np.array([seen[w] for w in words])) for words in own]
        rest = [0] * (len(own) - 1)
        sums = {"total": [sum(seen.values()), *rest], "distinct": [sum(k > 0 for k in seen.values()), *rest]}
        return pa.table({"block": table["block"], "words": table["words"], "keys": table["keys"], "values": pa.array(values, pa.binary()), **{k: pa.array(v, pa.int64()) for k, v in sums.items()}})

    # An end alone is no word; a block without words sends none.
    return chunks.filter("words").groupBy("part").applyInArrow(count, "block long, words boolean, keys binary, values binary, total long, distinct long")


def stream_scores(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    scratch = Scratch(docs.sparkSession, "ctw-stream")
    blocks = scratch.save(blocks_of(docs, block_bytes), "blocks")
    trains = F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + F.when(h, 0).otherwise(1))
    whole = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum(trains), F.lit(0)).alias("ends")).first()
    n_ends, parts = whole["ends"], min(max(PARTS[0], whole["size"] // PART), PARTS[1])
    chunks = scratch.save(chunks_of(blocks, depth, parts), "chunks")
    words = scratch.save(word_counts(chunks), "words")
    seen = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    total, distinct = seen["n"] + n_ends, seen["v"] + (n_ends > 0)
    rate = total + 0.1 * (distinct + 1)
    scratch.drop()
    scores = scratch.save(context_scores(chunks, scratch, depth), "scores")
    scratch.drop("chunks")
    found = words.select("block", "words", "keys", "values").unionByName(scores)

    def score(block: pa.Table, table: pa.Table) -> pa.Table:
        names, rows = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], []
        known: dict[bytes, int] = {}
        grams, lp = [], []
        for is_words, keys, values in zip(*(table[c].to_pylist() for c in ("words", "keys", "values")), strict=True):
            if is_words:
                known.update(zip(zstandard.ZstdDecompressor().decompress(keys).split(b" "), unpack(values).tolist(), strict=True))
            else:
                grams.append(unpack_sorted(keys)), lp.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(values), "<f4"))
        grams, lp = np.concatenate(grams), np.concatenate(lp)
        order = np.argsort(grams, kind="stable")
        grams, lp = grams[order], lp[order].astype(np.float64)
        for piece in _pieces(_streams(block["data"][0].as_py())):
            at = np.cumsum([0, *map(len, piece[:-1])])
            looked = stream_contexts(piece, depth)
            order = np.argsort(looked)  # lookups in order stay near each other
            of_byte = np.empty(len(looked))
            of_byte[order] = lp[np.searchsorted(grams, looked[order])]
            scored = np.add.reduceat(of_byte, at)
            for s, value in zip(piece, scored, strict=True):
                n = np.fromiter(map(known.__getitem__, s.split()), np.float64)
                base = np.log10((n + 0.1) / rate).sum() + np.log10((n_ends + 0.1) / rate)
                rows.append((len(n) + 1, int((n > 0).sum()) + (n_ends > 0), total, base, value))
        n_tokens, n_known, of, base, value = zip(*rows, strict=True)
        ids, held = (block[c].combine_chunks().flatten() for c in ("doc_ids", "held"))
        return pa.table([ids, held, *(pa.array(v, pa.int64()) for v in (n_tokens, n_known, of)), pa.array(base, pa.float64()), pa.array(value, pa.float64())], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select("block", "doc_ids", "held", "data").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, schema)
