"""Language-model scores by context-tree weighting over bytes.

A text is a sequence of tokens: lower-cased words, each ended by a blank, and one end.  A token's bytes are coded bit by bit,
eight binary decisions a byte.  For every decision there is a context tree: the node at depth ``d`` stands for the last ``d``
bytes of the token (blanks before its start) and the bits of the byte so far.  Each node estimates the bit by the Krichevsky-Trofimov rule
from its counts in the training texts, and its weighted probability is half its own estimate's and half the product of its
children's; so every depth up to ``DEPTH`` is mixed in by how well it did.  Below the deepest context stand nodes per language:
texts are scored under each of the languages that training texts name (the largest ``CLASSES - 1`` and one for all others),
and ``score`` is the base-10 logarithm of the text's probability, summed over languages by their share.  Divided by the
bytes it is a code length.

Work is spread by where it belongs: words of a block of texts are counted in its task and then over the corpus; contexts of each
distinct word are counted once, weighted by the word; trees are weighted in one group per two last bytes, and the two uppermost
depths, of bounded size, from the groups' sums; every distinct context and byte, seen in training or not, gets its logarithm.
Scores of distinct words go back to the blocks that hold them.

Nulls: a null language is one of the others; a null text is empty and scores its end token.  A null ``doc_id`` is trained on and not held out.  Repeated rows are learnt
from and scored one by one.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Longest context in bytes, seven at most.
DEPTH = 6
#: Languages told apart, the one for all others included.
CLASSES = 8
#: Bytes of text in a block.
BLOCK = 32 << 20
#: Logarithms of contexts are broadcast up to this many (12 bytes each) and joined beyond.
BROADCAST = 4_000_000
END = 0x0A
_BLANK = 0x20
_SHIFT = 16


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after shifting arguments beyond 16."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(_SHIFT):
        low = y < _SHIFT
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


_SMALL = 1 << 12
_HALF, _ONE = log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(_SMALL) + 1.0)


def _log_gamma_plus(n: np.ndarray, shift: float) -> np.ndarray:
    """Of whole numbers plus 0.5 or 1; small ones come from a table."""
    out = (_HALF if shift == 0.5 else _ONE)[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(n >= _SMALL)
    if len(large):
        out[large] = log_gamma(n[large] + shift)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma_plus(zeros, 0.5) + _log_gamma_plus(ones, 0.5) - 2 * _HALF[0] - _log_gamma_plus(zeros + ones, 1.0)


def _mix(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the weight of their own estimate."""
    weighted = np.logaddexp(kt, children) - np.log(2)
    return weighted, np.exp(kt - np.log(2) - weighted)


# -- words -------------------------------------------------------------------------------------------------------------


class _Codes(dict):
    """Words by order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _pack(codes: np.ndarray) -> bytes:
    """Codes by planes of bytes, compressed: frequent words have small codes, so high planes are nearly empty."""
    return zstandard.ZstdCompressor(level=1).compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def blocks_of(docs: DataFrame, classes: list[str], block_bytes: int = BLOCK) -> DataFrame:
    """Texts in blocks: ids, flags and word counts of the documents, packed codes of their words, and the block's words.

    ``words`` has a word's code, the language (``classes``, then all others) and its occurrences in the block's training texts; a word that
    no training text has is there once with 0.  ``ends`` counts the training texts by language.
    """
    names = ["block", "doc_ids", "held", "lengths", "codes", "words", "ends"]
    entry = pa.struct([("code", pa.int32()), ("word", pa.binary()), ("lang", pa.int8()), ("n", pa.int64())])
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(entry), pa.list_(pa.int64()))
    number_of = {c: k for k, c in enumerate(classes)}
    many = len(classes) + 1

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        size, ids, held, kind, codes, known = 0, [], [], [], [], _Codes()

        def finish() -> pa.RecordBatch:
            flat = np.concatenate(codes)
            lengths = np.fromiter(map(len, codes), np.int32, len(codes))
            trains, of = ~np.array(held, bool), np.array(kind)
            counts = np.stack([np.bincount(flat[np.repeat(trains & (of == k), lengths)], minlength=len(known)) for k in range(many)])
            counts[0, counts.sum(axis=0) == 0] = -1  # kept, as 0
            lang, code = np.nonzero(counts)
            n = np.maximum(counts[lang, code], 0)
            words = pa.array(list(known), pa.binary()).take(pa.array(code))
            table = pa.StructArray.from_arrays([pa.array(code.astype(np.int32)), words, pa.array(lang.astype(np.int8)), pa.array(n)], fields=list(entry))
            listed = pa.ListArray.from_arrays(pa.array([0, len(code)], pa.int32()), table)
            row = (part << 32 | number, ids, held, lengths, _pack(flat), None, np.bincount(of[trains], minlength=many))
            return pa.RecordBatch.from_arrays([listed if k == 5 else pa.array([v], t) for k, (v, t) in enumerate(zip(row, kinds, strict=True))], names)

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts, strict=True):
                words = (text or b"").lower().split()
                codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                ids.append(doc)
                kind.append(number_of.get(lang, many - 1))
                held.append(doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0)
                size += len(text or b"")
                if size >= block_bytes:
                    yield finish()
                    number, size, ids, held, kind, codes, known = number + 1, 0, [], [], [], [], _Codes()
        if ids:
            yield finish()

    schema = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, codes binary, words array<struct<code: int, word: binary, lang: tinyint, n: long>>, ends array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(block, schema)


def contexts(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and its final blank, ``depth`` bytes before it and itself in one number; and the counts per word."""
    pad = bytes([_BLANK]) * depth
    data = np.frombuffer(b"".join(pad + w + b" " for w in words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.concatenate(([0], np.cumsum(sizes + depth)[:-1])) if len(sizes) else sizes
    starts = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(sizes) else sizes
    grams = np.zeros(len(starts), np.uint64)
    for k in range(depth + 1):
        grams = grams << np.uint64(8) | data[starts + k]
    return grams, sizes


def end_context(depth: int) -> int:
    return int.from_bytes(bytes([_BLANK]) * depth + bytes([END]), "big")


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, rows * width + 1, width, dtype=np.int32), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sum_lists(column: str, many: int) -> Column:
    return F.array(*(F.coalesce(F.sum(F.col(column)[k]), F.lit(0)) for k in range(many))).alias(column)


def count_contexts(words: DataFrame, depth: int, many: int) -> DataFrame:
    """``gram, n`` over the distinct words (``word, n``), weighted by the counts per language ``n``, which may be 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([g for g, _ in kept]), return_inverse=True)
            n = np.concatenate([n for _, n in kept])
            return grams, np.stack([np.bincount(at, n[:, k], len(grams)) for k in range(many)], axis=1).astype(np.int64)

        for batch in batches:
            if batch.num_rows:
                grams, sizes = contexts(batch.column("word").to_pylist(), depth)
                kept.append((grams, np.repeat(_matrix(batch.column("n"), many), sizes, axis=0)))
                if sum(len(g) for g, _ in kept[1:]) > 500_000:
                    kept = [merge()]
        if kept:
            grams, total = merge()
            for at in range(0, len(grams), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(grams[at : at + 50_000].view(np.int64)), _lists(total[at : at + 50_000], pa.int64())], ["gram", "n"])

    return words.select("word", "n").mapInArrow(count, "gram long, n array<long>").groupBy("gram").agg(_sum_lists("n", many))


# -- trees -------------------------------------------------------------------------------------------------------------


def weigh_group(grams: np.ndarray, n: np.ndarray, depth: int) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Trees of contexts that share their last two bytes; ``n`` has a column per language.

    Returns, for each of eight bits, the probability of each gram's bit under each language from depth 2 down; and the
    nodes of depth 2: the last byte and the bits so far in one number, zeros, ones and weighted log probability.
    """
    # Distinct contexts and bytes at each depth, each level from the one below it: levels shrink fast.
    levels, ups = {depth: (grams, n.sum(axis=1))}, {}
    for d in range(depth - 1, 1, -1):
        key, up = np.unique(levels[d + 1][0] & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels[d], ups[d] = (key, np.bincount(up, levels[d + 1][1], len(key))), up
    chances, tops = [], []
    for k in range(8):
        share, own, weighted, below = {}, {}, None, None
        for d in range(depth, 1, -1):
            key, count = levels[d]
            byte = (key & np.uint64(0xFF)).astype(np.int64)
            bit = byte >> (7 - k) & 1
            nodes, at = np.unique(key >> np.uint64(8) << np.uint64(8) | (1 << k | byte >> (8 - k)).astype(np.uint64), return_inverse=True)
            if d == depth:  # the languages' nodes below the deepest context
                children, chance = np.zeros(len(nodes)), np.empty((len(grams), n.shape[1]))
                for c in range(n.shape[1]):
                    ones, zeros = np.bincount(at, n[:, c] * bit, len(nodes)), np.bincount(at, n[:, c] * (1 - bit), len(nodes))
                    children += log_kt(zeros, ones)
                    chance[:, c] = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            else:
                up = np.zeros(len(weighted), np.int64)
                up[below] = at[ups[d]]
                children = np.bincount(up, weighted, len(nodes))
            ones, zeros = np.bincount(at, count * bit, len(nodes)), np.bincount(at, count * (1 - bit), len(nodes))
            weighted, mixed = _mix(log_kt(zeros, ones), children)
            share[d], own[d] = mixed[at], (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            below = at
        tops.append((nodes & np.uint64(0xFFFF), zeros, ones, weighted))
        # From depth 2 down: what is mixed in so far, and the weight that is left for deeper nodes.
        mixed, rest = share[2] * own[2], 1 - share[2]
        for d in range(3, depth + 1):
            mixed, rest = mixed[ups[d - 1]], rest[ups[d - 1]]
            mixed, rest = mixed + rest * share[d] * own[d], rest * (1 - share[d])
        chances.append(mixed[:, None] + rest[:, None] * chance)
    return chances, tops


def _group(table: pa.Table, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in order, so that sums do not depend on how rows came."""
    grams = table["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], _matrix(table["n"], many)[order].astype(np.float64)


def _top_nodes(depth: int, many: int):
    def weigh(table: pa.Table) -> pa.Table:
        _, tops = weigh_group(*_group(table, many), depth)
        node, zeros, ones, weighted = (np.concatenate(x) for x in zip(*tops, strict=True))
        return pa.table({"node": node.astype(np.int64), "zeros": zeros.astype(np.int64), "ones": ones.astype(np.int64), "weighted": weighted})

    return weigh


def _logarithms(depth: int, many: int, top: Top):
    def weigh(table: pa.Table) -> pa.Table:
        grams, n = _group(table, many)
        lp = top.log10(grams, weigh_group(grams, n, depth)[0])
        return pa.table([pa.array(grams.view(np.int64)), _lists(lp, pa.float32())], names=["gram", "lp"])

    return weigh


class Top:
    """Depths 1 and 0: 65,536 nodes and 256."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray):
        n0, n1, below = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16)
        n0[node], n1[node], below[node] = zeros, ones, weighted
        up, self.share1 = _mix(log_kt(n0, n1), below)
        self.one1 = (n1 + 0.5) / (n0 + n1 + 1)
        up[n0 + n1 == 0] = 0
        n0, n1 = n0.reshape(256, 256).sum(axis=0), n1.reshape(256, 256).sum(axis=0)
        _, self.share0 = _mix(log_kt(n0, n1), up.reshape(256, 256).sum(axis=0))
        self.one0 = (n1 + 0.5) / (n0 + n1 + 1)

    def log10(self, grams: np.ndarray, chances: list[np.ndarray]) -> np.ndarray:
        """Base-10 logarithm of each gram's byte under each language, all depths mixed."""
        byte, before = (grams & np.uint64(0xFF)).astype(np.int64), (grams >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64)
        out = np.zeros(chances[0].shape)
        for k, chance in enumerate(chances):
            prefix, bit = 1 << k | byte >> (8 - k), byte >> (7 - k) & 1
            node = before << 8 | prefix
            for share, one in ((self.share1[node], self.one1[node]), (self.share0[prefix], self.one0[prefix])):
                chance = share[:, None] * np.where(bit == 1, one, 1 - one)[:, None] + (1 - share[:, None]) * chance
            out += np.log10(chance)
        return out


def context_scores(grams: DataFrame, scratch: Scratch, depth: int, many: int) -> DataFrame:
    """``gram, lp``: the base-10 logarithms of each distinct context's byte by language, for ``grams`` (``gram, n``)."""
    groups = grams.withColumn("two", F.shiftright("gram", 8).bitwiseAND(0xFFFF)).groupBy("two")
    tops = groups.applyInArrow(_top_nodes(depth, many), "node long, zeros long, ones long, weighted double")
    table = tops.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).toArrow()  # 65,536 rows at most
    top = Top(*(table[c].to_numpy() for c in ("node", "zeros", "ones", "weighted")))
    return scratch.save(groups.applyInArrow(_logarithms(depth, many, top), "gram long, lp array<float>"), "context-scores")


# -- scores ------------------------------------------------------------------------------------------------------------


def word_scores(words: DataFrame, scores: DataFrame, depth: int, many: int, limit: int = BROADCAST) -> DataFrame:
    """``word, seen, score`` of the distinct words: occurrences in training, logarithms by language.

    ``limit`` bounds how many context scores are broadcast; more are joined.
    """
    words = words.select("word", F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b).alias("seen"))
    if scores.count() > limit:

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams, sizes = contexts(batch.column("word").to_pylist(), depth)
                at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                yield pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("seen").take(at), pa.array(grams.view(np.int64))], ["word", "seen", "gram"])

        spelt = words.mapInArrow(spell, "word binary, seen long, gram long").join(scores, "gram")
        return spelt.groupBy("word", "seen").agg(F.array(*(F.sum(F.col("lp")[k]).cast("float") for k in range(many))).alias("score"))
    table = scores.toArrow()
    grams = table["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    held = words.sparkSession.sparkContext.broadcast((grams[order], _matrix(table["lp"], many)[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = held.value
        for batch in batches:
            if batch.num_rows:
                found, sizes = contexts(batch.column("word").to_pylist(), depth)
                at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                score = np.add.reduceat(values[np.searchsorted(known, found)].astype(np.float64), at, axis=0)
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("seen"), _lists(score.astype(np.float32), pa.float32())], ["word", "seen", "score"])

    return words.mapInArrow(look_up, "word binary, seen long, score array<float>")


def largest_classes(docs: DataFrame, classes: int = CLASSES) -> list[str]:
    """The languages told apart: the ``classes - 1`` with most documents."""
    sizes = docs.filter("lang IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).count()
    return sorted(r["lang"] for r in sizes.orderBy(F.desc("count"), "lang").limit(classes - 1).collect())


def ctw_scores(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK, broadcast: int = BROADCAST) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw-scoring")
    classes = largest_classes(docs)
    many = len(classes) + 1
    blocks = scratch.save(blocks_of(docs, classes, block_bytes), "blocks", compression="zstd")
    entries = blocks.select("block", F.explode("words").alias("e")).select("block", "e.*")
    by_lang = F.array(*(F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)) for k in range(many))).alias("n")
    words = scratch.save(entries.select("word", "lang", "n").groupBy("word").agg(by_lang), "words", compression="zstd")
    scratch.drop()
    ends = np.array(blocks.agg(_sum_lists("ends", many)).first()["ends"])
    count = F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)
    seen = words.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n"), F.count(F.when(count > 0, 1)).alias("v")).first()
    n_ends = int(ends.sum())
    total, distinct = seen["n"] + n_ends, seen["v"] + (n_ends > 0)
    end = spark.createDataFrame([(end_context(depth), ends.tolist())], "gram long, n array<long>")
    grams = scratch.save(count_contexts(words, depth, many).unionByName(end), "grams")
    scores = context_scores(grams, scratch, depth, many)
    end_score = np.array(scores.filter(F.col("gram") == end_context(depth)).first()["lp"])
    # A language without training texts has no share; without any training text all are alike.
    share = ends / n_ends if n_ends else np.full(many, 1 / many)
    prior = np.log10(np.maximum(share, 1e-300)) + end_score
    scored = scratch.save(word_scores(words, scores, depth, many, broadcast), "scored", compression="zstd")
    scratch.drop("grams")
    rate = total + 0.1 * (distinct + 1)
    of_block = entries.select("block", "code", "word").join(scored, "word").select("block", F.struct("code", "seen", "score").alias("e"))
    tables = of_block.groupBy("block").agg(F.collect_list("e").alias("e"))  # a block's words, bounded by its bytes

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("doc_ids", "held", "lengths")}
                lengths, codes = row["lengths"].to_numpy(), _unpack(batch.column("codes")[i].as_py())
                entry = batch.column("e")[i].values
                size, full = 0 if entry is None else int(entry.field("code").to_numpy().max()) + 1, lengths > 0
                sums = np.zeros((len(lengths), 2 + many))
                if size:
                    table, at = np.zeros((size, 2 + many)), entry.field("code").to_numpy()
                    n = entry.field("seen").to_numpy()
                    table[at, 0], table[at, 1] = n > 0, np.log10((n + 0.1) / rate)
                    table[at, 2:] = _matrix(entry.field("score"), many)
                    starts = np.concatenate(([0], np.cumsum(lengths[:-1], dtype=np.int64)))[full]
                    for k in range(2 + many):
                        sums[full, k] = np.add.reduceat(table[codes, k], starts)
                under = sums[:, 2:] + prior
                best = under.max(axis=1)
                score = best + np.log10(np.power(10, under - best[:, None]).sum(axis=1))
                base = sums[:, 1] + np.log10((n_ends + 0.1) / rate)
                known = np.rint(sums[:, 0]).astype(np.int64) + (n_ends > 0)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"], row["held"], pa.array(lengths.astype(np.int64) + 1), pa.array(known), pa.array(np.full(len(lengths), total, np.int64)), pa.array(base), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    joined = blocks.select("block", "doc_ids", "held", "lengths", "codes").join(tables, "block", "left")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.select("doc_ids", "held", "lengths", "codes", "e").mapInArrow(add_up, schema)
