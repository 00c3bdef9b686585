"""Hard negatives by angular triangle filtering.

Vectors are scaled and floored to whole numbers, and a score is their inner product.  With every vector are kept its norm and its angles
to a few reference directions.  For an anchor ``a`` and a row ``v`` each reference ``r`` bounds their angle from both sides,
``|(a, r) - (v, r)| <= (a, v) <= min((a, r) + (v, r), 2 pi - (a, r) - (v, r))``; the cosines of these ends times both norms, widened for rounding, bound the score.
First a chunk of rows is held against an anchor by the chunk's least and largest angles, then row by row.  Only rows whose bounds
overlap a window that can still change the anchor's result are scored, in exact whole numbers.  Windows are open above for positives;
for negatives they lie between the shares ``low`` and ``high`` of the positives' scores.  Below, a window closes as better rows are found.

Anchors are worked off in blocks of a bounded size, each sent to all tasks, so the rows are never shuffled.  A block first sees a sixteenth of
the rows, whose results close the windows for the rest; then no task sends on more than what can be among the first.

Rows with a null label, a null vector, or a null or non-finite component take no part; a shorter vector counts as followed by zeros.
Null ids are never anchors and come last among ties.  Repeated rows count one by one, each with all others as its other rows.  Other
columns do not matter; an empty table, or one without anchors, gives an empty result.  Vectors so long that a score may pass 2**62
in size raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Reference directions, and the rows that they are chosen from; these decide how much is filtered, never what is found.
REFERENCES, SAMPLE = 6, 1024
#: Bytes and number of anchors in a block, and the rows and anchors compared at once.
BLOCK_BYTES, BLOCK, CHUNK, ANCHORS = 4 << 20, 8192, 1024, 512
#: One row in so many is seen first.
FIRST = 16
#: Angles are stored in single precision: they, and their sums, are wrong by less than this.
SLACK = 4e-6
#: Norm products below which doubles are exact, and scores fit a long.
EXACT, LONG = 2.0**52, 2.0**62
PREPARED = "rk long, vec_id long, label long, q binary, norm double, angles binary, first boolean"
HIT = "anchor long, j int, rk long, vec_id long, score long"


def directions(sample: np.ndarray) -> np.ndarray:
    """Unit vectors far from each other: each next one is the sample's farthest from those before."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(REFERENCES, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def prepare(table: DataFrame, label: Column, scale: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The rows that take part, scaled, with norms and angles, as a written table; and their dimensions."""
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = table.withColumn("label", label.cast("long")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    # Not-a-number compares as the largest value, so it fails the test of finiteness too.
    rows = rows.filter(usable).withColumn("rk", F.monotonically_increasing_id())
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    picked = rows.orderBy(F.xxhash64("embedding", "vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()["embedding"]
    refs = directions(_scaled(picked.combine_chunks(), dims, scale)) if len(picked) else np.zeros((0, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _scaled(batch.column("embedding"), dims, scale)
            norm = np.linalg.norm(q, axis=1)
            cos = (q @ refs.T) / np.maximum(norm, 1e-300)[:, None]
            angle = np.arccos(np.clip(cos, -1, 1)).astype("<f4")
            # Rows near one reference lie together, so that a chunk's angles span little.
            order = np.lexsort((angle.min(axis=1), angle.argmin(axis=1))) if len(refs) and len(q) else np.arange(len(q))
            narrow = (q == q.astype("<f4")).all()
            data = [row.tobytes() for row in q[order].astype("<f4" if narrow else "<f8")]
            kept = batch.take(pa.array(order))
            rk = kept.column("rk").to_numpy()
            first = (rk * np.int64(-7046029254386353131) >> np.int64(40)) % FIRST == 0
            yield pa.RecordBatch.from_arrays(
                [kept.column("rk"), kept.column("vec_id"), kept.column("label"), pa.array(data, pa.binary()), pa.array(norm[order]), pa.array([a.tobytes() for a in angle[order]], pa.binary()), pa.array(first)],
                ["rk", "vec_id", "label", "q", "norm", "angles", "first"],
            )

    return scratch.save(rows.mapInArrow(run, PREPARED), "rows", compression="zstd"), dims


def _scaled(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dims))
    out[np.arange(dims) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * out)


@dataclass
class Vectors:
    """Rows of the prepared table as arrays."""

    rk: np.ndarray
    vec_id: np.ndarray
    known: np.ndarray
    label: np.ndarray
    q: np.ndarray
    norm: np.ndarray
    angles: np.ndarray

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, dims: int) -> Vectors:
        n = table.num_rows
        width = [len(x) for x in table.column("q").to_pylist()]
        data = table.column("q").to_pylist()
        q = np.zeros((n, dims))
        for size, kind in ((4, "<f4"), (8, "<f8")):
            own = np.flatnonzero(np.array(width) == size * dims)
            if dims and len(own):
                q[own] = np.frombuffer(b"".join(data[k] for k in own.tolist()), kind).reshape(len(own), dims)
        angles = np.frombuffer(b"".join(table.column("angles").to_pylist()), "<f4").reshape(n, -1) if n else np.zeros((0, 0))
        ids = table.column("vec_id")
        return cls(
            table.column("rk").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(bool) if isinstance(ids, pa.Array) else ids.is_valid().to_numpy().astype(bool),
            table.column("label").to_numpy(), q, table.column("norm").to_numpy(), angles.astype(np.float64),
        )

    def take(self, at: np.ndarray) -> Vectors:
        return Vectors(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


def score_bounds(a: Vectors, v: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all anchors ``a`` with all rows ``v``."""
    near, far = np.zeros((len(a.rk), len(v.rk))), np.full((len(a.rk), len(v.rk)), np.pi)
    for k in range(a.angles.shape[1]):
        x, y = a.angles[:, k, None], v.angles[None, :, k]
        near = np.maximum(near, np.abs(x - y))
        total = x + y
        far = np.minimum(far, np.minimum(total, 2 * np.pi - total))
    return _as_scores(near, far, a.norm[:, None] * v.norm[None, :])


def _as_scores(near: np.ndarray, far: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    least = norms * np.cos(np.minimum(far + SLACK, np.pi))
    most = norms * np.cos(np.maximum(near - SLACK, 0))
    margin = 1 + norms * 1e-9
    return np.floor(least - margin), np.ceil(most + margin)


def reachable(a: Vectors, v: Vectors) -> np.ndarray:
    """Upper bounds of the scores of each anchor with any row of the chunk ``v``."""
    near = np.zeros(len(a.rk))
    for k in range(a.angles.shape[1]):
        x = a.angles[:, k]
        near = np.maximum(near, np.maximum(v.angles[:, k].min() - x, x - v.angles[:, k].max()))
    cos = np.cos(np.maximum(near - SLACK, 0))
    norms = a.norm * np.where(cos > 0, v.norm.max(), v.norm.min())
    return np.ceil(cos * norms + 1 + a.norm * v.norm.max() * 1e-9)


def scores(a: Vectors, v: Vectors) -> np.ndarray:
    """Inner products, exact."""
    if float(a.norm.max(initial=0)) * float(v.norm.max(initial=0)) * (1 + 1e-9) < EXACT:
        return (a.q @ v.q.T).astype(np.int64)
    return a.q.astype(np.int64) @ v.q.astype(np.int64).T


class Best:
    """The first ``k`` hits of each window by score, then id, then row; ``least`` is what a hit must reach to count."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.hits = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64))

        self.waiting: list[tuple[np.ndarray, ...]] = []

    def add(self, *hits: np.ndarray) -> None:
        """Window, score, whether the id is known, id and row of each hit."""
        self.waiting.append(hits)

    def settle(self, last: bool) -> None:
        """Take in what waits, unless it is little beside what is held."""
        if not self.waiting or not last and sum(len(x[0]) for x in self.waiting) < len(self.hits[0]) // 8:
            return
        hits = tuple(np.concatenate(x) for x in zip(self.hits, *self.waiting, strict=True))
        self.waiting.clear()
        order = np.lexsort((hits[4], hits[3], ~hits[2], -hits[1], hits[0]))
        window = hits[0][order]
        place = np.arange(len(window)) - np.searchsorted(window, window, "left")
        self.hits = tuple(x[order[place < self.k]] for x in hits)
        full = order[place == self.k - 1]
        self.least[hits[0][full]] = np.maximum(self.least[hits[0][full]], hits[1][full])


def search(a: Vectors, low: np.ndarray, high: np.ndarray, same: bool, k: int, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: for each anchor and window ``low[i, j] <= score <= high[i, j]`` the first ``k`` rows of its label, or of others."""
    n, windows = low.shape
    best = Best(low.ravel(), k)
    top = high.max(axis=1, initial=-(2**62))
    for batch in batches:
        rows = Vectors.of(batch, dims)
        for at in range(0, len(rows.rk), CHUNK):
            v = rows.take(np.arange(at, min(at + CHUNK, len(rows.rk))))
            floor = best.least.reshape(n, windows).min(axis=1, initial=2**62)
            wanted = np.flatnonzero((reachable(a, v) >= floor) & (floor <= top))
            for start in range(0, len(wanted), ANCHORS):
                own = wanted[start : start + ANCHORS]
                _compare(a.take(own), own, v, best, high, same)
            best.settle(last=False)
    best.settle(last=True)
    window, score, known, vec_id, rk = best.hits
    columns = [pa.array(a.rk[window // windows]), pa.array((window % windows).astype(np.int32)), pa.array(rk), pa.array(vec_id, mask=~known), pa.array(score)] if windows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["anchor", "j", "rk", "vec_id", "score"])


def _compare(a: Vectors, own: np.ndarray, v: Vectors, best: Best, high: np.ndarray, same: bool) -> None:
    windows = high.shape[1]
    floor = best.least.reshape(-1, windows)[own]
    least, most = score_bounds(a, v)
    mask = (most >= floor.min(axis=1)[:, None]) & (least <= high[own].max(axis=1)[:, None]) & ((a.label[:, None] == v.label[None, :]) == same)
    if same:
        mask &= a.rk[:, None] != v.rk[None, :]
    anchors, rows = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(anchors):
        return
    mask = mask[np.ix_(anchors, rows)]
    score = scores(a.take(anchors), v.take(rows))
    for j in range(windows):
        inside = mask & (score >= floor[anchors, j, None]) & (score <= high[own[anchors], j, None])
        if inside.shape[1] > best.k:
            # Of many, only what reaches the k-th in this chunk; ties stay.
            shown = np.where(inside, score, -(2**62))
            inside &= score >= np.partition(shown, -best.k, axis=1)[:, -best.k, None]
        x, y = np.nonzero(inside)
        best.add(own[anchors[x]] * windows + j, score[x, y], v.known[rows[y]], v.vec_id[rows[y]], v.rk[rows[y]])


def _found(rows: DataFrame, block: Vectors, low: np.ndarray, high: np.ndarray, same: bool, k: int, dims: int, scratch: Scratch, name: str) -> DataFrame:
    """The first ``k`` rows of each window over all rows: those of the first rows close the windows for the rest."""
    sent = rows.sparkSession.sparkContext.broadcast((block, high))

    def hits(part: DataFrame, low: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors, high = sent.value
            return search(anchors, low, high, same, k, dims, batches)

        order = Window.partitionBy("anchor", "j").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rk")
        return part.drop("first").mapInArrow(run, HIT).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    early = scratch.save(hits(rows.filter("first"), low), f"{name}-early")
    # Bounded by the block: one number for each window.
    closed = early.filter(F.col("rank") == k).select("anchor", "j", "score").toArrow()
    row = {r: i for i, r in enumerate(block.rk.tolist())}
    low = low.copy()
    for anchor, j, score in zip(*(closed[c].to_pylist() for c in ("anchor", "j", "score")), strict=True):
        low[row[anchor], j] = max(low[row[anchor], j], score)
    late = hits(rows.filter("not first"), low).drop("rank")
    order = Window.partitionBy("anchor", "j").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rk")
    both = early.drop("rank").unionByName(late).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return scratch.save(both, name)


def mine(table: DataFrame, label: Column, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its first other rows of the same label; for each, the first rows of other labels come out whose score lies between
    ``low`` and ``high`` hundredths of the positive's.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows, dims = prepare(table, label, scale, scratch)
    chosen = rows.filter(is_anchor)
    all_of = rows.agg(F.coalesce(F.max("norm"), F.lit(0)).alias("norm"), F.count_if(is_anchor).alias("n")).first()
    if all_of["norm"] ** 2 * (1 + 1e-9) >= LONG:
        raise ValueError("vectors are too long for scores in 64 bits")
    blocks = -(-all_of["n"] // max(1, min(BLOCK, BLOCK_BYTES // (8 * dims + 64))))
    parts = []
    for b in range(blocks):
        block = Vectors.of(chosen.filter(F.pmod(F.xxhash64("rk"), F.lit(blocks)) == b).toArrow(), dims)
        n = len(block.rk)
        if not n:
            continue
        ids = np.where(block.known, block.vec_id, 0)
        open_low, open_high = np.full((n, 1), -(2**62), np.int64), np.full((n, 1), 2**62, np.int64)
        near = _found(rows, block, open_low, open_high, True, positives, dims, scratch, f"positives-{b}").toArrow()
        row = {r: i for i, r in enumerate(block.rk.tolist())}
        # A window that no score is in: above what is possible, and empty.
        lows, highs = np.full((n, positives), 2**62, np.int64), np.full((n, positives), -(2**62), np.int64)
        known = []
        for anchor, rank, vec_id, score in zip(*(near[c].to_pylist() for c in ("anchor", "rank", "vec_id", "score")), strict=True):
            lows[row[anchor], rank - 1], highs[row[anchor], rank - 1] = -(-low * score // 100), high * score // 100
            known.append((anchor, int(ids[row[anchor]]), rank - 1, vec_id, score))
        lows[lows > highs], highs[lows > highs] = 2**62, -(2**62)
        hits = _found(rows, block, lows, highs, False, negatives, dims, scratch, f"negatives-{b}")
        pairs = spark.createDataFrame(known, "anchor long, anchor_id long, j int, positive_id long, positive_score long")
        shown = hits.join(F.broadcast(pairs), ["anchor", "j"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        scratch.save(shown, f"mined-{b}")
        parts.append(f"{scratch.path}/mined-{b}")
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(shape).parquet(*parts) if parts else spark.createDataFrame([], shape)
