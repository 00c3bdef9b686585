"""Hard negatives, against all scores of whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshobs.llm import hard_negatives as H
from meshobs.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        used.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for k, (anchor, q, label) in enumerate(used):
        if anchor is None or anchor % 100:
            continue
        hits = [(-sum(x * y for x, y in zip(q, v, strict=False)), i is None, i, n == k, own == label) for n, (i, v, own) in enumerate(used)]
        hits.sort(key=lambda h: (h[0], h[1], h[2] or 0))
        for score, _, positive, *_ in [h for h in hits if h[4] and not h[3]][:5]:
            fit = [(i, -s) for s, _, i, _, same in hits if not same and 30 * -score <= 100 * -s <= 90 * -score][:10]
            out += [(anchor, positive, r, i, -score, s) for r, (i, s) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def draw(seed, n, dims, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    vectors = centres[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dims))
    ids = rng.permutation(n * 2)[:n]
    ids[: n // 20] *= 100
    rows = [(int(i), [float(x) for x in v], int(label)) for i, v, label in zip(ids, vectors, rng.integers(0, 4, n), strict=True)]
    same = rows[3][1]
    rows += [(5000 + k, same, k % 3) for k in range(40)]
    odd = [(None, same, 1), (100, same, 2), (100, same, 2), (200, None, 1), (300, same, None), (400, [1.0, None], 1), (500, [float("nan"), 1.0], 1), (600, [float("inf"), 1.0], 1), (700, [], 1), (800, [0.5], 2), (900, [0.0] * dims, 1), (1000, [-x for x in same], 0), (None, None, None)]
    return [*rows, *odd]


@pytest.mark.parametrize("seed, dims, spread", [(1, 5, 0.2), (2, 3, 1.0), (3, 24, 0.05)])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed, dims, spread):
    monkeypatch.setattr(H, "BLOCK", 9)
    rows = draw(seed, 300, dims, spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("rk", "q", "rank", "anchor", "first")})
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in op12_hard_negatives(spark, str(tmp_path)).collect()]
    want = brute(rows)
    assert len(want) > 50
    assert sorted(got, key=repr) == want


def test_empty_tables_and_long_vectors(spark):
    mine = lambda rows: H.mine(spark.createDataFrame(rows, SCHEMA), F.col("label"), F.col("vec_id") % 100 == 0).collect()
    assert mine([]) == mine([(1, [1.0], 1)]) == mine([(100, [1.0], 1)]) == mine([(100, None, 1)]) == []
    with pytest.raises(ValueError):
        mine([(100, [1e30, 1.0], 1), (101, [1e30, 1.0], 1)])


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    q = np.floor(256 * np.concatenate([rng.normal(size=(60, 6)), np.repeat(rng.normal(size=(2, 6)), 9, axis=0), np.zeros((2, 6))]) * [1, 1000, 10**6][seed])
    refs, norm = H.directions(q), np.linalg.norm(q, axis=1)
    angles = np.arccos(np.clip((q @ refs.T) / np.maximum(norm, 1e-300)[:, None], -1, 1)).astype("<f4").astype(float)
    v = H.Vectors(np.arange(len(q)), np.arange(len(q)), np.ones(len(q), bool), np.zeros(len(q)), q, norm, angles)
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in q] for a in q], dtype=np.int64)
    low, high = H.score_bounds(v, v)
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low < np.outer(norm, norm)).mean() > 0.2
    assert (H.reachable(v, v.take(np.arange(7, 30))) >= exact[:, 7:30].max(axis=1)).all()
    assert (H.scores(v, v) == exact).all()
