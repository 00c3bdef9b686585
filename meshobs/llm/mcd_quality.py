"""Quality rules by robust multivariate outliers.

Each text gets counts, and these a vector of transformed statistics (logarithm of the mean word length, and the
arcsine of the root of shares of symbols, capitals, exclamation marks, repeated lines and repeated word windows).  A minimum-covariance-determinant
estimate is sought for each language and source, each language, and all rows.  Three starts from medians (median
deviations alone, and with correlations of squashed values or of directions) are followed by concentration steps: the ``coverage`` share of rows nearest to the
centre gives the next centre and covariance.  After two steps the start of least determinant goes on until its determinant settles, and its covariance is widened so that
the median distance is a chi-square median.  Every step covers all rows: the vectors are whole numbers on a fine grid, so distances have exact
quantiles by counting and sums are exact in any order.  Rows whose squared Mahalanobis distance is beyond a chi-square quantile are rejected.

An estimate from ``n`` rows counts ``n / (n + SHRINK)`` against the one above it: a source leans on its language, and a language on all rows, the more the
fewer rows it has, without a size at which that changes.  Rows that fail the base rules (too short, or mostly repeated) are rejected and no estimate sees them.
The square of ``FLOOR`` is added to each variance, so a statistic that hardly varies in a group does not reject small deviations.

Nulls: a null text counts as empty and fails the base rules; a null language or source is a group value of its own.
Repeated rows are judged one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, with_row_key

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines"]
#: Steps of the grid per unit, and the least standard deviation of each statistic in units.
GRID = 1024
FLOOR = (0.06, 0.05, 0.08, 0.06, 0.2, 0.2)
P = len(FLOOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Squared distances are counted in so many steps of their logarithm.
STEPS = 512
#: The share of rows that an estimate rests on.
COVERAGE = 0.75
#: Starts of the search, most steps of the best, the rows whose weight the estimate above has, and what a step must gain.
STARTS, MAX_STEPS, SHRINK, SETTLED = 3, 40, 100, 1e-4
#: Keys up to which their estimates are broadcast: some 20 MB.  More are joined over a salt, so that no key's rows meet in one task.
BROADCAST_KEYS, SALTS = 20_000, 32

_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS, _CAPITALS, _MARKS = b"#*$%&|<>", bytes(range(0x41, 0x5B)), b"!?"


def text_counts(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS``.  Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``."""
    words = text.split()
    solid = b"".join(words)
    size = len(solid)
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    without = (size - len(solid.translate(None, drop)) for drop in (_CONTINUATION, _SYMBOLS, _CAPITALS, _MARKS))
    tail, symbols, capitals, marks = without
    return len(words), size - tail, symbols, len(lines) - len(set(lines)), repeated, capitals, marks, len(lines)


def count_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``COUNTS`` of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            columns = list(zip(*map(text_counts, texts), strict=True)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in columns)], [*keep, *COUNTS])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(count, f"{kinds}, {', '.join(f'{c} long' for c in COUNTS)}")


def _vector() -> list[Column]:
    def share(part: str, of: str) -> Column:
        return F.asin(F.sqrt(F.least(F.col(part) / F.greatest(F.col(of), F.lit(1)), F.lit(1.0))))

    mean = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    values = [mean, share("n_symbols", "word_chars"), share("n_capitals", "word_chars"), share("n_marks", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.round(v * GRID).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _squared_distance() -> Column:
    """Of the vector from ``centre`` in the metric ``inverse`` (upper triangle)."""
    off = [F.col(f"x{i}") / GRID - F.col("centre")[i] for i in range(P)]
    terms = [F.col("inverse")[k] * off[i] * off[j] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    return sum(terms[1:], terms[0])


def _steps() -> Column:
    return F.floor(F.log1p(F.greatest(_squared_distance(), F.lit(0.0))) * STEPS)


def triangle(matrix: np.ndarray) -> list[float]:
    return [float(matrix[i, j]) for i, j in PAIRS]


def square(values: list[float]) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, values, strict=True):
        out[i, j] = out[j, i] = v
    return out


def estimate(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[list[float], np.ndarray]:
    """Centre and covariance from exact sums over grid values."""
    centre = sums / n
    covariance = square([products[k] / n - centre[i] * centre[j] for k, (i, j) in enumerate(PAIRS)]) / GRID**2
    return (centre / GRID).tolist(), covariance + np.diag(np.square(FLOOR))


def start_metrics(spread: np.ndarray, moments: list[np.ndarray]) -> list[np.ndarray]:
    """Covariances to start from: ``spread`` alone, and with the correlations that each of ``moments`` (upper triangles) has."""
    scale = np.diag(np.sqrt(np.square(spread) + np.square(FLOOR)))
    found = [scale @ scale]
    for m in moments:
        second = square(m.tolist())
        size = np.sqrt(np.maximum(np.diag(second), 1e-9))
        found.append(scale @ (0.99 * second / np.outer(size, size) + 0.01 * np.eye(P)) @ scale)
    return found


def _started(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            for k, metric in enumerate(start_metrics(np.array(r.spread), [np.array(r.squashed, float), np.array(r.directed, float)])):
                # A statistic without any deviation has no correlation.
                metric = np.where(np.isfinite(metric), metric, 0) + np.diag(np.where(np.isfinite(np.diag(metric)), 0, 1))
                rows.append((r.key, k, list(r.centre), triangle(metric), triangle(np.linalg.pinv(metric)), float(np.linalg.slogdet(metric)[1]), 0, [0] * P))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ESTIMATE.split(", ")])


ESTIMATE = "key string, start int, centre array<double>, covariance array<double>, inverse array<double>, logdet double, n long, sums array<long>"


def _concentrated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            sums = [int(getattr(r, f"s{i}")) for i in range(P)]
            centre, covariance = estimate(float(r.n), np.array(sums, float), np.array([getattr(r, f"p{k}") for k in range(len(PAIRS))], float))
            rows.append((r.key, r.start, centre, triangle(covariance), triangle(np.linalg.inv(covariance)), float(np.linalg.slogdet(covariance)[1]), int(r.n), sums))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ESTIMATE.split(", ")])


def chi_square(p: int, z: float) -> float:
    """The chi-square quantile at the normal quantile ``z``, by the cube-root approximation."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def with_small(rows: DataFrame, small: DataFrame, n_keys: int, on: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``small``, which has a row per key; a key may hold most of ``rows``."""
    if n_keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(small), on, how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*(f"x{i}" for i in range(P))), F.lit(SALTS)))
    return salted.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [on, "salt"], how).drop("salt")


def starts_of(vectors: DataFrame, n_keys: int, scratch: Scratch) -> DataFrame:
    """The estimates to start from, ``STARTS`` rows per key.  Moments are sums of whole numbers in steps of 1/1024."""
    middle = scratch.save(vectors.groupBy("key").agg(*(F.percentile(f"x{i}", 0.5).alias(f"m{i}") for i in range(P))), "middle")
    off = with_small(vectors, middle, n_keys, "key")
    deviation = off.groupBy("key").agg(*(F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i in range(P)))
    middle = scratch.save(middle.join(deviation, "key"), "deviation")
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / (1.4826 * F.col(f"d{i}") + FLOOR[i] * GRID) for i in range(P)]
    rows = with_small(vectors, middle, n_keys, "key").select("key", *(f"m{i}" for i in range(P)), *(f"d{i}" for i in range(P)), *(z[i].alias(f"z{i}") for i in range(P)))
    size = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0")))
    whole = [*(F.round(F.tanh(f"z{i}") * 1024).cast("long").alias(f"t{i}") for i in range(P)), *(F.round(F.when(size > 0, F.col(f"z{i}") / size).otherwise(0.0) * 1024).cast("long").alias(f"u{i}") for i in range(P))]
    products = [F.sum(F.col(f"{c}{i}") * F.col(f"{c}{j}")).alias(f"{c}{c}{k}") for c in "tu" for k, (i, j) in enumerate(PAIRS)]
    summed = rows.select("*", *whole).groupBy("key").agg(*(F.first(f"{c}{i}").alias(f"{c}{i}") for c in "md" for i in range(P)), *products)
    ready = summed.select(
        "key", F.array(*(F.col(f"m{i}") / GRID for i in range(P))).alias("centre"), F.array(*(1.4826 * F.col(f"d{i}") / GRID for i in range(P))).alias("spread"),
        *(F.array(*(F.col(f"{c}{c}{k}") for k in range(len(PAIRS)))).alias(name) for c, name in (("t", "squashed"), ("u", "directed"))),
    )
    return scratch.save(ready.mapInPandas(_started, ESTIMATE), "starts")


def concentrated(vectors: DataFrame, found: DataFrame, n_keys: int, coverage: float) -> DataFrame:
    """One concentration step of each estimate of ``found``."""
    far = with_small(vectors, found.select("key", "start", "centre", "inverse"), n_keys, "key").withColumn("d", _steps())
    # Sums by distance, of which a key has some thousands at most; then those of the nearest rows.
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{k}") for k, (i, j) in enumerate(PAIRS)]
    rings = far.groupBy("key", "start", "d").agg(F.count(F.lit(1)).alias("n"), *sums)
    own = Window.partitionBy("key", "start")
    inside = F.sum("n").over(own.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    near = rings.withColumns({"inside": inside, "all": F.sum("n").over(own)}).filter(F.col("inside") < coverage * F.col("all"))
    names = ["n", *(f"s{i}" for i in range(P)), *(f"p{k}" for k in range(len(PAIRS)))]
    return near.groupBy("key", "start").agg(*(F.sum(c).alias(c) for c in names)).mapInPandas(_concentrated, ESTIMATE)


def estimates(vectors: DataFrame, n_keys: int, scratch: Scratch, coverage: float) -> DataFrame:
    """``key, n_rows, centre, covariance`` per value of ``key`` in ``vectors`` (``key, x0 ...``).

    Every start gets two steps; that of least determinant goes on while a step lowers the logarithm of its determinant by more than ``SETTLED``.
    """
    found = starts_of(vectors, n_keys, scratch)
    for step in range(2):
        found = scratch.save(concentrated(vectors, found, n_keys, coverage), f"first-{step}")
    names = [c.split()[0] for c in ESTIMATE.split(", ")]
    best = found.groupBy("key").agg(F.min_by(F.struct(*names[1:]), F.struct("logdet", "start")).alias("e")).select("key", "e.*")
    best = going = scratch.save(best, "best")
    small = F.broadcast if n_keys <= BROADCAST_KEYS else (lambda df: df)
    for step in range(MAX_STEPS):
        last = going.select("key", F.col("logdet").alias("last"))
        further = concentrated(vectors, going, n_keys, coverage).join(small(last), "key").filter(F.col("last") - F.col("logdet") > SETTLED)
        going = scratch.save(further.select(*names), f"step-{step}")
        if going.isEmpty():
            break
        best = scratch.save(best.join(small(going.select("key")), "key", "left_anti").select(*names).unionByName(going), f"best-{step}")
    # The nearest rows are less spread than all.
    half = with_small(vectors, best.select("key", "centre", "inverse"), n_keys, "key").groupBy("key").agg(F.percentile(_steps(), 0.5).alias("median"), F.count(F.lit(1)).alias("n_rows"))
    wider = F.greatest(F.lit(1.0), F.expm1((F.col("median") + 0.5) / STEPS) / chi_square(P, 0.0))
    return scratch.save(best.join(half, "key").select("key", "n_rows", "centre", F.transform("covariance", lambda v: v * wider).alias("covariance")), "estimates")


def leaned(levels: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the last of ``levels`` (rows, centre, covariance), each leaning on the one before it."""
    _, centre, covariance = levels[0]
    for n, c, v in levels[1:]:
        w = n / (n + SHRINK)
        centre, covariance = w * c + (1 - w) * centre, w * v + (1 - w) * covariance
    return centre, covariance


def _lean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [leaned([(getattr(r, f"n_rows{k}"), np.array(getattr(r, f"centre{k}")), square(list(getattr(r, f"covariance{k}")))) for k in (2, 1, 0)]) for r in frame.itertuples()]
        yield pd.DataFrame({"g0": frame["g0"], "centre": [c.tolist() for c, _ in found], "inverse": [triangle(np.linalg.inv(v)) for _, v in found]})


def judge(docs: DataFrame, keep: list[str], scratch: Scratch, z: float = 4.0, coverage: float = COVERAGE) -> DataFrame:
    """``keep``, ``COUNTS``, ``base_failed``, ``distance`` (squared) and ``kept`` of every row.

    ``z`` is the normal quantile beyond which a row is an outlier; at 4 some thirty in a million normal rows are.
    """
    counted = count_texts(docs.select(*dict.fromkeys([*keep, "lang", "source", "text"])), list(dict.fromkeys([*keep, "lang", "source"])))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Null fields are written too, so that a null language or source is a value of its own on each level.
    levels = [F.struct("lang", "source"), F.struct("lang"), F.struct(F.lit("all").alias("rows"))]
    groups = [F.concat(F.lit(f"{k} "), F.to_json(level, {"ignoreNullFields": "false"})) for k, level in enumerate(levels)]
    rows = counted.select("*", failed.alias("base_failed"), *_vector(), *(g.alias(f"g{k}") for k, g in enumerate(groups)))
    rows = scratch.save(rows, "counts")
    sound = rows.filter("NOT base_failed")
    used = scratch.save(sound.select("g0", "g1", "g2").distinct(), "groups")
    n_keys = used.select(F.explode(F.array("g0", "g1", "g2")).alias("key")).distinct().count()
    vectors = sound.select(F.explode(F.array("g0", "g1", "g2")).alias("key"), *(f"x{i}" for i in range(P)))
    found = estimates(vectors, n_keys, scratch, coverage)
    for k in range(3):
        level = found.select(F.col("key").alias(f"g{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("n_rows", "centre", "covariance")))
        used = used.join(F.broadcast(level) if n_keys <= BROADCAST_KEYS else level, f"g{k}")
    own = scratch.save(used.mapInPandas(_lean, "g0 string, centre array<double>, inverse array<double>"), "own")
    distance = F.when(~F.col("base_failed"), _squared_distance())
    out = with_small(rows, own, n_keys, "g0", "left").withColumn("distance", distance)
    return out.select(*keep, *COUNTS, "base_failed", "distance", F.coalesce(F.col("distance") <= chi_square(P, z), F.lit(False)).alias("kept"))


def mcd_quality(docs: DataFrame, z: float = 4.0, coverage: float = COVERAGE) -> DataFrame:
    """Counts and verdict of every row, named by its ``doc_id``."""
    return judge(docs, ["doc_id"], Scratch(docs.sparkSession, "mcd-quality"), z, coverage)


def accepted(docs: DataFrame, columns: list[str], z: float = 4.0) -> DataFrame:
    """``columns`` of the rows that are kept."""
    scratch = Scratch(docs.sparkSession, "mcd-quality")
    keyed = with_row_key(docs, ["doc_id", "lang", "source", "text"], scratch, columns)
    stay = judge(keyed, ["rk"], scratch, z).filter("kept").select("rk")
    return keyed.join(stay, "rk", "left_semi").select("row.*")
