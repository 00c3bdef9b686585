"""Distances of sources, against every cell of the matrix one by one."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge import REPEATED, frame

from meshobs.llm import divergence_audit as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs, top=50):
    counts, docs_of = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
        counts[lang or "", source or ""].update(terms)
        docs_of[lang or ""].update(set(terms))
    out = []
    for lang, docs in docs_of.items():
        terms = [t for t, n in docs.items() if n >= min_docs]
        own = {s: {t: c[t] for t in terms} for (la, s), c in counts.items() if la == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in terms}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(terms)) for t in terms}
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            far = [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode()) for o in own if o != s]
            more = [(q[t] - p[s][t], t.encode()) for t in terms if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(far)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def draw(seed, sources, words, docs):
    rng = random.Random(seed)
    rows = []
    for k in range(docs):
        lang, source = rng.choice(["en", "de", None]), rng.choice([*(f"s{i}" for i in range(sources)), None])
        text = " ".join(rng.choice(["É", "x", "Word"]) + str(rng.choice("abc")) * rng.randrange(1, words) for _ in range(rng.randrange(60)))
        rows.append((k, text.replace("a", rng.choice("aA")), lang, source, 1))
    return [*rows, (None, None, "fr", None, 1), (None, "", "fr", "s1", 1), (1, "lone", "it", "s1", 1), rows[0], rows[0]]


@pytest.mark.parametrize("columns, rows, sources", [(4096, 512, 11), (7, 8, 30), (30, 16, 20)])
def test_against_brute_force(spark, columns, rows, sources):
    data = draw(columns, sources, 30, 400)
    got = sorted(map(tuple, D.audit(frame(spark, data), min_docs=3, top_terms=6, columns=columns, rows=rows).collect()))
    assert got == brute(data, 3, 6)


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE", 7)
    monkeypatch.setattr(D, "MAX_ENTRIES", 10)
    for least in (1, 2, 30):
        assert sorted(map(tuple, D.audit(frame(spark, REPEATED), min_docs=least).collect())) == brute(REPEATED, least)
    assert D.audit(frame(spark).limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_tree_against_the_dense_matrix(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 40)), int(rng.integers(1, 90))
    zero = rng.integers(1, 1000, n)
    filled = rng.random((n, m)) < [0.02, 0.3, 1, 0][seed]
    dense = np.where(filled, rng.integers(1, 5000, (n, m)), zero[:, None])
    g, c = np.nonzero(filled)
    got = D.distances(g, c, dense[g, c], zero)
    want = np.abs(dense[:, None, :] - dense[None, :, :]).sum(axis=2) - m * np.abs(zero[:, None] - zero[None, :])
    assert (np.triu(got, 1) == np.triu(want, 1)).all()


def test_shares_of_large_counts(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, 1), (7, 9, 3), (10**15, 10**15, 1), (10**14 + 3, 8 * 10**15, 10**6), (5 * 10**14, 10**15, 12345)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select(D.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows]
