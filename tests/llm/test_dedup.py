"""Exact and near duplicates, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from edge import REPEATED, ROWS, SCHEMA, frame

from meshobs.llm import exact_dedup, ngram_jaccard
from meshobs.llm.common import Scratch
from meshobs.llm.components import connect


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_exact(rows):
    groups = {}
    for row in rows:
        groups.setdefault(bare(row[1]), []).append(row)
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))
        for k, r in enumerate(sorted(members, key=lambda r: r is not keep)):
            out.append((r[0], keep[0], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("digest_bytes", [32, 16, 0, 1])
@pytest.mark.parametrize("rows", [ROWS, REPEATED, []])
def test_exact(spark, rows, digest_bytes):
    got = exact_dedup.exact_dedup(frame(spark, rows), memtable_rows=4, digest_bytes=digest_bytes).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_exact(rows)))


def test_survivors_keep_columns(spark):
    df = frame(spark, REPEATED)
    got = exact_dedup.survivors(df, df.columns)
    assert got.columns == df.columns
    assert sorted(bare(r.text) for r in got.collect()) == sorted({bare(r[1]) for r in REPEATED})


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_near(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for k, r in enumerate(rows):
        ids = [rows[i][0] for i in range(len(rows)) if find(i) == find(k) and rows[i][0] is not None]
        out.append((r[0], len(sets[k]), min(ids, default=None)))
    return out


@pytest.mark.parametrize("rows", [ROWS, REPEATED, []])
def test_near_edges(spark, rows):
    got = ngram_jaccard.ngram_jaccard(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_near(rows)))


def family(seed):
    """Texts of all sizes with edits at every rate, shared passages and chains of near copies."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 8, 12, 20, 40, 90, 200]))]
        texts.append(base)
        chain = base
        for _ in range(rng.randint(1, 6)):
            edited = list(chain if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, max(1, len(edited) // 30))):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            if rng.random() < 0.3:
                edited += [rng.choice(words) for _ in range(rng.randint(1, 1 + len(edited) // 6))]
            texts.append(edited)
            chain = edited
    texts += [[rng.choice(words) for _ in range(30)] + passage + [rng.choice(words) for _ in range(30)] for _ in range(8)]
    return [(k, " ".join(t), "en", "a", 1) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed, boundary", [(1, None), (2, 16), (3, 64), (4, 0)])
def test_near_against_brute_force(spark, monkeypatch, seed, boundary):
    if boundary is not None:
        monkeypatch.setattr(ngram_jaccard, "choose_boundary", lambda classes: boundary)
    rows = family(seed)
    got = ngram_jaccard.ngram_jaccard(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_near(rows))


def test_representatives(spark):
    df = frame(spark, REPEATED)
    got = ngram_jaccard.representatives(df, df.columns)
    assert got.columns == df.columns
    kept = [r.text for r in got.collect()]
    full = {frozenset(shingles(t)) for t in kept if shingles(t)}
    assert len(full) == sum(bool(shingles(t)) for t in kept)


def test_components(spark):
    rng = random.Random(7)
    links = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(200, k) for k in range(201, 260)]
    got = {r.rep: r.label for r in connect(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    assert got == {x: find(x) for x in parent}


def test_sketches_never_bound_too_low():
    """Sets of all sizes that share much, little, or only their first elements."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n, m = rng.integers(1, 60, 2)
        pool = rng.integers(0, 1 << 63, 120, dtype=np.uint64) >> np.uint64(int(rng.integers(0, 2)) * 20)
        x, y = (np.unique(rng.choice(pool, k, replace=False)) for k in (n, m))
        if rng.random() < 0.5:
            y = np.unique(np.concatenate((x[: int(rng.integers(0, len(x) + 1))], y)))
        keep = lambda s: s[: len(s) - -(-75 * len(s) // 100) + 2]
        p, q = keep(x), keep(y)
        most = ngram_jaccard.most_common(len(x), int(p[-1]), p.astype("<u2"), len(y), int(q[-1]), q.astype("<u2"))
        assert most >= len(np.intersect1d(x, y))


def test_words_and_shingles_are_told_apart_by_hashes():
    rng = random.Random(9)
    blanks, letters = " \t\n\x0b\x0c\r", "ab\x00\x0e\x1cé日Z"
    texts = ["".join(rng.choice(letters if rng.random() < 0.9 else blanks) for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["", " ", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "x" * 8 + "\x00", "x" * 8, None]
    data = [None if t is None else t.encode() for t in texts]
    hashes, sizes = ngram_jaccard.word_hashes(data)
    words = [w for t in data for w in (t or b"").lower().split()]
    assert sizes.tolist() == [len((t or b"").lower().split()) for t in data] and len(words) == len(hashes)
    assert len(dict.fromkeys(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist(), strict=True)))
    for text, found in zip(texts, ngram_jaccard.shingle_hashes(data), strict=True):
        assert len(set(found.tolist())) == len(shingles(text))


@pytest.mark.parametrize("rows", [ROWS, REPEATED])
def test_sql_counts_repeated_and_null_ids_row_by_row(spark, tmp_path, rows):
    import duckdb

    from meshobs.llm.oracles import EXACT_DEDUP
    from meshobs.llm.queries import op6_exact_dedup

    frame(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = op6_exact_dedup(spark, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(EXACT_DEDUP).fetchall(), key=repr)
