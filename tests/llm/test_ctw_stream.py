"""Language-model scores over whole texts, against one dictionary per tree node."""

import math
import zlib

import numpy as np
import pytest
from edge import REPEATED
from test_quality import SMALL

from meshobs.llm import ctw_scoring as ctw
from meshobs.llm import ctw_stream
from meshobs.llm.queries import op2_ctw_scoring


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def steps(text, depth):
    data = b" " * depth + b"".join(w + b" " for w in (text or "").encode().lower().split()) + bytes([ctw.END])
    for at in range(depth, len(data)):
        for k in range(8):
            yield data[at - depth : at], 1 << k | data[at] >> (8 - k), data[at] >> (7 - k) & 1


def brute(docs, depth):
    counts = {}
    for doc, text, *_ in docs:
        for context, bits, bit in steps(text, depth):
            for d in range(depth + 1):
                n = counts.setdefault((context[depth - d :], bits), [0, 0])
                n[bit] += not is_held(doc)
    kt = {node: ctw.log_kt(np.array([float(a)]), np.array([float(b)]))[0] for node, (a, b) in counts.items()}
    weighted, below = {}, {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        context, bits = node
        weighted[node] = kt[node] if len(context) == depth else np.logaddexp(kt[node], below[node]) - math.log(2)
        if context:
            below[context[1:], bits] = below.get((context[1:], bits), 0) + weighted[node]

    def chance(context, bits, bit, d=0):
        node = (context[depth - d :], bits)
        own = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
        if d == depth:
            return own
        share = math.exp(kt[node] - math.log(2) - weighted[node])
        return share * own + (1 - share) * chance(context, bits, bit, d + 1)

    return [(doc, sum(math.log10(chance(*s)) for s in steps(text, depth))) for doc, text, *_ in docs]


@pytest.mark.parametrize("depth, block", [(3, 1 << 20), (6, 300)])
def test_stream_against_brute_force(spark, depth, block):
    df = spark.createDataFrame(SMALL, "doc_id long, text string, lang string")
    got = sorted(((r.doc_id, r.score) for r in ctw_stream.stream_scores(df, depth, block).collect()), key=repr)
    want = sorted(brute(SMALL, depth), key=repr)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert all(abs(a - b) < 0.01 for (_, a), (_, b) in zip(got, want, strict=True))


def test_other_columns_as_in_the_form_by_words(spark):
    df = spark.createDataFrame([(d, t, lang) for d, t, lang, *_ in REPEATED], "doc_id long, text string, lang string")
    of = lambda found: sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found.collect()), key=repr)
    assert of(ctw_stream.stream_scores(df)) == of(ctw.ctw_scores(df))
    assert ctw_stream.stream_scores(df.limit(0)).count() == 0


def test_the_query_sees_the_order_of_words(spark, tmp_path):
    rows = [(k, "one two three four five six", "en") for k in range(1, 30)] + [(100, "six two five one four three", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in op2_ctw_scoring(spark, str(tmp_path)).collect()}
    assert got[1] > got[100] + 1
