"""The pipeline's stages, each against brute force on what the stage before kept."""

import random

import corpus_pipeline
from edge import REPEATED, frame
from pyspark.sql import functions as F
from test_dedup import bare, brute_near
from test_quality import brute_verdicts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, stays) in brute_verdicts(docs.collect()).items() if stays}
    once = corpus_pipeline.exact_dedup(spark, kept, SF).cache()
    assert once.columns == docs.columns and once.count() == len({bare(r.text) for r in kept.collect()})
    apart = corpus_pipeline.near_dedup(spark, once, SF).cache()
    rows = [tuple(r) for r in once.collect()]
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, _, c in brute_near(rows)})
    packed = corpus_pipeline.packing(spark, apart, SF)
    assert sorted(r.doc_id for r in packed.select("doc_id").distinct().collect()) == sorted(r.doc_id for r in apart.collect())
    whole = corpus_pipeline.run(spark, SF)
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(order).collect())) == sorted(map(tuple, packed.select(order).collect()))
    assert whole.agg(F.countDistinct("sequence_id")).first()[0] == packed.agg(F.countDistinct("sequence_id")).first()[0]


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    """Columns of documents stay through the first three stages, rows without an id count one by one, and an empty table passes."""
    rng = random.Random(2)
    words = [f"word{k}" for k in range(500)]
    more = [(k if k % 5 else None, " ".join(rng.choice(words) for _ in range(80)), "en" if k % 3 else None, None, 1) for k in range(100, 140)]
    docs = frame(spark, [*REPEATED, *more, more[1], more[0], more[5]])
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, seen, SF).cache()
        if k < 3:
            assert result.columns == docs.columns
            seen = result
    texts = [r.text for r in seen.collect()]
    assert len(texts) == len(set(texts)) and {m[1] for m in more} <= set(texts)
    assert result.count() >= len(texts) and result.filter("piece = 0").count() == len(texts)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
