"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit_packing import best_fit_packing
from .bpe_transducer import encode_and_decode
from .ctw_stream import stream_scores
from .divergence_audit import audit
from .exact_dedup import exact_dedup
from .flow_reshard import reshard
from .hard_negatives import mine
from .mcd_quality import mcd_quality
from .ngram_jaccard import ngram_jaccard
from .piece_rounds import decode, encode
from .quote_linking import link_quotes
from .training_order import materialise
from .url_filters import filter_urls

JSON_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the shard files that it writes, with a checksum of each record as read back."""
    return materialise(_table(spark, sf_dir, "documents"), JSON_VOCABULARY, key="training order, epoch 1")


def op2_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_scores(_table(spark, sf_dir, "documents"))


def op3_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = mcd_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_table(spark, sf_dir, "conversations"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As they lie, documents are sharded by their source, so the old sizes are far apart."""
    by_source = F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")), F.lit(SHARDS))
    placed = reshard(_table(spark, sf_dir, "documents"), by_source, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), JSON_VOCABULARY)


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(_table(spark, sf_dir, "documents"), PIECES), PIECES)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels are moved by one, so that neighbours of other labels exist."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_training_order, op2_ctw_scoring, op3_mcd_quality, op4_quote_linking, op5_ngram_jaccard, op6_exact_dedup, op7_flow_reshard, op8_best_fit_packing, op9_bpe_transducer, op10_url_filters, op11_piece_rounds, op12_hard_negatives, op13_divergence_audit)
}
