"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab.llm import (
    annforest,
    bitpack,
    bytebpe,
    divergence,
    linededup,
    merkle,
    oracles,
    packing,
    pii,
    quality_rules,
    resampling,
    simhash,
    token_counts,
    toxicity,
)
from quorumlab.llm.frames import table
from quorumlab.llm.registry import query
from quorumlab.session import scratch_path

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op1_importance_resampling")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_crf_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.train(pii.labelled_table(spark)))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


@query("op4_bit_packed_ids")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packed-ids")
    bitpack.write(table(spark, sf_dir, "documents"), path, WORD_VOCABULARY)
    return bitpack.read(spark, path)


@query("op5_simhash_trie")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


@query("op7_toxic_segments")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = toxicity.score(docs, toxicity.learn(docs, labels, ~held_out))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "passages"
    )


@query("op8_projection_forest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op11_line_dedup", oracles.LINE_DEDUP)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", oracles.MERKLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op13_source_divergence", oracles.DIVERGENCE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
