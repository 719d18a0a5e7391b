"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import (
    bpe,
    jaccard,
    mixing,
    neardup,
    neighbours,
    secret_scan,
    sharding,
    spelling,
    tokenfile,
    toxicity,
    urls,
    whitening,
    wordpiece,
)
from nearfield.session import attach

Query = Callable[[SparkSession, str], DataFrame]
END_OF_DOCUMENT = 2
MIX = mixing.Target(entropy=0.97)
BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_read(spark, sf_dir, "documents"))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, keep_ids=False)


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.predict(docs, chain).withColumnRenamed("rejected", "toxic")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    folder = tokenfile.write_tokens(docs, public_tokenizers.path(WORD_VOCABULARY), END_OF_DOCUMENT)
    return tokenfile.read_tokens(spark, folder, keep_ids=False)


def op7_tile_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "embeddings"), 0.98)


def op8_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan_paths(docs, secret_scan.open_ledger(spark)))


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    total = docs.agg(F.sum(mixing.token_count(F.col("text")))).first()[0] or 0
    mix = mixing.plan_mix(docs, MIX, budget=total)
    return mixing.copies(docs.select("doc_id", "source"), mix).select("doc_id", "source", "epochs", "copies", "turn", "place")


def op10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    placed = sharding.shard(docs, keep=["doc_id", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    named = [op1_jaccard_join, op2_learned_partitions, op3_url_filter, op4_byte_bpe, op5_toxicity_chain]
    named += [op6_token_files, op7_tile_near_duplicates, op8_blob_ledger, op9_temperature_mix, op10_piece_counts]
    named += [op11_polarised_whitening, op12_histogram_shards, op13_spelling_variants]
    return {query.__name__: query for query in named}
