"""The registered queries of the operators, over the whole tables, and their SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwork.llm import alignment, bpe_transducer, chat, html_extract, itq, line_dedup, oracles, packing, quality, repair, sharding, simhash, superminhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn int, role string, text string"
    )
    return chat.digests(chat.format_chats(turns.unionByName(probe)))


def op5_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    extracted = html_extract.extract(pages, html_extract.fit(pages))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_transducer.round_trip(docs, path, public_tokenizers.PATTERN)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints(_table(spark, sf_dir, "documents"))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repair(repair.damaged(_table(spark, sf_dir, "conversations"))))


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.documents(_table(spark, sf_dir, "documents"), shards=24)


def op13_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(_table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN)


QUERIES: dict[str, Query] = {
    "op1_itq_near_dedup": op1_itq_near_dedup,
    "op2_attention_quality": op2_attention_quality,
    "op3_zstd_toxicity": op3_zstd_toxicity,
    "op4_chat_format": op4_chat_format,
    "op5_dom_trees": op5_dom_trees,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_simhash": op9_simhash,
    "op10_superminhash": op10_superminhash,
    "op11_auction_repair": op11_auction_repair,
    "op12_feistel_shards": op12_feistel_shards,
    "op13_lockstep_alignment": op13_lockstep_alignment,
}

SQL: dict[str, str] = oracles.SQL
