"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import (
    bpe_transducer,
    compaction,
    language_id,
    line_spread,
    parity_join,
    positional_index,
    randomness,
    robust_outliers,
    suffix_tree,
    url_bayes,
)
from seqloom.llm.scratch import new_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.clean(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = compaction.ShardStore(spark, new_path(spark, "store"))
    store.append_dealt(table(spark, sf_dir, "documents"), 8)
    version = store.compact()
    store.vacuum()
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op5_url_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(url_bayes.RULES, "verdict string, host string, path string")
    return url_bayes.judge(pages, rules, pages.select(F.col("html").alias("text")))


def op4_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).drop("items")


def op6_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomness.digests(table(spark, sf_dir, "documents"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.groups(table(spark, sf_dir, "documents"), 4, 85, 100)


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.outliers(table(spark, sf_dir, "documents"))


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_transducer.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model, "doc_id")
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Query] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_line_spread": op2_line_spread,
    "op3_compaction": op3_compaction,
    "op4_positional_index": op4_positional_index,
    "op5_url_bayes": op5_url_bayes,
    "op6_randomness": op6_randomness,
    "op7_parity_join": op7_parity_join,
    "op8_robust_outliers": op8_robust_outliers,
    "op9_bpe_transducer": op9_bpe_transducer,
    "op10_language_id": op10_language_id,
}

SQL: dict[str, str] = {
    "op2_line_spread": line_spread.SQL,
    "op3_compaction": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
}
