"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents, extra ones of any names included; n_chars
follows the text. Null and repeated ids are allowed: rows are told apart by id and text, and of equal rows
the near-duplicate stage keeps one; there, rows without an id stay, once for each text. A null text is in no
known language and goes with the first stage (if there is nothing to learn languages from, it stays). Texts
are taken whole, however long they are. Empty tables pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe_transducer, language_id, line_spread, parity_join, positional_index
from seqloom.llm.scratch import materialise, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The columns of documents that stages know; all others bear made-up names within a stage.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
#: The least calibrated probability of a language for a document to stay.
SURE = 0.5


def _apart(stage: Stage) -> Stage:
    """A stage that returns its input's columns and that no name of an extra column can disturb."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = docs.toDF(*(c if c in KNOWN else f"extra_{i}" for i, c in enumerate(docs.columns)))
        return stage(spark, inner, sf_dir).select(*inner.columns).toDF(*docs.columns)

    return run


@_apart
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that can be learned; all, if there is nothing to learn from."""
    model = language_id.fit(docs)
    if model is None:
        return docs
    found = language_id.predict(docs, model, *docs.columns, names=("_language", "_sure"))
    return found.where((F.col("_language") != language_id.UNKNOWN) & (F.col("_sure") >= SURE))


@_apart
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources share."""
    out = line_spread.remove_lines(docs, line_spread.boilerplate(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


@_apart
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8): the least doc_id."""
    groups = parity_join.groups(docs, 5, 80, 100)
    stays = groups.where((F.col("component_id") == F.col("doc_id")) | (F.col("n_shingles") == 0)).select("doc_id").distinct()
    known = docs.where("doc_id IS NOT NULL").join(stays, "doc_id", "left_semi").select(*docs.columns)
    return known.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"]))


def _row_key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))


@_apart
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = positional_index.contamination(docs.select(_row_key().alias("doc_id"), "text"), items)
    leaks = found.where("contaminated").select(F.col("doc_id").alias("_leak"))
    return docs.join(leaks, _row_key() == F.col("_leak"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of each document's ids and of what these decode to."""
    return bpe_transducer.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near),
    ("decontamination", drop_leaks),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out = materialise(out, name)
            release(docs)
        docs = out
    return docs


#: Language ID, near duplicates and byte-level BPE can't be written in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None
