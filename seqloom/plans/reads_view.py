"""A deterministic view of sequence records over the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the view, the same in SQL: letters outside the nucleotide codes become codes; a quality for each code.
LETTERS, CODES = "EFIJLOPQXZ", "ACGTNACGTN"
BASES, QUALITIES = "ABCDGHKMNRSTUVWY", "I#5?FHB<!G>E=D9;"

def _quality(sequence: Column) -> Column:
    return F.translate(sequence, BASES, QUALITIES)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_idx, name, sequence, qualities, source: one record for each document, of all letters of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    mate = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("/"), (1 + F.col("doc_id") % 3).cast("string")))
    comment = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit(" "), "lang", F.lit(" "), "source"))
    return (
        docs.withColumn("sequence", F.translate(F.upper(letters), LETTERS, CODES))
        .withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string"), mate, comment))
        .select(F.col("doc_id").alias("rec_idx"), "name", "sequence", _quality(F.col("sequence")).alias("qualities"), "source")
    )


READS_SQL = f"""
WITH b AS (
  SELECT doc_id, lang, source,
    translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{CODES}') AS sequence
  FROM documents
), reads AS (
  SELECT doc_id AS rec_idx,
    concat('d', CAST(doc_id AS VARCHAR),
      CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('/', CAST(1 + doc_id % 3 AS VARCHAR)) END,
      CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(' ', lang, ' ', source) END) AS name,
    sequence, translate(sequence, '{BASES}', '{QUALITIES}') AS qualities, source
  FROM b
)
"""
