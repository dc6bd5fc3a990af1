"""Structured Streaming: records of the files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.scan import whole_files

_FILES = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None, keep_linebreaks: bool = False) -> DataFrame:
    """file, rec_idx, name, sequence, qualities; the format of each file by its name or content."""
    source = spark.readStream.format("binaryFile").schema(_FILES)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    return whole_files(source.load(folder), {}, keep_linebreaks, detect=True)


def counts_by_file(records: DataFrame) -> DataFrame:
    """Running counts of records and bases of each file of a stream."""
    return records.groupBy("file").agg(F.count("*").alias("n_records"), F.sum(F.length("sequence")).alias("total_bp"))
