"""Files in any store that Spark can reach, by Hadoop's FileSystem."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """FileSystem and Path of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """At most n bytes from the start of a file."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()
