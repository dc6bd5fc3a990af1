"""Tables written to the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one is set only where none is, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_one = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_one.isDefined():
        return set_one.get().rstrip("/")
    own = "file://" + tempfile.mkdtemp(prefix="seqloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seqloom/{name}-{uuid.uuid4().hex}"


#: While a table is written: Spark deletes an execution's shuffle files when it ends, not when the driver
#: collects its garbage; and batches for Python hold fewer rows, as rows of packed arrays can be large.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def _write(spark: SparkSession, write: Callable[[], None]) -> None:
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        write()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage and frees its shuffles."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    _write(spark, lambda: df.write.parquet(path, compression="zstd"))
    out = spark.read.schema(df.schema).parquet(path)
    out._seqloom_path = path
    return out


def bucketed(df: DataFrame, name: str, column: str, onto: DataFrame | None = None) -> DataFrame:
    """As materialise(), with rows in one file for each hash of a column; work by that column then needs no shuffle.

    onto: a table of this function (with the same columns) to add to, which is returned with the new rows."""
    spark = df.sparkSession
    path = onto._seqloom_path if onto else new_path(spark, name)
    table, n = "seqloom_" + path.rsplit("-", 1)[1], onto._seqloom_buckets if onto else int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, column).write.bucketBy(n, column).option("path", path).option("compression", "zstd").format("parquet")
    _write(spark, lambda: writer.mode("append").saveAsTable(table))
    out = spark.table(table)
    out._seqloom_path, out._seqloom_table, out._seqloom_buckets = path, table, n
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete tables of materialise() and bucketed() that nothing reads any more."""
    for df in frames:
        if table := getattr(df, "_seqloom_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        path = getattr(df, "_seqloom_path", None)
        if path:
            delete(df.sparkSession, path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path for ``path``: works for any store that Spark can read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)
