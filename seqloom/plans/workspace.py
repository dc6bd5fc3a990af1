"""Where queries that write files write them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a temporary one only if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="seqloom-")
    return f"{folder.rstrip('/')}/seqloom/{uuid.uuid4().hex}/{name}"
