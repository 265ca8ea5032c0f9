"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own = ""


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder under the one that spark.checkpoint.dir names; a temporary one only where that is unset, as in tests."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = _own = _own or f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
    return f"{folder}/lodestone-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which ends its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
