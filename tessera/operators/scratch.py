"""Results that several later plans read: written once to the folder that driver and executors share, and reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. A local one stands in only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            base = own.get()
        else:
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written under spark.checkpoint.dir and read back; a lost executor costs no finished part."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
