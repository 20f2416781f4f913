"""Sinks beside tables: JSON vocabulary, JSON report, JSON-line log, uploaded files, event frames. All paths are URIs of the cluster's file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_file(spark: SparkSession, path: str, raw: bytes) -> None:
    """One small file, whole or not at all: written beside its place, then renamed over it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    stream = target.getFileSystem(conf).create(beside, True)
    try:
        stream.write(bytearray(raw))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(beside), context.makeQualified(target), options)


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of a small file, None where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_vocabulary(terms: DataFrame, path: str) -> None:
    """Anchor terms (term) as JSON lines in a folder, each term once; the whole vocabulary never meets the driver."""
    terms.select("term").distinct().write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """term of a written vocabulary; a missing folder or broken lines give no terms."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "term string")
    return spark.read.schema("term string").json(path).filter("term IS NOT NULL").distinct()


def write_report(spark: SparkSession, path: str, summary: DataFrame, rows: DataFrame | None = None) -> None:
    """An evaluation's summary (a few rows) as one JSON document; its rows, however many, as JSON lines in a folder beside it."""
    body = {"summary": [json.loads(r[0]) for r in summary.select(F.to_json(F.struct("*"))).collect()]}
    if rows is not None:
        body["rows"] = f"{path}.rows"
        rows.write.mode("overwrite").json(body["rows"])
    write_file(spark, path, json.dumps(body, ensure_ascii=False, indent=1).encode())


def write_log(lines: DataFrame, path: str) -> None:
    """One JSON text a line (line), appended to a folder."""
    lines.select("line").write.mode("append").text(path)


def write_uploads(files: DataFrame, folder: str) -> DataFrame:
    """Uploaded files (tenant_id, name, content) written by the tasks that hold them, under folder/tenant/id-name; returns tenant_id, name, path. A retried task writes the same names again."""
    from collections.abc import Iterator

    import pandas as pd
    from pyarrow import fs

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            paths = []
            for tenant, name, content, key in frame[["tenant_id", "name", "content", "_key"]].itertuples(index=False):
                store.create_dir(f"{root}/{tenant}", recursive=True)
                paths.append(f"{root}/{tenant}/{key[:12]}-{name.replace('/', '_')}")
                with store.open_output_stream(paths[-1]) as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"tenant_id": frame["tenant_id"], "name": frame["name"], "path": paths})

    keyed = files.withColumn("_key", F.sha2("content", 256))
    return keyed.select("tenant_id", "name", "content", "_key").mapInPandas(run, "tenant_id string, name string, path string")


def write_frames(frames: DataFrame, path: str) -> None:
    """Event frames (query_id, seq, frame), those of a question in one file and in order."""
    frames.repartition("query_id").sortWithinPartitions("query_id", "seq").select("query_id", "frame").write.mode("overwrite").json(path)
