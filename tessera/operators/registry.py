"""Versioned documents: what to do with incoming files, and snapshots with soft deletes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.operators.sinks import read_file, write_file
from tessera.operators.store import Store


def decide(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """tenant_id, doc_key, action, version for incoming (tenant_id, doc_key, content_hash, force) against registry (tenant_id, doc_key, version, status, content_hash, is_deleted)."""
    r = registry.select("tenant_id", "doc_key", F.col("version").alias("_v"), "status", F.col("content_hash").alias("_hash"), "is_deleted")
    same = F.col("content_hash") == F.col("_hash")
    action = (
        F.when(F.col("_v").isNull(), "create")
        .when(F.col("force") & (F.col("status") == "processing"), "conflict")
        .when(F.col("force"), "new_version")
        .when(~same, "new_version")
        .when(F.col("is_deleted"), "new_version")
        .when(F.col("status") == "done", "skip")
        .when(F.col("status") == "processing", "conflict")
        .otherwise("retry")
    )
    out = incoming.join(r, ["tenant_id", "doc_key"], "left").withColumn("action", action)
    version = F.when(F.col("action") == "create", 1).when(F.col("action") == "new_version", F.col("_v") + 1).otherwise(F.col("_v"))
    return out.select("tenant_id", "doc_key", "action", version.alias("version"))


def list_page(registry: DataFrame, tenant: str, limit: int = 50, offset: int = 0, deleted: bool = False) -> DataFrame:
    """A tenant's documents, last updated first; limit is held to 1..200."""
    rows = registry.filter(F.col("tenant_id") == tenant)
    rows = rows if deleted else rows.filter(~F.col("is_deleted"))
    return rows.orderBy(F.desc("updated_at"), "doc_key").offset(max(0, offset)).limit(min(200, max(1, limit)))


def soft_delete(chunks: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """chunks with is_valid false and update_time now where (doc, version) is in gone."""
    mark = gone.select("doc", "version").distinct().withColumn("_gone", F.lit(True))
    hit = F.coalesce("_gone", F.lit(False))
    out = chunks.join(mark, ["doc", "version"], "left")
    return out.withColumns({"is_valid": F.col("is_valid") & ~hit, "update_time": F.when(hit, now).otherwise(F.col("update_time"))}).select(chunks.columns)


def patch(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """chunks with effective_time, category, department and permission replaced by the non-null ones of changes (doc, version, ...)."""
    fields = [c for c in ("effective_time", "category", "department", "permission") if c in changes.columns]
    new = changes.select("doc", "version", *[F.col(c).alias(f"_{c}") for c in fields])
    out = chunks.join(new, ["doc", "version"], "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(chunks.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, the new one where both have it; new columns are null in old rows."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc("_turn")))).filter("_n = 1").drop("_n", "_turn")


def new_only(old: DataFrame, new: DataFrame, key: str = "chunk") -> DataFrame:
    """Rows of new whose key old doesn't hold, valid or not; they alone are embedded."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def latest(registry: DataFrame) -> DataFrame:
    """Each document's row (doc, version, ...) of the highest version."""
    rest = [c for c in registry.columns if c != "doc"]
    return registry.groupBy("doc").agg(F.max_by(F.struct(*rest), "version").alias("_r")).select("doc", *[F.col(f"_r.{c}").alias(c) for c in rest])


def swap_version(chunks: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """chunks and new ones (doc, version, ...) in one table: a new version's predecessor is no longer valid, and its validity time passes on."""
    times = chunks.groupBy("doc").agg(F.max_by("effective_time", F.struct("version", "effective_time")).alias("_time"))
    coming = new.join(times, "doc", "left").withColumn("effective_time", F.coalesce("_time", "effective_time")).select(chunks.columns)
    gone = new.select("doc", (F.col("version") - 1).alias("version"))
    return soft_delete(chunks, gone, now).unionByName(coming)


class SnapshotTable:
    """A table of immutable snapshots. What names the current one is a pointer file, for a single writer, or a store's manifest, which several tables share."""

    def __init__(self, spark: SparkSession, folder: str, store: Store | None = None) -> None:
        self.spark, self.folder, self.store = spark, folder.rstrip("/"), store
        self.name = self.folder.rsplit("/", 1)[-1]
        if store is not None:
            store.table(self.name, lambda snapshot: [f"{self.folder}/{snapshot}"])

    def snapshot(self) -> str | None:
        """The name of the current snapshot."""
        if self.store is not None:
            return self.store.get(self.name)
        raw = read_file(self.spark, f"{self.folder}/CURRENT")
        return raw.decode() if raw else None

    def current(self) -> DataFrame | None:
        name = self.snapshot()
        return None if name is None else self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, partition_by: list[str] | None) -> str:
        name = f"snapshot-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.folder}/{name}")
        return name

    def put(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a snapshot that nothing names."""
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self._write(df, partition_by)}")

    def commit(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a snapshot, then name it: in the store's manifest, or by renaming a whole new pointer over the old one. Readers see the old snapshot until then, and never half a pointer."""
        name = self._write(df, partition_by)
        if self.store is not None:
            self.store.set(self.name, name)
        else:
            write_file(self.spark, f"{self.folder}/CURRENT", name.encode())
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def merge(self, new: DataFrame, keys: list[str]) -> DataFrame:
        old = self.current()
        return self.commit(new if old is None else upsert(old, new, keys))

    def compact(self) -> DataFrame | None:
        """Drop rows that aren't valid."""
        old = self.current()
        return None if old is None else self.commit(old.filter("is_valid"))
