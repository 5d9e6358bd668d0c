"""Incremental ingest: a stream of observations becomes the latest row of each key, in atomic versions.

Keys are dealt into buckets. A micro-batch is merged with the current rows of the buckets it touches, and only these are written, as a new
version; a manifest then says which version holds each bucket. The merge is last-wins on (updated, arrival), then on the row
itself, and idempotent, so a batch that is delivered twice changes nothing. The watermark is the largest `updated` seen; it never
regresses and, other than a streaming watermark, drops nothing.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import remove

BUCKETS = 64


def merge_latest(current: DataFrame | None, batch: DataFrame, key: str, updated: str, seq: str) -> DataFrame:
    rows = batch if current is None else current.unionByName(batch)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(updated), F.desc(seq), F.desc(F.to_json(F.struct(*sorted(rows.columns))))))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


class Store:
    """Versions of one table in a folder; a version counts from when its manifest is complete."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/{n}/_SUCCESS")))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """bucket -> the version that holds it."""
        found = self.versions()
        version = version if version is not None else (found[-1] if found else None)
        if version is None:
            return {}
        return {int(k): v for r in self.spark.read.text(f"{self.folder}/manifests/v{version}").collect() for k, v in json.loads(r[0]).items()}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        held: dict[int, list[int]] = {}
        for bucket, v in self.manifest(version).items():
            if buckets is None or bucket in buckets:
                held.setdefault(v, []).append(bucket)
        parts = [self.spark.read.parquet(f"{self.folder}/data/v{v}").where(F.col("_bucket").isin(b)).drop("_bucket") for v, b in sorted(held.items())]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def upsert(self, batch: DataFrame, batch_id: int, key: str, updated: str, seq: str) -> None:
        """Merge a batch as version batch_id; the same again writes the same again."""
        before = [v for v in self.versions() if v < batch_id]
        known = self.manifest(before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # at most `buckets`
        if touched:
            current = self.read(before[-1], touched) if before else None
            merged = merge_latest(current, batch, key, updated, seq).withColumn("_bucket", bucket)
            merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/v{batch_id}")
        lines = json.dumps(known | dict.fromkeys(touched, batch_id))
        self.spark.createDataFrame([(lines,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifests/v{batch_id}")

    def expire(self, keep: int = 2) -> None:
        """Remove all but the last versions, and the data that none of these needs."""
        found = self.versions()
        held = {v for version in found[-keep:] for v in self.manifest(version).values()}
        for version in found[:-keep]:
            remove(self.spark, f"{self.folder}/manifests/v{version}")
            if version not in held:
                remove(self.spark, f"{self.folder}/data/v{version}")

    def watermark(self, updated: str):
        rows = self.read()
        return None if rows is None else rows.agg(F.max(updated)).first()[0]


def ingest(spark: SparkSession, source: DataFrame, folder: str, key: str, updated: str, seq: str) -> Store:
    """Run a streaming source to its present end into a store; the checkpoint lies beside it."""
    store = Store(spark, f"{folder}/table")
    query = source.writeStream.foreachBatch(lambda batch, i: store.upsert(batch, i, key, updated, seq)).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return store
