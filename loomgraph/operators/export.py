"""Exports: canonical lines and hashes, graphs, snapshots with a manifest, one corpus adopted into another, folded names."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import remove

#: Rows of an item range whose lines are hashed together.
RANGE = 10_000


def canonical(row: Column) -> Column:
    """A struct as JSON with sorted keys, no spaces, ASCII only: equal rows give equal bytes."""

    @F.pandas_udf("string")
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True, ensure_ascii=True, separators=(",", ":")))

    return lines(F.to_json(row, {"ignoreNullFields": "false"}))


def lines(items: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """(repo, number, line, hash): an item with its sorted children, one canonical line each."""
    rows = items
    for name, child in children.items():
        own = [c for c in child.columns if c != "number"]
        rows = rows.join(child.groupBy("number").agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name)), "number", "left").withColumn(name, F.coalesce(name, F.array()))
    out = rows.select("repo", "number", canonical(F.struct(*sorted(rows.columns))).alias("line"))
    return out.withColumn("hash", F.sha2("line", 256))


def corpus_hash(lines_: DataFrame) -> DataFrame:
    """(repo, items, hash) of a corpus: hashes of lines in order, RANGE numbers at a time, then those in order. No task sees all lines."""
    part = lines_.groupBy("repo", F.expr(f"number div {RANGE}").alias("range")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "hash"))), lambda x: x["hash"]), ""), 256).alias("h"))
    return part.groupBy("repo").agg(F.sum("n").alias("items"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "h"))), lambda x: x["h"]), ""), 256).alias("hash"))


def graph(items: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(repo, type, id, stored), edges): stored items, and ends of edges that are none; a node is a type and an id."""
    stored = items.select("repo", F.lit("item").alias("type"), F.col("number").cast("string").alias("id"), F.lit(True).alias("stored"))
    ends = edges.select("repo", F.col("src_type").alias("type"), F.col("src").alias("id")).unionByName(edges.select("repo", F.col("dst_type").alias("type"), F.col("dst").alias("id"))).distinct()
    return stored.unionByName(ends.join(stored, ["repo", "type", "id"], "left_anti").withColumn("stored", F.lit(False))), edges


def digest(df: DataFrame) -> dict:
    """Rows and an order-free digest of a table."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"))).first()
    return {"rows": n, "digest": str(total or 0)}


class Snapshots:
    """Versions of a corpus in a folder: tables, then a manifest, then the name that readers follow. Readers see whole versions only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _text(self, name: str) -> str | None:
        try:
            return "".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.folder}/{name}").collect())
        except Exception as e:  # Spark has no other word for a path that isn't there
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _write(self, name: str, text: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}")

    def publish(self, tables: dict[str, DataFrame]) -> str:
        version = f"v-{uuid.uuid4().hex}"
        manifest = {}
        for name, df in tables.items():
            path = f"{self.folder}/{version}/{name}"
            df.write.option("compression", "gzip").option("maxRecordsPerFile", 1_000_000).parquet(path)
            manifest[name] = digest(self.spark.read.parquet(path))
        self._write(f"{version}/manifest", json.dumps(manifest, sort_keys=True))
        self.verify(version)
        self._write("current", version)
        return version

    def verify(self, version: str) -> dict:
        manifest = json.loads(self._text(f"{version}/manifest") or "null")
        if manifest is None:
            raise ValueError(f"{version} has no manifest")
        for name, said in manifest.items():
            found = digest(self.spark.read.parquet(f"{self.folder}/{version}/{name}"))
            if found != said:
                raise ValueError(f"{version}/{name} is damaged: {found} instead of {said}")
        return manifest

    def pull(self, check: bool = True) -> dict[str, DataFrame]:
        version = self._text("current")
        if version is None:
            raise ValueError("nothing was published")
        manifest = self.verify(version) if check else json.loads(self._text(f"{version}/manifest"))
        return {name: self.spark.read.parquet(f"{self.folder}/{version}/{name}") for name in manifest}

    def drop(self, version: str) -> None:
        if version == self._text("current"):
            raise ValueError("the current version can't be dropped")
        remove(self.spark, f"{self.folder}/{version}")


def adopt(store: dict[str, DataFrame], candidate: dict[str, DataFrame], repo: str) -> dict[str, DataFrame]:
    """store with the candidate's rows of a repository in place of its own; tables that the candidate never had are kept.

    Revisions are adopted item by item: an item's stored ones stay unless the candidate has any for it.
    """
    own = repo.lower()
    out = {}
    for name, rows in store.items():
        if name not in candidate:
            out[name] = rows
            continue
        fresh = candidate[name].where(F.lower("repo") == own)
        if name == "revisions":
            same = fresh.select("number").distinct()
            kept = rows.where(F.lower("repo") != own).unionByName(rows.where(F.lower("repo") == own).join(same, "number", "left_anti"))
        else:
            kept = rows.where(F.lower("repo") != own)
        out[name] = kept.unionByName(fresh, allowMissingColumns=True)
    return out


def folded(rows: DataFrame, name: str, keys: list[str], fresh: str) -> DataFrame:
    """Rows whose names differ in case only become one, the freshest, under the folded name."""
    low = rows.withColumn(name, F.lower(name))
    rank = F.row_number().over(Window.partitionBy(name, *keys).orderBy(F.desc_nulls_last(fresh), *[F.desc(c) for c in sorted(low.columns) if c not in (name, *keys, fresh)]))
    return low.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def duplicates(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Keys that more than one spelling of a name holds."""
    return rows.groupBy(F.lower(name).alias(name), *keys).agg(F.count("*").alias("rows"), F.countDistinct(name).alias("spellings")).where("spellings > 1")


def recounted(tables: dict[str, DataFrame]) -> DataFrame:
    """(repo, source, rows) of every table."""
    counts = [df.groupBy("repo").agg(F.count("*").alias("rows")).withColumn("name", F.lit(n)) for n, df in sorted(tables.items())]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out.select("repo", F.col("name").alias("source"), "rows")


def formatted(rows: DataFrame, form: str = "json", fields: list[str] | None = None, limit: int = 1000) -> str:
    """At most `limit` rows as json, compact, jsonl or text, with only these fields if named."""
    if fields:
        unknown = [f for f in fields if f not in rows.columns]
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        rows = rows.select(*fields)
    found = [json.loads(x) for x in rows.limit(limit).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
    if form == "json":
        return json.dumps(found, indent=2, ensure_ascii=False)
    if form == "compact":
        return json.dumps(found, separators=(",", ":"), ensure_ascii=False)
    if form == "jsonl":
        return "\n".join(json.dumps(r, separators=(",", ":"), ensure_ascii=False) for r in found)
    if form == "text":
        return "\n".join("  ".join(f"{k}={v}" for k, v in r.items()) for r in found)
    raise ValueError(f"unknown form {form}")
