"""Recorded observations: one JSON object a line, an item with its children, or a release. A batch or a stream reads them alike.

A section that is null was never carried, an empty one was carried and is empty; `children_complete` says which sections
are whole. Reading is schema-on-read: fields a source lacks are null, and what it adds is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USER = "user struct<login:string,type:string>"
ITEM = f"item struct<id:long,number:long,title:string,body:string,state:string,created_at:string,updated_at:string,closed_at:string,{USER.replace(' ', ':', 1)},labels:array<struct<name:string>>,pull_request:struct<url:string>>"
COMMENT = f"struct<id:long,body:string,created_at:string,updated_at:string,author_association:string,{USER.replace(' ', ':', 1)}>"
SECTIONS = {
    "issue_comments": COMMENT,
    "review_comments": COMMENT,
    "reviews": f"struct<id:long,state:string,body:string,submitted_at:string,{USER.replace(' ', ':', 1)}>",
    "files": "struct<filename:string,status:string,additions:long,deletions:long,sha:string>",
    "timeline": "struct<type:string,created_at:string,commit_id:string,source_number:long,source_repo:string>",
    "pr_commits": "struct<sha:string,message:string>",
}
PAYLOAD = "number long, " + ITEM + ", pull struct<merged_at:string,merge_commit_sha:string,head:struct<ref:string>,draft:boolean>, " + ", ".join(f"{n} array<{t}>" for n, t in SECTIONS.items()) + ", children_complete map<string,boolean>, gone boolean"
SCHEMA = "resource string, payload struct<" + PAYLOAD.replace("number long", "number:long", 1).replace(", item struct", ",item:struct").replace(", pull struct", ",pull:struct").replace(" array<", ":array<").replace(" map<", ":map<").replace(" boolean", ":boolean") + ">"
#: Fixed value: events of a timeline that are kept, the newest.
TIMELINE = 500


def read(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """The log as rows (resource, payload, seq): seq is the line's place in the order of files and lines."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if stream else spark.read
    rows = reader.schema(SCHEMA).option("mode", "PERMISSIVE").json(path)
    return rows if stream else rows.withColumn("seq", F.monotonically_increasing_id())


def replay(rows: DataFrame) -> DataFrame:
    """Item observations in the order (updated, number, append), without those equal to the item's observation before."""
    items = rows.where("resource = 'item_bundle' and payload.number is not null")
    whole = F.sha2(F.to_json("payload"), 256)
    before = F.lag("digest").over(Window.partitionBy("payload.number").orderBy("seq"))
    kept = items.withColumn("digest", whole).withColumn("before", before).where("before is null or before <> digest")
    return kept.drop("before", "digest").orderBy(F.col("payload.item.updated_at").asc_nulls_first(), "payload.number", "seq")


def fetch(rows: DataFrame, numbers: list[int]) -> DataFrame:
    """The last observation of each of these numbers."""
    wanted = rows.where((F.col("resource") == "item_bundle") & F.col("payload.number").isin(numbers))
    return wanted.groupBy(F.col("payload.number").alias("number")).agg(F.max_by("payload", "seq").alias("payload"))


def children(latest: DataFrame, section: str) -> DataFrame:
    """(number, child's fields) of a carried section of latest(number, payload)."""
    rows = latest.select("number", F.explode(f"payload.{section}").alias("c")).select("number", "c.*")
    if section == "timeline":
        newest = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("created_at")))
        rows = rows.withColumn("_n", newest).where(F.col("_n") <= TIMELINE).drop("_n")
    return rows


def complete(latest: DataFrame, section: str) -> DataFrame:
    """(number, carried, whole): whether a section was carried, and may replace what is stored."""
    carried = F.col(f"payload.{section}").isNotNull()
    whole = carried & F.coalesce(F.col("payload.children_complete")[section], F.lit(False))
    return latest.select("number", carried.alias("carried"), whole.alias("whole"))


def listed(rows: DataFrame, since: str, per_page: int = 100) -> DataFrame:
    """What a listing since an instant (inclusive) gives: latest observations by update, with the page they are on."""
    latest = rows.where("resource = 'item_bundle'").groupBy(F.col("payload.number").alias("number")).agg(F.max_by("payload", "seq").alias("payload"))
    due = latest.where(F.col("payload.item.updated_at") >= since).orderBy("payload.item.updated_at", "number")
    place = F.row_number().over(Window.orderBy("payload.item.updated_at", "number")) - 1
    return due.select("number", F.col("payload.item.updated_at").alias("updated_at"), (place / per_page).cast("int").alias("page"))


def stores(spark: SparkSession, folders: list[str], table: str = "items", updated: str = "updated") -> DataFrame:
    """(folder, rows, watermark) of stores, the freshest first: which of them to adopt."""
    found = [spark.read.parquet(f"{f}/{table}").agg(F.count("*").alias("rows"), F.max(updated).cast("string").alias("watermark")).withColumn("folder", F.lit(f)) for f in folders]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.select("folder", "rows", "watermark").orderBy(F.desc_nulls_last("watermark"), F.desc("rows"), "folder")


def in_vocabulary(paths: DataFrame, tracked: DataFrame) -> DataFrame:
    """paths(path) that the checked-out tree holds; tracked(path)."""
    return paths.join(tracked.select("path").distinct(), "path", "left_semi")
