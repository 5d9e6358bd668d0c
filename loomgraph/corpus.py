"""The relational corpus: named tables of items, files, comments, events and actors, bound to source tables once.

A Corpus maps table names to DataFrames; nothing mutates, as_of() gives another corpus. Timestamps stay UTC.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Issue and comment numbers start here, so that they don't meet pull-request numbers.
ISSUES_FROM = 1_000_000_000


@dataclass(frozen=True)
class Corpus:
    items: DataFrame
    pr_files: DataFrame
    comments: DataFrame
    item_events: DataFrame
    actors: DataFrame

    def as_of(self, instant: str) -> Corpus:
        """What was visible at an instant: later rows go, items merged later are open again, files need a merge."""
        t = F.lit(instant).cast("timestamp")
        merged = F.when(F.col("merged_at") <= t, F.col("merged_at"))
        state = F.when((F.col("state") == "closed") & F.col("merged_at").isNotNull() & (F.col("merged_at") > t), "open").otherwise(F.col("state"))
        items = self.items.where(F.col("created_at") <= t).withColumn("state", state).withColumn("merged_at", merged)
        files = self.pr_files.join(items.where("merged_at is not null").select("number"), "number", "left_semi")
        # comments carry no instant here: those of items that weren't there yet go, and so do all whose item can't be dated
        comments = self.comments.join(items.select("number"), "number", "left_semi")
        return replace(self, items=items, pr_files=files, comments=comments, item_events=self.item_events.where(F.col("created_at") <= t))


def load(spark: SparkSession, sf_dir: str) -> Corpus:
    """Bind the tables of a folder; only the columns that a query uses are read."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders").select(
        F.col("o_orderkey").alias("number"),
        F.lit("pr").alias("kind"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("merged_at"),
        F.col("o_orderpriority").alias("label"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"),
    )
    issues = read("documents").select(
        (F.col("doc_id") + ISSUES_FROM).alias("number"),
        F.lit("issue").alias("kind"),
        F.lit("open").alias("state"),
        F.concat(F.lit("s"), F.col("source")).alias("author"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("merged_at"),
        F.col("lang").alias("label"),
        F.coalesce(F.substring_index("text", "\n", 1), F.lit("")).alias("title"),
    )
    first = F.min(F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_returnflag"))  # of lines of one part the first
    files = read("lineitem").groupBy(F.col("l_orderkey").alias("number"), F.concat(F.lit("part/"), F.col("l_partkey")).alias("path")).agg(first.alias("f"))
    files = files.select("number", "path", F.col("f.l_quantity").cast("long").alias("additions"), F.when(F.col("f.l_returnflag") == "R", "removed").otherwise("modified").alias("status"))
    role = F.col("role")
    comments = read("conversations").select(
        (F.col("conv_id") + ISSUES_FROM).alias("number"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"),
        F.when(role == "assistant", "MEMBER").when(role == "system", "OWNER").otherwise("NONE").alias("association"),
        F.concat(role, F.col("conv_id") % 7).alias("author"),
        F.col("text").alias("body"),
    )
    events = read("events").select(F.col("event_id"), F.col("user_id").alias("number"), F.when(F.col("event_type") == "error", "reopened").otherwise(F.col("event_type")).alias("type"), F.col("ts").cast("timestamp").alias("created_at"), "props")
    actors = read("customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("login"), (F.col("c_custkey") % 97 == 0).cast("int").alias("is_bot"))
    return Corpus(orders.unionByName(issues), files, comments, events, actors)


def merged_pr_files(corpus: Corpus) -> DataFrame:
    """(number, path, additions, merged_at) of files that merged pull requests did not remove; an unknown status counts as kept."""
    merged = corpus.items.where("kind = 'pr' and merged_at is not null").select("number", "merged_at")
    return corpus.pr_files.where("not (status <=> 'removed')").join(merged, "number")
