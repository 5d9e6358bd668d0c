"""Direct reads: counts, churn, listings, histories, caps, paging, as-of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import Corpus, merged_pr_files


def status_counts(corpus: Corpus) -> DataFrame:
    return corpus.items.groupBy("kind", "state").agg(F.count("*").alias("items"), F.sum(F.octet_length("title")).alias("title_bytes"))


def without_bots(rows: DataFrame, actors: DataFrame) -> DataFrame:
    """Rows whose author is no bot; rows without an author stay."""
    return rows.join(actors.where("is_bot = 1").select(F.col("login").alias("author")), "author", "left_anti")


def churn(corpus: Corpus, merged_only: bool = True) -> DataFrame:
    files = merged_pr_files(corpus) if merged_only else corpus.pr_files
    return files.groupBy("path").agg(F.count("*").alias("changes"), F.sum("additions").alias("additions"))


def open_items(corpus: Corpus, kind: str, label: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of open items with a label, newest first, then by number."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    rows = without_bots(corpus.items.where((F.col("state") == "open") & (F.col("kind") == kind) & (F.col("label") == label)), corpus.actors)
    page = rows.select("number", "author", "created_at").orderBy(F.desc_nulls_last("created_at"), F.desc("number"))
    return page.offset(offset).limit(limit)


def page_after(rows: DataFrame, value: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """A keyset page of rows by value (descending) and key (ascending), behind the cursor (value, key)."""
    if after:
        rows = rows.where((F.col(value) < after[0]) | ((F.col(value) == after[0]) & (F.col(key) > after[1])))
    return rows.orderBy(F.desc(value), key).limit(limit)


def file_history(corpus: Corpus, path: str) -> DataFrame:
    return corpus.pr_files.where(F.col("path") == path).join(corpus.items.select("number", "state", "author", "created_at"), "number").select("number", "status", "additions", "state", "author", "created_at")


def pr_overlap(corpus: Corpus, number: int) -> DataFrame:
    """Other pull requests that touch files of this one: how many, and which."""
    own = corpus.pr_files.where(F.col("number") == number).select("path")
    others = corpus.pr_files.where(F.col("number") != number).join(own, "path")
    return others.groupBy("number").agg(F.count("*").alias("shared"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


def capped_comments(corpus: Corpus, most: int) -> DataFrame:
    """At most so many comments of an item: the first, the last, owners', then the most recent."""
    own = Window.partitionBy("number")
    rows = corpus.comments.withColumn("first", F.min("comment_id").over(own)).withColumn("last", F.max("comment_id").over(own))
    tier = F.when(F.col("comment_id") == F.col("first"), 0).when(F.col("comment_id") == F.col("last"), 1).when(F.col("association") == "OWNER", 2).otherwise(3)
    rows = rows.withColumn("tier", tier).withColumn("rank", F.row_number().over(own.orderBy("tier", F.desc("comment_id"))))
    return rows.where(F.col("rank") <= most).select("number", "comment_id", "association", "rank")


def participants(corpus: Corpus) -> DataFrame:
    """Distinct authors of an item's comments and of the item itself that are no bots; items of bots alone have none."""
    authors = corpus.comments.select("number", "author").unionByName(corpus.items.where("kind = 'issue'").select("number", "author"))
    people = without_bots(authors, corpus.actors).groupBy("number").agg(F.countDistinct("author").alias("participants"))
    return authors.select("number").distinct().join(people, "number", "left").select("number", F.coalesce("participants", F.lit(0)).cast("long").alias("participants"))


def event_counts(corpus: Corpus) -> DataFrame:
    return corpus.item_events.groupBy("number").agg(F.count_if(F.col("type") == "reopened").alias("reopens"), F.count("*").alias("events"))


def newest_events(corpus: Corpus, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("created_at"), F.desc("event_id")))
    return corpus.item_events.withColumn("rank", rank).where(F.col("rank") <= most).select("number", "event_id", "type", "rank")


def collapsed(corpus: Corpus) -> DataFrame:
    """Events of an item without those that repeat the one before."""
    before = F.lag("type").over(Window.partitionBy("number").orderBy("created_at", "event_id"))
    return corpus.item_events.withColumn("before", before).where("before is null or before <> type").select("number", "event_id", "type")


def revisions(corpus: Corpus) -> DataFrame:
    """Every event type of an item as a text that was valid until the next one."""
    until = F.lead("created_at").over(Window.partitionBy("number").orderBy("created_at", "event_id"))
    return corpus.item_events.select("number", F.col("event_id").alias("id"), F.col("type").alias("content"), F.col("created_at").alias("valid_from"), until.alias("valid_to"))


def text_as_of(revs: DataFrame, instant: str) -> DataFrame:
    """The content valid at the instant, per item; of several the one of the highest id."""
    t = F.lit(instant).cast("timestamp")
    valid = revs.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    return valid.groupBy("number").agg(F.max_by("content", "id").alias("content"), F.max("id").alias("id"))


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last by the order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def merged_evidence(rows: DataFrame, keys: list[str], seq: str, text: str, most: int = 512, reserve: tuple[str, ...] = ()) -> DataFrame:
    """Distinct evidence of a key in order of arrival, joined by `; `, in at most so many characters.

    Above that whole parts go, the newest first; the last part and those that hold a reserved marker stay. Only if these
    alone are too long is the text cut. Keys without evidence get null.
    """
    pieces = rows.select(*keys, F.col(seq).alias("_s"), F.posexplode_outer(F.split(text, "; ")).alias("_p", "_t"))
    pieces = pieces.withColumn("_t", F.regexp_replace("_t", r"(?U)^\s+|\s+$", "")).groupBy(*keys, "_t").agg(F.min(F.struct("_s", "_p")).alias("_at"))
    lists = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.struct("_at", "_t")))).alias("_all"))
    last = F.when(F.size("_all") > 0, F.element_at("_all", -1)["_at"])
    stays = lambda x: reduce(lambda a, r: a | x["_t"].contains(r), reserve, x["_at"] == last)
    size = lambda x: F.char_length(x["_t"]) + 2
    lists = lists.select(*keys, F.filter("_all", stays).alias("_held"), F.filter("_all", lambda x: ~stays(x)).alias("_free"))
    zero = F.struct(F.aggregate("_held", F.lit(0), lambda a, x: a + size(x)).alias("used"), F.lit(0).alias("n"))
    fit = F.aggregate("_free", zero, lambda a, x: F.struct((a["used"] + size(x)).alias("used"), (a["n"] + (a["used"] + size(x) <= most + 2).cast("int")).alias("n")), lambda a: a["n"])
    kept = F.transform(F.array_sort(F.concat("_held", F.slice("_free", F.lit(1), fit))), lambda x: x["_t"])
    return lists.select(*keys, F.when(F.size("_held") > 0, F.substring(F.array_join(kept, "; "), 1, most)).alias("evidence"))
