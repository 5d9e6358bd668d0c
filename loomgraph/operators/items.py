"""Items with their children, their texts over time, and what was visible at an instant (seconds since 1970)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of items, the largest limit.
KINDS, MOST = ("issue", "pr"), (1 << 31) - 2


def scoped(rows: DataFrame, repo: str = "") -> DataFrame:
    """Rows of a repository, whatever the case of its name; of all for an empty name."""
    return rows.where(F.col("repo") == repo.lower()) if repo else rows


def clamped(limit: int) -> int:
    """A limit that can be used: at least 1, at most MOST; refused beyond 64 bits."""
    if limit > (1 << 63) - 1:
        raise ValueError("limit is out of range")
    return min(max(1, limit), MOST)


def kept(status: Column) -> Column:
    """A file that a pull request leaves in place; an unknown status counts as kept."""
    return ~status.eqNullSafe(F.lit("removed"))


def normal_path(path: Column) -> Column:
    """One spelling of a path: slashes, no `./` in front."""
    return F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def merged_files(files: DataFrame, items: DataFrame) -> DataFrame:
    """(number, path, additions, deletions, merged) of files that merged pull requests keep."""
    merged = items.where("kind = 'pr' and merged is not null").select("number", "merged")
    return files.where(kept(F.col("status"))).withColumn("path", normal_path(F.col("path"))).join(merged, "number").select("number", "path", "additions", "deletions", "merged")


def churn(files: DataFrame, items: DataFrame) -> DataFrame:
    return merged_files(files, items).groupBy("path").agg(F.count("*").alias("changes"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def coverage(items: DataFrame, files: DataFrame) -> DataFrame:
    """Counts by repository, kind and state: items, bytes of their bodies (UTF-8), those with files."""
    have = files.select("number").distinct().withColumn("has", F.lit(1))
    return items.select("repo", "kind", "state", "number", "body").join(have, "number", "left").groupBy("repo", "kind", "state").agg(F.count("*").alias("items"), F.sum(F.octet_length("body")).alias("body_bytes"), F.count("has").alias("with_files"))


def view(items: DataFrame, labels: DataFrame, comments: DataFrame, files: DataFrame) -> DataFrame:
    """Items with nested, sorted children: labels, comments (comment_id, author, created, body) and files; each child is grouped once."""
    children = {
        "labels": labels.groupBy("number").agg(F.array_sort(F.collect_set("name")).alias("labels")),
        "comments": comments.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("created", "comment_id", "author", "association", "body"))).alias("comments")),
        "files": files.groupBy("number").agg(F.array_sort(F.collect_set("path")).alias("files")),
    }
    out = items
    for name, rows in children.items():
        out = out.join(rows.join(items.select("number"), "number", "left_semi"), "number", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def listing(items: DataFrame, labels: DataFrame, actors: DataFrame, kind: str | None = None, state: str | None = None, label: str | None = None, limit: int = 50, offset: int = 0, bots: bool = False) -> DataFrame:
    """A page of items by exact label, the latest update first, then the largest number."""
    if kind is not None and kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    rows = items.where((F.lit(kind is None) | (F.col("kind") == kind)) & (F.lit(state is None) | (F.col("state") == state)))
    if label is not None:
        rows = rows.join(labels.where(F.col("name") == label).select("number"), "number", "left_semi")
    if not bots:
        rows = rows.join(actors.where("bot").select(F.col("login").alias("author")), "author", "left_anti")
    return rows.orderBy(F.desc("updated"), F.desc("number")).offset(max(0, offset)).limit(clamped(limit))


def intervals(events: DataFrame) -> DataFrame:
    """events(number, event_id, type, created) as texts that each were valid until the next: (number, id, content, valid_from, valid_to)."""
    until = F.lead("created").over(Window.partitionBy("number").orderBy("created", "event_id"))
    return events.select("number", F.col("event_id").alias("id"), F.col("type").alias("content"), F.col("created").alias("valid_from"), until.alias("valid_to"))


def text_at(revisions: DataFrame, live: DataFrame, instant: int) -> DataFrame:
    """(number, content, origin) at an instant: of the revisions that were valid the highest id; after the last one the live text; else unknown.

    A revision is a text that was displaced, so the last one of intervals() (without an end) is the live one.
    """
    past = revisions.where("valid_to is not null")
    valid = past.where((F.col("valid_from") <= instant) & (F.col("valid_to") > instant))
    valid = valid.groupBy("number").agg(F.max_by("content", "id").alias("then"))
    since = past.groupBy("number").agg(F.max("valid_to").alias("live_from"))
    out = live.join(valid, "number", "left").join(since, "number", "left")
    now = F.when(F.col("live_from") <= instant, F.col("content"))
    origin = F.when(F.col("then").isNotNull(), "revision").when(now.isNotNull(), "live").otherwise("unknown")
    return out.select("number", F.coalesce("then", now).alias("content"), origin.alias("origin"))


def history(revisions: DataFrame) -> DataFrame:
    """(number, history): each text with the time it was valid, in order."""
    one = F.struct("valid_from", "id", F.concat("content", F.lit("@"), "valid_from", F.lit("-"), F.coalesce(F.col("valid_to").cast("string"), F.lit("now"))).alias("text"))
    rows = revisions.groupBy("number").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return rows.select("number", F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("history"))


def as_of(items: DataFrame, instant: int) -> DataFrame:
    """Items that existed at an instant, as they stood: later merges and closings haven't happened, so those items are open."""
    after = lambda c: F.coalesce(F.col(c) > instant, F.lit(False))
    state = F.when((F.col("state") == "closed") & (after("closed") | after("merged")), "open").otherwise(F.col("state"))
    rows = items.where(F.col("created") <= instant).withColumn("state", state)
    cols = {c: F.when(F.col(c) <= instant, F.col(c)) for c in ("closed", "merged")}
    return rows.withColumn("merge_commit", F.when(F.col("merged") <= instant, F.col("merge_commit"))).withColumns(cols)


def visible(items: DataFrame, comments: DataFrame, instant: int) -> DataFrame:
    """(number, visible): comments of visible items written by then; those without an instant can't be dated and are hidden."""
    seen = comments.where(F.col("created") <= instant).groupBy("number").agg(F.count("*").alias("visible"))
    return items.select("number").join(seen, "number", "left").select("number", F.coalesce("visible", F.lit(0)).alias("visible"))


def ranked_comments(comments: DataFrame, most: int) -> DataFrame:
    """An item's comments for a packet: owners', members', others', the latest first within each."""
    order = F.when(F.col("association") == "OWNER", 0).when(F.col("association") == "MEMBER", 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(order, F.desc("created"), F.desc("comment_id")))
    return comments.withColumn("rank", rank).where(F.col("rank") <= most)
