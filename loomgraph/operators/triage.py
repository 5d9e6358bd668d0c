"""Triage of open issues: thirteen features, gates, two stages of scores, stable pages.

Everything is one wide pipeline of left joins over open issues; each feature is aggregated by number before it is joined, so a much
discussed issue is one row. Scores are means over the features that are present: null means that nothing is known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .items import kept

#: Features by group, the count at which each is full, days to a milestone that count, decay of hotspots in days.
GROUPS = {"demand": ("reactions", "participants", "comments", "duplicates", "mentions"), "leverage": ("blocking", "gap", "due"), "risk": ("reopens", "file_reverts"), "priority": ("type_weight", "label_weight", "field_weight")}
FULL = {"reactions": 3.0, "participants": 3.0, "comments": 5.0, "mentions": 10.0, "blocking": 3.0, "gap": 3.0, "reopens": 1.0, "file_reverts": 1.0}
SOON_DAYS, DECAY_DAYS = 14, 45.0
#: Weights of priority labels where none are configured; names match whatever their case.
LABELS = {"critical": 1.0, "p0": 1.0, "high": 0.75, "p1": 0.75, "bug": 0.75, "medium": 0.5, "p2": 0.5, "p3": 0.25, "low": 0.1}
DEFAULTS = {"demand": 1.0, "leverage": 1.0, "risk": 1.0, "priority": 1.0, "stage2": 0.25, "top_k": 50}


def _counted(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("number")).agg(value.alias(name))


def item_edges(edges: DataFrame, rels: tuple[str, ...]) -> DataFrame:
    """(a, b, rel) of edges between items of one repository, as numbers."""
    number = lambda c: F.when(F.col(c).rlike("^[0-9]{1,18}$"), F.col(c).cast("long"))
    rows = edges.where((F.col("src_type") == "item") & (F.col("dst_type") == "item") & F.col("rel").isin(*rels))
    return rows.select(number("src").alias("a"), number("dst").alias("b"), "rel").where("a is not null and b is not null").distinct()


def gates(issues: DataFrame, items: DataFrame, edges: DataFrame, claimed: DataFrame, assigned: DataFrame, tasks: DataFrame, tracking: tuple[str, ...] = (), labels: DataFrame | None = None) -> DataFrame:
    """(number, gates) of every issue: what keeps it from being taken up, in a fixed order.

    tasks(number, child): boxes of a task list. An issue is blocked by an open blocker; linked to an open pull request that the forge
    names, or that says it closes the issue; a tracker whose parts are all done is left to be closed.
    """
    state = items.select(F.col("number").alias("other"), F.col("state").alias("other_state"), F.col("kind").alias("other_kind"), F.col("merged").isNull().alias("unmerged"))
    flag = lambda rows, name: rows.select("number").distinct().withColumn(name, F.lit(True))
    ends = lambda rel, mine, far: item_edges(edges, (rel,)).select(F.col(mine).alias("number"), F.col(far).alias("other")).join(state, "other")
    blocked = ends("blocked_by", "a", "b").where("other_state = 'open'")
    open_pull = "other_state = 'open' and other_kind = 'pr' and unmerged"
    linked, said = ends("linked_pr", "a", "b").where(open_pull), ends("closes_keyword", "b", "a").where(open_pull)
    all_closed = lambda rows, also="true": rows.groupBy("number").agg(F.bool_and(F.expr(f"coalesce(other_state = 'closed' and {also}, false)")).alias("done")).where("done")
    children = item_edges(edges, ("child_of",)).select(F.col("b").alias("number"), F.col("a").alias("other")).join(state, "other", "left")
    boxes = tasks.select("number", F.col("child").alias("other")).distinct().join(state, "other", "left")
    done = flag(all_closed(children), "x").unionByName(flag(all_closed(boxes, "other_kind = 'issue'"), "x")).unionByName(flag(items.where("subs > 0 and subs_done = subs"), "x"))
    if labels is not None and tracking:
        done = done.unionByName(flag(labels.where(F.col("name").isin(*tracking)), "x"))
    named = {"claimed": flag(claimed, "claimed"), "blocked": flag(blocked, "blocked"), "assigned": flag(assigned, "assigned"), "linked": flag(linked, "linked"), "said": flag(said, "said"), "tracking": flag(done, "tracking")}
    rows = reduce(lambda df, n: df.join(named[n], "number", "left"), named, issues.select("number", "locked"))
    linked_by = F.when(F.col("linked"), "linked_pr").when(F.col("said"), "linked_pr (append-only evidence; may be stale)")
    found = [F.when(F.col("claimed"), "claimed"), F.when(F.col("blocked"), "blocked"), F.when(F.col("assigned"), "assigned"), linked_by, F.when(F.col("locked"), "locked"), F.when(F.col("tracking"), "tracking")]
    return rows.select("number", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("gates"))


def features(issues: DataFrame, items: DataFrame, edges: DataFrame, comments: DataFrame, events: DataFrame, labels: DataFrame, actors: DataFrame, paths: DataFrame, files: DataFrame, gated: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """issues with the raw features; null where nothing is known. paths(number, path): files that an issue names."""
    people = actors.where("bot").select(F.col("login").alias("author"))
    wrote = comments.select("number", "author").unionByName(items.select("number", "author")).where("author is not null").join(people, "author", "left_anti")
    sources = items.select(F.col("number").alias("a"), F.col("state").alias("a_state"), "author").join(people, "author", "left_anti")
    own_child = item_edges(edges, ("child_of",)).select("a", "b")
    mentions = item_edges(edges, ("mentions",)).join(sources.where("a_state = 'open'"), "a").join(own_child, ["a", "b"], "left_anti")
    free = gated.where("size(gates) = 0").select(F.col("number").alias("a")).join(items.where("kind = 'issue' and state = 'open'").select(F.col("number").alias("a")), "a")
    blocking = item_edges(edges, ("blocked_by",)).join(free, "a")
    reverted = item_edges(edges, ("reverts",)).select(F.col("b").alias("pull")).distinct()
    bad = files.where(kept(F.col("status"))).select(F.col("number").alias("pull"), "path").join(reverted, "pull").select("pull", "path")
    map_ = weights or LABELS
    weight = F.create_map(*[F.lit(x) for kv in map_.items() for x in kv])[F.lower("name") if weights is None else F.col("name")]
    parts = {
        "participants": _counted(wrote, "number", F.countDistinct("author"), "participants"),
        "comments": _counted(comments, "number", F.count("*"), "comments"),
        "duplicates": _counted(item_edges(edges, ("duplicate_of", "duplicate_keyword")), "b", F.countDistinct("a"), "duplicates"),
        "mentions": _counted(mentions, "b", F.countDistinct("a"), "mentions"),
        "blocking": _counted(blocking, "b", F.countDistinct("a"), "blocking"),
        "reopens": _counted(events.where("type = 'reopened'"), "number", F.count("*"), "reopens"),
        "file_reverts": _counted(paths.join(bad, "path"), "number", F.countDistinct("pull"), "file_reverts"),
        "label_weight": _counted(labels.withColumn("w", weight).where("w is not null"), "number", F.max("w"), "label_weight"),
    }
    rows = reduce(lambda df, n: df.join(parts[n], "number", "left"), parts, issues.select("number", "reactions", "due", (F.when(F.col("subs") > 0, F.col("subs") - F.col("subs_done"))).alias("gap")))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("participants", "comments", "duplicates", "mentions", "blocking", "reopens", "file_reverts")}
    return rows.withColumns(zero).withColumns({"type_weight": F.lit(None).cast("double"), "field_weight": F.lit(None).cast("double")})


def normal(name: str, now: int) -> Column:
    """A feature in [0, 1]."""
    known = F.col(name).isNotNull()  # least and greatest pass over nulls
    if name in FULL:
        return F.when(known, F.least(F.lit(1.0), F.col(name) / FULL[name]))
    if name == "duplicates":
        return F.when(F.col(name) >= 1, 1.0).when(known, 0.0)
    if name == "due":
        return F.when(F.col(name) <= now + SOON_DAYS * 86_400, 1.0).when(known, 0.0)
    return F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(name))))


def stage1(rows: DataFrame, now: int, config: dict[str, float] = DEFAULTS) -> DataFrame:
    """rows with a score for each group, the weighted mean of its present features (0 without any), and their sum."""
    for group, names in GROUPS.items():
        present = F.filter(F.array(*[normal(n, now) for n in names]), lambda x: x.isNotNull())
        mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(present), F.lit(0))
        rows = rows.withColumn(group, F.lit(float(config[group])) * F.coalesce(mean, F.lit(0.0)))
    return rows.withColumn("stage1", sum((F.col(g) for g in GROUPS), F.lit(0.0)))


def heat(merged_files: DataFrame, now: int, hubs: DataFrame | None = None, hub_floor: float = 0.25) -> DataFrame:
    """(path, heat): merges of a file, exponentially aged; hub files count less."""
    rows = merged_files.where(F.col("merged") <= now).groupBy("path").agg(F.sum(F.exp(-(F.lit(now) - F.col("merged")) / 86400.0 / DECAY_DAYS)).alias("heat"))
    if hubs is None:
        return rows
    return rows.join(hubs.select("path", F.lit(hub_floor).alias("w")), "path", "left").select("path", (F.col("heat") * F.coalesce("w", F.lit(1.0))).alias("heat"))


def stage2(scored: DataFrame, paths: DataFrame, hot: DataFrame, reverted_files: DataFrame, config: dict[str, float] = DEFAULTS) -> DataFrame:
    """scored(number, gates, stage1) with total: the top_k ungated rows get a bonus for hot files and for files of reverted changes.

    Heat is normalised over all ungated rows, before the cut.
    """
    free = scored.where("size(gates) = 0").select("number", "stage1")
    top = free.orderBy(F.desc("stage1"), "number").limit(int(config["top_k"])).select("number").withColumn("top", F.lit(True))
    warm = paths.join(hot, "path").groupBy("number").agg(F.sum("heat").alias("heat")).join(free.select("number"), "number", "left_semi")
    most = warm.agg(F.max("heat").alias("most"))  # one row
    again = paths.join(reverted_files.select("path").distinct(), "path", "left_semi").select("number").distinct().withColumn("again", F.lit(1.0))
    rows = scored.join(F.broadcast(top), "number", "left").join(warm, "number", "left").crossJoin(F.broadcast(most)).join(again, "number", "left")
    share = F.coalesce(F.col("heat") / F.nullif("most", F.lit(0.0)), F.lit(0.0))
    bonus = F.when(F.col("top"), F.lit(float(config["stage2"])) * (share + F.coalesce("again", F.lit(0.0))) / 2).otherwise(F.lit(0.0))
    return rows.withColumn("bonus", bonus).withColumn("total", F.col("stage1") + F.col("bonus")).drop("top", "heat", "most", "again")


def page(scored: DataFrame, limit: int, cursor: str | None = None, include_gated: bool = False) -> tuple[DataFrame, bool]:
    """The next rows by total (9 digits), then number; gated ones last. cursor is `total:number` of the last row seen; one that isn't restarts."""
    rows = scored.withColumn("gated", F.size("gates") > 0).withColumn("total", F.round("total", 9))
    rows = rows if include_gated else rows.where(~F.col("gated"))
    restarted = False
    if cursor:
        total, _, number = cursor.partition(":")
        try:
            after = float(total), int(number)
        except ValueError:
            restarted = True
        else:
            if after[0] != after[0] or abs(after[0]) == float("inf"):
                restarted = True
            else:
                rows = rows.where((F.col("total") < after[0]) | ((F.col("total") == after[0]) & (F.col("number") > after[1])))
    return rows.orderBy("gated", F.desc("total"), "number").limit(limit), restarted


def with_rank(scored: DataFrame) -> DataFrame:
    """The rank of every ungated row among all of them: a single row's packet filters after it, never before."""
    free = scored.where("size(gates) = 0")
    return free.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("total", 9)), "number")))
