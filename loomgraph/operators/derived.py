"""The derived tier: co-change, hubs, hotspots, similarity, localisation, triage and the metrics of backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import Corpus, merged_pr_files
from .reads import without_bots

#: Basket sizes that count for co-change, decay of hotspots in days, hub share and the weight of a hub.
BASKET, DECAY_DAYS, HUB_SHARE, HUB_WEIGHT = (2, 50), 45.0, 0.5, 0.25


def baskets(corpus: Corpus) -> DataFrame:
    """(number, path) of merged pull requests with 2 to 50 files."""
    files = merged_pr_files(corpus).select("number", "path")
    sized = files.groupBy("number").agg(F.count("*").alias("n")).where(F.col("n").between(*BASKET)).select("number")
    return files.join(sized, "number")


def coupling(corpus: Corpus) -> DataFrame:
    """Co-change of every ordered pair of files: support, confidence and lift. Basket size bounds the pairs of one key."""
    rows = baskets(corpus)
    total = rows.agg(F.countDistinct("number").alias("total"))
    support = rows.groupBy("path").agg(F.count("*").alias("n"))
    pairs = rows.withColumnRenamed("path", "a").join(rows.withColumnRenamed("path", "b"), "number").where("a < b").groupBy("a", "b").agg(F.count("*").alias("support"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "support"))
    both = both.join(support.select(F.col("path").alias("a"), F.col("n").alias("n_a")), "a").join(support.select(F.col("path").alias("b"), F.col("n").alias("n_b")), "b")
    both = both.join(F.broadcast(total))  # one row
    return both.select("a", "b", "support", (F.col("support") / F.col("n_a")).alias("confidence"), (F.col("total") * F.col("support") / (F.col("n_a") * F.col("n_b"))).alias("lift"))


def partners(corpus: Corpus, path: str, limit: int) -> DataFrame:
    """The strongest partners of a file, ties by path; the file's key prunes the join before it is made."""
    return coupling(corpus).where(F.col("a") == path).orderBy(F.desc("support"), "b").limit(limit)


def hub_share(corpus: Corpus) -> DataFrame:
    """The share of merged pull requests that touch a file; those without files count in the total."""
    total = corpus.items.where("kind = 'pr' and merged_at is not null").agg(F.count("*").alias("total"))
    return merged_pr_files(corpus).groupBy("path").agg(F.countDistinct("number").alias("prs")).join(F.broadcast(total)).select("path", "prs", (F.col("prs") / F.col("total")).alias("share"))


def hotspots(corpus: Corpus, now: str) -> DataFrame:
    """Exponentially aged merges of a file, over the largest such sum."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("merged_at")) / 86400.0
    heat = merged_pr_files(corpus).groupBy("path").agg(F.sum(F.exp(-age / DECAY_DAYS)).alias("heat"))
    return heat.join(F.broadcast(heat.agg(F.max("heat").alias("most")))).select("path", F.round(F.col("heat") / F.col("most"), 6).alias("hotspot"))


def similar(corpus: Corpus, limit: int) -> DataFrame:
    """For every open pull request the most similar merged ones by weighted file overlap; hubs weigh less.

    Candidates come from shared files (an equi-join), so no pair without an anchor is made.
    """
    hubs = hub_share(corpus).where(F.col("share") >= HUB_SHARE).select("path", F.lit(HUB_WEIGHT).alias("w"))
    files = corpus.pr_files.where("not (status <=> 'removed')").join(hubs, "path", "left").select("number", "path", F.coalesce("w", F.lit(1.0)).alias("w"))
    size = files.groupBy("number").agg(F.sum("w").alias("size"))
    state = corpus.items.where("kind = 'pr'").select("number", F.col("merged_at").isNotNull().alias("merged"), "state")
    own = files.join(state.where("state = 'open'"), "number").select(F.col("number").alias("a"), "path", "w")
    old = files.join(state.where("merged"), "number").select(F.col("number").alias("b"), "path")
    shared = own.join(old, "path").groupBy("a", "b").agg(F.sum("w").alias("shared"))
    shared = shared.join(size.select(F.col("number").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("number").alias("b"), F.col("size").alias("sb")), "b")
    score = F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return shared.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= limit).select("a", "b", F.round("score", 9).alias("score"), "rank")


def localised(corpus: Corpus, limit: int) -> DataFrame:
    """For every open pull request the files its own files change with, best confidence first."""
    own = corpus.pr_files.where("not (status <=> 'removed')").join(corpus.items.where("kind = 'pr' and state = 'open'").select("number"), "number").select("number", F.col("path").alias("a"))
    found = own.join(coupling(corpus), "a").groupBy("number", "b").agg(F.max(F.struct("confidence", "support")).alias("best"))
    found = found.join(own.select("number", F.col("a").alias("b")), ["number", "b"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("best.confidence"), F.desc("best.support"), "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("number", F.col("b").alias("path"), F.round("best.confidence", 9).alias("confidence"), "rank")


def triage(corpus: Corpus, weights: dict[str, float]) -> DataFrame:
    """Stage-1 scores of open issues: the weighted means of the features that are present, in [0, 1]."""
    people = without_bots(corpus.comments, corpus.actors).groupBy("number").agg(F.countDistinct("author").alias("participants"))
    comments = corpus.comments.groupBy("number").agg(F.count("*").alias("comments")).join(people, "number", "left").withColumn("participants", F.coalesce("participants", F.lit(0)))
    events = corpus.item_events.groupBy("number").agg(F.count_if(F.col("type") == "reopened").alias("reopens"))
    rows = corpus.items.where("kind = 'issue' and state = 'open'").select("number", "label").join(comments, "number", "left").join(events, "number", "left")
    demand = [F.least(F.lit(1.0), F.col("participants") / 3.0), F.least(F.lit(1.0), F.col("comments") / 5.0)]
    risk = [F.least(F.lit(1.0), F.col("reopens") / 1.0)]
    mean = lambda features: F.coalesce(F.aggregate(F.filter(F.array(*features), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(F.filter(F.array(*features), lambda x: x.isNotNull())), F.lit(0)), F.lit(0.0))
    score = F.lit(float(weights["demand"])) * mean(demand) + F.lit(float(weights["risk"])) * mean(risk)
    return rows.select("number", F.round(score, 9).alias("stage1"))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Recall at k and mean reciprocal rank of ranked(case, answer, rank) against truth(case, answer)."""
    cases = truth.groupBy("case").agg(F.count("*").alias("wanted"))
    hits = ranked.join(truth, ["case", "answer"]).groupBy("case").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"))
    rows = cases.join(hits, "case", "left")
    return rows.agg(F.count("*").alias("cases"), F.round(F.avg(F.coalesce("hits", F.lit(0)) / F.col("wanted")), 9).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr"))
