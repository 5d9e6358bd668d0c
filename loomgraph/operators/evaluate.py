"""Backtests: what is known to be true, what was visible at the time, and how well rankings, pairs and sets do.

A corpus is split at an instant: everything is learned from what was merged by then, cases are what was merged later, so no case sees
itself. All metrics are one aggregation over (case, answer) rows.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .triage import item_edges


def fix_cases(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(case, answer): merged pull requests and the issues that they close, by whatever stream."""
    closes = item_edges(edges, ("closes", "closes_keyword")).select(F.col("a").alias("case"), F.col("b").alias("answer")).distinct()
    merged = items.where("kind = 'pr' and merged is not null").select(F.col("number").alias("case"))
    issues = items.where("kind = 'issue'").select(F.col("number").alias("answer"))
    return closes.join(merged, "case", "left_semi").join(issues, "answer", "left_semi").select("case", "answer")


def truth_pairs(cases: DataFrame, most: int = 50) -> DataFrame:
    """(a, b), a < b: issues that one request closes; requests that close more than `most` say nothing of pairs."""
    sized = cases.groupBy("case").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("case")
    rows = cases.join(sized, "case")
    return rows.withColumnRenamed("answer", "a").join(rows.withColumnRenamed("answer", "b"), "case").where("a < b").select("a", "b").distinct()


def duplicate_pairs(edges: DataFrame) -> DataFrame:
    found = item_edges(edges, ("duplicate_of", "duplicate_keyword"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def ranking(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: cases, recall and precision at k, MRR, accuracy at 1, 3 and k of ranked(case, answer, rank) against truth(case, answer)."""
    wanted = truth.groupBy("case").agg(F.count("*").alias("wanted"))
    shown = ranked.where(F.col("rank") <= k).groupBy("case").agg(F.count("*").alias("shown"))
    hits = ranked.join(truth, ["case", "answer"]).groupBy("case").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"))
    rows = wanted.join(hits, "case", "left").join(shown, "case", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    within = lambda n: F.round(F.avg(F.coalesce((F.col("first") <= n).cast("double"), F.lit(0.0))), 9)
    return rows.agg(
        F.count("*").alias("cases"), F.round(F.avg(zero(F.col("hits") / F.col("wanted"))), 9).alias("recall"), F.round(F.avg(zero(F.col("hits") / F.col("shown"))), 9).alias("precision"),
        F.round(F.avg(zero(1.0 / F.col("first"))), 9).alias("mrr"), within(1).alias("top1"), within(3).alias("top3"), within(k).alias("acc"),
    )


def pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision and recall of predicted(case, a, b) against truth(a, b), over all pairs (micro) and as a mean of cases (macro)."""
    hit = predicted.join(truth.withColumn("hit", F.lit(1)), ["a", "b"], "left").select("case", "a", "b", F.coalesce("hit", F.lit(0)).alias("hit"))
    total = truth.agg(F.count("*").alias("total"))
    micro = hit.select("a", "b", "hit").distinct().agg(F.count("*").alias("predicted"), F.sum("hit").alias("hits"))
    macro = hit.groupBy("case").agg(F.avg("hit").alias("p")).agg(F.round(F.avg("p"), 9).alias("macro_precision"))
    rows = micro.join(F.broadcast(total)).join(F.broadcast(macro))  # one row each
    return rows.select("predicted", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.round(F.col("hits") / F.col("predicted"), 9).alias("precision"), F.round(F.col("hits") / F.col("total"), 9).alias("recall"), "macro_precision")


def exact_sets(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: cases, and those whose predicted(case, answer) set is the true one."""
    group = lambda df, name: df.groupBy("case").agg(F.array_sort(F.collect_set("answer")).alias(name))
    both = group(truth, "want").join(group(predicted, "got"), "case", "left")
    return both.agg(F.count("*").alias("cases"), F.count_if(F.col("want") == F.col("got")).alias("exact"))


def split(merged_files: DataFrame, instant: int) -> tuple[DataFrame, DataFrame]:
    """(files merged by the instant, files merged later)."""
    return merged_files.where(F.col("merged") <= instant), merged_files.where(F.col("merged") > instant)


def localise(coupled: DataFrame, later: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked, truth) for requests merged later: their first file is given, the others are to be found among its partners by then."""
    truth = later.select(F.col("number").alias("case"), F.col("path").alias("answer")).distinct()
    seeds = truth.groupBy("case").agg(F.min("answer").alias("fa"))
    rank = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("support"), F.desc(F.col("support") / F.col("na")), "fb"))
    ranked = seeds.join(coupled, "fa").withColumn("rank", rank).select("case", F.col("fb").alias("answer"), "rank")
    wanted = truth.join(seeds, "case").where("answer <> fa").select("case", "answer")
    return ranked, wanted


def random_baseline(population: list[str], truth: dict[int, set[str]], k: int, seed: int, rounds: int = 100) -> float:
    """Mean recall at k of a seeded random choice out of a bounded population, for comparison."""
    r, total = random.Random(seed), 0.0
    for _ in range(rounds):
        for want in truth.values():
            total += len(want & set(r.sample(population, min(k, len(population))))) / len(want)
    return total / (rounds * len(truth)) if truth else 0.0


def leakage(cases: DataFrame, items: DataFrame, instant: int) -> DataFrame:
    """One row: cases whose request or answer was already merged or closed at the instant, which a backtest has to name."""
    rows = cases.join(items.select(F.col("number").alias("case"), F.col("merged").alias("case_merged")), "case").join(items.select(F.col("number").alias("answer"), F.col("closed").alias("answer_closed")), "answer")
    return rows.agg(F.count("*").alias("pairs"), F.count_if(F.col("case_merged") <= instant).alias("merged_before"), F.count_if(F.col("answer_closed") <= instant).alias("closed_before"))
