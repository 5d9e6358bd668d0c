"""URL filter: host and path rules first, then a character language-model ratio.

Two variable-order Markov models, of accepted and of rejected URLs, are counted over all URLs whose class is known from
seed terms in the host or from an allow rule (a block rule says nothing of a URL's text, so what it blocks counts as accepted for
neither): every window of ORDER + 1 characters of `host path` by partial aggregation, and every shorter
run by the different characters seen before it. A character's probability is interpolated from the longest context that was
seen down to the uniform one (Witten-Bell weights). A URL's score is the log-likelihood of the rejected model less that of
the accepted one, divided by its length. The threshold is calibrated on held-back accepted URLs, so that about
FALSE_BLOCKS of them at most would be blocked.

The models are tables, one for each order, that hold every run of the corpus: each order is joined with the one below by
the run's suffix, and the windows of the URLs with the longest order. Nothing of them is broadcast by this module, collected or
capped. A window that a third of all URLs hold is one row of the models; the join with it can be split by Spark. Log ratios are
summed as whole numbers (SCALE), so that a score doesn't depend on the order of the rows.

Defined cases: a null url, or one without `://`, has empty host and path and is allowed unless a rule fits; one with a path but no
host (`http:///x`) is judged by the method; equal urls get equal verdicts; without URLs of both classes the method allows everything; an empty table gives an empty result;
extra columns are left alone; repeated rows are judged one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

ORDER, FALSE_BLOCKS, SCALE = 5, 0.002, 1 << 32
#: Host words that mark a URL as one to reject when the models are fitted.
SEEDS = ["adult", "ads", "bets", "bet", "casino", "clickbait", "malware", "phishing", "pills", "poker", "porn", "spam", "tracker", "viagra", "xxx"]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or holds no `://`."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.char_length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.char_length(host) + 1, F.char_length(after)), r"(?s)^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (`host/path start`) that fits the host or a domain above it, or null; of equal length the first."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _text(host: Column, path: Column) -> Column:
    return F.concat(F.lit("^" * ORDER), host, F.lit(" "), path, F.lit("$"))


def _windows(text: Column) -> Column:
    """The runs of ORDER + 1 characters of a text, one for each character behind the start mark."""
    return F.transform(F.sequence(F.lit(1), F.char_length(text) - ORDER), lambda i: F.substring(text, i, ORDER + 1))


def count_runs(rows: DataFrame) -> list[DataFrame]:
    """For each length from 1 to ORDER + 1: (run, a, r) of all runs of rows(text, cls), with the counts of class 0 and of class 1.

    Windows count by occurrence, shorter runs by the different characters before them, so that a surprise behind a familiar
    context costs once and not at each length. Rows whose cls is null count as none, but their runs are listed.
    """
    windows = rows.select(F.explode(_windows(F.col("text"))).alias("run"), "cls")
    counts = [windows.groupBy("run").agg(F.count_if(F.col("cls") == 0).alias("a"), F.count_if(F.col("cls") == 1).alias("r"))]
    for _ in range(ORDER):
        counts[0] = cut(counts[0], "url-runs")
        shorter = counts[0].groupBy(F.substring("run", 2, ORDER).alias("run"))
        counts.insert(0, shorter.agg(F.count_if(F.col("a") > 0).alias("a"), F.count_if(F.col("r") > 0).alias("r")))
    counts[0] = cut(counts[0], "url-runs")
    return counts


def log_ratios(counts: list[DataFrame], alphabet: int) -> DataFrame:
    """(run, ratio) of the longest runs: the log of the rejected model's probability of the last character less the accepted one's."""
    p = None
    for k, level in enumerate(counts):
        # one row for each character that follows a context
        seen = level.withColumn("context", F.substring("run", 1, k))
        sums = seen.groupBy("context").agg(*[f(c).alias(f"{c}_{n}") for c in "ar" for n, f in (("tokens", F.sum), ("types", lambda c: F.count_if(F.col(c) > 0)))])
        seen = seen.join(sums, "context")
        if p is None:
            seen = seen.withColumns({f"p_{c}": F.lit(1.0 / alphabet) for c in "ar"})
        else:
            seen = seen.withColumn("suffix", F.substring("run", 2, k)).join(p.withColumnRenamed("run", "suffix"), "suffix")
        mixed = lambda c: F.when(F.col(f"{c}_types") > 0, (F.col(c) + F.col(f"{c}_types") * F.col(f"p_{c}")) / (F.col(f"{c}_tokens") + F.col(f"{c}_types"))).otherwise(F.col(f"p_{c}"))
        p = cut(seen.select("run", *[mixed(c).alias(f"p_{c}") for c in "ar"]), "url-model")
    return p.select("run", F.log(F.col("p_r") / F.col("p_a")).alias("ratio"))


def score(rows: DataFrame, seeds: list[str] = SEEDS) -> tuple[DataFrame | None, float]:
    """(row, score) of rows(row, host, path, kind), and the threshold; None if a class has no row. kind: what a rule says, or null."""
    terms = F.when(F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, seeds))), 1).otherwise(0)
    rows = rows.withColumn("text", _text(F.col("host"), F.col("path"))).withColumn("cls", F.when(F.col("kind") == "allow", 0).when((F.col("host") != "") & ((F.col("kind").isNull()) | (terms == 1)), terms)).withColumn("back", F.pmod(F.xxhash64("text"), F.lit(10)) == 0)
    counts = count_runs(rows.select("text", F.when(~F.col("back"), F.col("cls")).alias("cls")))
    n, a, r = counts[0].agg(F.count("*"), F.sum("a"), F.sum("r")).first()
    if not a or not r:
        return None, math.inf
    ratios = log_ratios(counts, n + 1).select("run", F.round(F.col("ratio") * SCALE).cast("long").alias("ratio"))
    windows = rows.select("row", F.explode(_windows(F.col("text"))).alias("run"))
    sums = windows.join(ratios, "run").groupBy("row").agg(F.sum("ratio").alias("sum"), F.count("*").alias("n"))
    scores = cut(sums.select("row", (F.col("sum") / SCALE / F.col("n")).alias("score")), "url-scores")
    held = scores.join(rows.where(F.col("back") & (F.col("cls") == 0)).select("row"), "row", "left_semi")
    edge = held.agg(F.percentile_approx("score", 1 - FALSE_BLOCKS, 10_000)).first()[0]
    return scores, max(0.0, edge) if edge is not None else 0.0


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], seeds: list[str] = SEEDS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, score. rules: (allow or block, `host/path start`)."""
    host, path = host_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    kind = F.lit(None).cast("string")
    for verdict, rule in rules:
        kind = F.when(F.col("rule") == rule, verdict).otherwise(kind)
    rows = cut(rows.withColumn("kind", kind), "url-parts")
    scores, edge = score(rows.select("row", "host", "path", "kind"), seeds)
    found = rows.withColumn("score", F.lit(0.0)) if scores is None else rows.join(scores, "row")
    method = F.when((F.col("host") == "") & (F.col("path") == ""), "allow").when(F.col("score") > edge, "block").otherwise("allow")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("kind", method).alias("verdict"), "score")
