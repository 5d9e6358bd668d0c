"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves are (domain, language, source). Capacities (tokens x max_epochs) add up from the leaves; budgets run down from the
root. At each node the budget is poured over the children by weight: a child that would get more than its capacity gets
its capacity, and what it leaves goes to its siblings by weight. A node's own budget never exceeds its capacity, so a
shortage reaches an ancestor's level only once all siblings are full. All of it is integer arithmetic; odd tokens go
by largest remainder, then name. A leaf of budget b and t tokens takes b // t whole epochs and, from the next seeded
epoch, the documents that make up a prefix of b % t tokens.

Prefixes of a hot leaf are found without sorting it: an epoch's order is a hash, cut into buckets of about BUCKET rows;
bucket sums locate the one bucket that holds the end, and only that one is sorted.

Defined cases: null text has no tokens and is never taken (tokens_taken 0); null domain, language or source is the
name '(none)'; names without a weight weigh 1, weight 0 takes nothing; equal hashes go by id; repeated ids share their
place in the order, shorter rows first (rows of equal id and length are alike in the result); rows of null ids are one id; an empty
table gives an empty result; other columns, of whatever name, keep their values in take(). A leaf's bucket sums are one task,
which takes its documents / BUCKET rows: some ten million rows for 10^10 documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import cut, n_words, packed

BUCKET = 1024
LEVELS = ("domain", "lang", "source")
NONE = "(none)"
BIG = "decimal(38,0)"


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def pour(nodes: DataFrame, parents: list[str], key: str) -> DataFrame:
    """nodes(parents.., key, w, cap, budget of the parent) and `alloc`, the budget of each node."""
    big = lambda c: F.col(c).cast(BIG)
    up = Window.partitionBy(*(parents or [F.lit(0)]))
    order = up.orderBy(F.col("_ratio"), F.col(key))
    out = nodes.withColumn("_ratio", F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(float("inf"))))
    out = out.withColumn("_prev", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("_rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("_full", (F.col("w") > 0) & (big("cap") * big("_rest") <= big("w") * (big("budget") - big("_prev"))))
    out = out.withColumn("_left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(up), F.lit(0)))
    out = out.withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("w"))).over(up), F.lit(0)))
    share = "cast(w as decimal(19,0)) * cast(_left as decimal(19,0))"
    out = out.withColumn("_base", F.expr(f"case when _full then cap when _open = 0 then 0L else cast(({share}) div cast(_open as decimal(19,0)) as bigint) end"))
    out = out.withColumn("_frac", F.expr(f"case when _full or w = 0 or _open = 0 then -1L else cast(({share}) % cast(_open as decimal(19,0)) as bigint) end"))
    out = out.withColumn("_odd", F.col("_left") - F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_base"))).over(up), F.lit(0)))
    out = out.withColumn("_rank", F.row_number().over(up.orderBy(F.col("_frac").desc(), F.col(key))))
    odd = (F.col("_frac") >= 0) & (F.col("_rank") <= F.col("_odd"))
    return out.withColumn("alloc", F.col("_base") + odd.cast("long")).drop(*[c for c in out.columns if c.startswith("_")])


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget_percent: int, max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens, ..) and `alloc`, by pouring the budget down the three levels."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = caps.agg(F.least(F.expr(f"sum(tokens) * {int(budget_percent)} div 100"), F.sum("cap")).alias("budget"))
    above: list[str] = []
    given = None
    for level in LEVELS:
        own = [*above, level]
        nodes = caps.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        if given is None:
            nodes = nodes.join(F.broadcast(total))  # one row
        else:
            nodes = nodes.join(given, above)
        given = pour(nodes, above, level).select(*own, F.col("alloc").alias("budget"))
        above = own
    return leaves.join(given.withColumnRenamed("budget", "alloc"), list(LEVELS))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], budget_percent: int = 60, max_epochs: int = 2, seed: int = 1, domain: str = "source", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, domain, lang, source, n_tokens, full_epochs, tail_tokens, tokens_taken.

    domain is a SQL expression over docs; text, lang and source are the columns read.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    thin = docs.select(F.col(id_col).cast("long").alias("id"), name(F.expr(domain)).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), n_words(F.col("text")).alias("n_tokens"))
    thin = cut(thin, "mix-tokens")
    leaves = thin.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = cut(leaf_budgets(leaves, weights, budget_percent, max_epochs), "mix-leaves")
    plan = leaves.select(*LEVELS, "docs", F.expr("case when tokens = 0 then 0L else alloc div tokens end").alias("full_epochs"), F.expr("case when tokens = 0 then 0L else alloc % tokens end").alias("tail"))
    placed = thin.join(plan, list(LEVELS)).withColumn("at", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    placed = placed.withColumn("bucket", F.expr(f"(cast(conv(substr(at, 1, 8), 16, 10) as bigint) * (docs div {BUCKET} + 1)) div 4294967296"))
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("sum"), F.first("tail").alias("tail"))
    ends = sums.withColumn("end", F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("bucket")))
    ends = ends.select(*LEVELS, "bucket", (F.col("end") - F.col("sum")).alias("start"), F.col("end"))
    placed = placed.join(ends, [*LEVELS, "bucket"])
    inside = (F.col("start") < F.col("tail")) & (F.col("tail") < F.col("end"))
    whole = placed.where(~inside).withColumn("tail_tokens", F.when(F.col("end") <= F.col("tail"), F.col("n_tokens")).otherwise(F.lit(0).cast("long")))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("at", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    edge = placed.where(inside).withColumn("tail_tokens", F.greatest(F.lit(0).cast("long"), F.least(F.col("n_tokens"), F.col("tail") - F.col("start") - before)))
    cols = [F.col("id").alias(id_col), *LEVELS, "n_tokens", "full_epochs", "tail_tokens", (F.col("full_epochs") * F.col("n_tokens") + F.col("tail_tokens")).alias("tokens_taken")]
    return whole.select(*cols).unionByName(edge.select(*cols))


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs of which mixed, mix(docs), takes any token, whole; only those that may have to go are shuffled."""
    gone = cut(mixed.groupBy(F.col(id_col).cast("long").alias("key")).agg(F.max("tokens_taken").alias("most")).where("most = 0").select("key"), "mix-gone")
    apart, near = bloom.split(docs.select(packed(docs), F.col(id_col).cast("long").alias("key")), gone)
    near = near.join(gone.select(F.col("key").alias("lost")).hint("merge"), F.col("key").eqNullSafe(F.col("lost")), "left_anti")
    return apart.unionByName(near).select("own.*")
