"""Claims on items: comments that take an item, releases that give it back, and which claim holds at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X


def claims(comments: DataFrame, now: int, window_hours: int = X.WINDOW_HOURS, enabled: bool = True) -> DataFrame:
    """comments(number, comment_id, author, association, created, body) -> every claim, with whether it holds at `now`.

    A claim holds if its author is trusted, it is not older than the window, and no later release of the same token (or of no
    token, where the claim has none) follows. That is an anti join on (number, token) with an order; a release meets only the
    claims of its item.
    """
    marked = comments.where(F.lower("body").contains("claim") | F.lower("body").contains("working this issue"))
    said = marked.select("number", "comment_id", "author", "association", "created", F.explode(X.claims(F.col("body"))).alias("s")).select("*", "s.kind", "s.token", "s.named").drop("s")
    last = said.where("kind = 'release'").groupBy("number", "token").agg(F.max(F.struct("created", "comment_id")).alias("released"))
    last = last.select(F.col("number").alias("r_number"), F.col("token").alias("r_token"), "released")
    held = said.where("kind = 'claim'").join(last, (F.col("number") == F.col("r_number")) & F.col("token").eqNullSafe(F.col("r_token")), "left")
    ended = F.coalesce(F.col("released") > F.struct("created", "comment_id"), F.lit(False))
    age = (F.lit(now) - F.col("created")) / 3600.0
    out = held.withColumns({"trusted": F.upper("association").isin(*X.TRUSTED), "ended": ended, "age_hours": F.round(age, 4)})
    active = F.lit(enabled) & F.col("trusted") & ~F.col("ended") & (age >= 0) & (age < window_hours)
    return out.withColumn("active", F.coalesce(active, F.lit(False))).drop("r_number", "r_token", "released", "kind")


def gate(found: DataFrame) -> DataFrame:
    """The earliest claim that holds, for each item that one holds."""
    first = F.struct("created", "comment_id")
    return found.where("active").groupBy("number").agg(F.min_by(F.struct("comment_id", "author", "token"), first).alias("c")).select("number", "c.*")
