"""What keeps an incremental copy right: absent fields, whole and partial sections, displaced texts, torn rows, deletions, quiet passes.

All of it is set-based: a batch of observations meets the stored rows of the numbers it touches, whatever its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, batch: DataFrame, key: str, fields: list[str], other_key: str | None = None) -> DataFrame:
    """current with batch(key, fields.., present: array of the names that the source carried).

    A field that was carried wins, also with null; one that was absent keeps the old value. A stored row of another key with the
    same other_key is displaced, since that names one thing too. A batch holds a key once (last_wins before).
    """
    new = batch.select(F.col(key).alias("new_key"), *[F.col(f).alias(f"new_{f}") for f in fields], "present")
    rows = current.select(key, *fields).join(new, F.col(key) == F.col("new_key"), "full_outer")
    value = lambda f: F.when(F.col("new_key").isNotNull() & F.coalesce(F.array_contains("present", f), F.lit(False)), F.col(f"new_{f}")).otherwise(F.col(f))
    out = rows.select(F.coalesce("new_key", key).alias(key), F.col("new_key").isNotNull().alias("fresh"), *[value(f).alias(f) for f in fields])
    if other_key:
        taken = out.where(F.col("fresh") & F.col(other_key).isNotNull()).select(F.col(key).alias("owner"), F.col(other_key).alias("taken"))
        out = out.join(taken, (F.col(other_key) == F.col("taken")) & (F.col(key) != F.col("owner")), "left_anti")
    return out.drop("fresh")


def replace_children(current: DataFrame, batch: DataFrame, sections: DataFrame, parent: str, keys: list[str]) -> DataFrame:
    """Children of touched parents: those of a whole section replace the stored ones, those of a partial one are added or refreshed.

    sections(parent, carried, whole); a parent whose section wasn't carried keeps its rows.
    """
    whole = sections.where("carried and whole").select(parent)
    carried = sections.where("carried").select(parent)
    fresh = batch.join(carried, parent, "left_semi")
    kept = current.join(whole, parent, "left_anti").join(fresh.select(parent, *keys), [parent, *keys], "left_anti")
    return kept.unionByName(fresh)


def displaced(current: DataFrame, batch: DataFrame, sections: DataFrame, parent: str, key: str, text: str, seen: Column) -> DataFrame:
    """(parent, key, origin, content, valid_to): texts that an observation replaces, or, where the section is whole, no longer shows."""
    new = batch.select(F.col(key), F.col(text).alias("new_text"), F.lit(True).alias("here"))
    rows = current.join(sections.where("carried").select(parent, "whole"), parent).join(new, key, "left")
    edited = F.col("here") & ~F.col(text).eqNullSafe(F.col("new_text"))
    origin = F.when(edited, "edit").when(F.col("here").isNull() & F.col("whole"), "deleted")
    return rows.withColumn("origin", origin).where("origin is not null").select(parent, key, "origin", F.col(text).alias("content"), seen.alias("valid_to"))


def torn(listing: DataFrame, detail: DataFrame, key: str, updated: str, refreshes: int, most: int = 2) -> DataFrame:
    """(key, action) of rows whose detail is newer than the listing: refresh, or, after `most` refreshes, remember as pending."""
    newer = listing.select(key, F.col(updated).alias("listed")).join(detail.select(key, F.col(updated).alias("detailed")), key).where("detailed > listed")
    return newer.select(key, F.lit("refresh" if refreshes < most else "pending").alias("action"))


def pending(before: DataFrame, found: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Numbers still owed: those of before and found that weren't resolved."""
    return before.select(key).unionByName(found.select(key)).distinct().join(resolved.select(key), key, "left_anti")


def deletions(stored: DataFrame, listed: DataFrame, verdicts: DataFrame, key: str, drained: bool) -> DataFrame:
    """(key, status) of stored items that a full listing lacks and that a second source says are gone.

    Absence proves nothing unless the listing was drained, and one verdict that can't be had withholds all of them.
    verdicts(key, status): deleted, transferred, present, or null for unknown.
    """
    missing = stored.select(key).join(listed.select(key).distinct(), key, "left_anti")
    if not drained:
        missing = missing.limit(0)
    known = missing.join(verdicts.select(key, "status"), key, "left")
    doubt = known.agg(F.count_if(F.col("status").isNull()).alias("unknown"))  # one row
    return known.crossJoin(F.broadcast(doubt)).where("unknown = 0 and status in ('deleted', 'transferred')").select(key, "status")


def covered(pass_rows: DataFrame, before: DataFrame, key: str, digest: str) -> DataFrame:
    """Deliveries of this pass that the pass before delivered as often: the k-th equal one is covered if that had k of them."""
    kth = F.row_number().over(Window.partitionBy(key, digest).orderBy(F.lit(0)))
    seen = before.groupBy(key, digest).agg(F.count("*").alias("_times"))
    rows = pass_rows.withColumn("_kth", kth).join(seen, [key, digest], "left")
    return rows.withColumn("covered", F.coalesce(F.col("_kth") <= F.col("_times"), F.lit(False))).drop("_times", "_kth")


def equal_sets(one: DataFrame, two: DataFrame) -> bool:
    """Whether two passes delivered the same rows, by count and an order-free digest; nothing is collected but two numbers."""
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)"))).first()
    return digest(one.distinct()) == digest(two.distinct())


def drain(run_pass, most: int = 4) -> tuple[DataFrame, int, bool]:
    """Passes until two in a row deliver equal sets: (the last, how many, whether it settled). run_pass(k) gives the k-th."""
    before = run_pass(1)
    for k in range(2, most + 1):
        now = run_pass(k)
        if equal_sets(before, now):
            return now, k, True
        before = now
    return before, most, False


def kept_on_error(old: DataFrame, new: DataFrame, failed: DataFrame, owner: str) -> DataFrame:
    """Derived rows after an extractor failed for some owners: theirs stay as they were, all others are the new ones."""
    return new.join(failed.select(owner), owner, "left_anti").unionByName(old.join(failed.select(owner).distinct(), owner, "left_semi"))


def next_watermark(current: str | None, batch: DataFrame, updated: str) -> str | None:
    """The largest instant listed so far; it never goes back."""
    found = batch.agg(F.max(updated).cast("string")).first()[0]
    return reduce(lambda a, b: b if a is None or (b is not None and b > a) else a, [current, found])
