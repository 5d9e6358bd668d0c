"""Raw payloads as text: what was carried, what it says, and when. Absent, null and a value are three things."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_kind(raw: Column) -> Column:
    """pr or issue, by the payload's own mark."""
    carried = F.array_contains(F.json_object_keys(raw), "pull_request") & F.get_json_object(raw, "$.pull_request").isNotNull()
    return F.when(F.coalesce(carried, F.lit(False)), "pr").otherwise("issue")


def signal(raw: Column, key: str, path: str | None = None, kind: str = "string") -> Column:
    """(present, value): whether the payload carries the key at its top level, and what path ($.. syntax) holds; null also if it is no such kind."""
    present = F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))
    value = F.try_variant_get(F.try_parse_json(raw), path or f"$.{key}", kind)
    return F.struct(present.alias("present"), value.alias("value"))


def merged_signal(old: Column, new: Column) -> Column:
    """The old value where the new payload is silent, else the new one, also if that is null."""
    return F.when(new["present"], new["value"]).otherwise(old)


def signals(raw: Column) -> Column:
    """The signals of an item's payload."""
    named = {
        "reactions": signal(raw, "reactions", '$.reactions["+1"]', "bigint"), "due": signal(raw, "milestone", "$.milestone.due_on"), "type": signal(raw, "type", "$.type.name"),
        "subs": signal(raw, "sub_issues_summary", "$.sub_issues_summary.total", "bigint"), "subs_done": signal(raw, "sub_issues_summary", "$.sub_issues_summary.completed", "bigint"),
        "association": signal(raw, "author_association"), "locked": signal(raw, "locked", kind="boolean"),
    }
    return F.struct(*[c.alias(n) for n, c in named.items()])


def instant(text: Column) -> Column:
    """An ISO instant, or null for anything else; without a zone it counts as UTC (the session's zone must be)."""
    return F.try_to_timestamp(text)


def strict_instant(text: str) -> datetime:
    """An instant that a caller gives: it must have a zone."""
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if found.tzinfo is None:
        raise ValueError("an instant needs a zone")
    return found


def age_days(then: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / 1e6 / 86400


def garbled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, garbled): texts that hold replacement characters or the marks of a wrong decoding."""
    marks = "�|Ã[\u0080-¿©¨ª¤¶¼]|â€[™œ\u009d“”]"
    counts = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).rlike(marks)).alias(f"g_{c}") for c in columns])
    return counts.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"g_{c}").alias("garbled")) for c in columns])).alias("x")).select("x.column", "rows", "x.garbled")


def freshness(state: DataFrame, now: int) -> DataFrame:
    """state(repo, synced, complete, watermark) with the age in seconds; a state that was never synced has none."""
    return state.withColumn("age_s", F.when(F.col("synced").isNotNull(), F.greatest(F.lit(0).cast("long"), F.lit(now).cast("long") - F.col("synced")))).withColumn("stale", F.coalesce(F.col("age_s") > 86_400, F.lit(True)) | ~F.coalesce("complete", F.lit(False)))
