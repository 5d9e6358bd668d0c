"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every text, counts how often each of k cells of a bit table is hit (partial aggregation before the
shuffle of bare cell numbers) and packs the cells hit twice or more into 4 KB bitmaps. Pass 2 tests each row against the
bitmaps: a row with a cell that was hit once is the only one of its text and passes straight through; only the others
shuffle, as (hash, id), and are grouped exactly; the verdicts of the largest groups are broadcast to their rows (meet). The bitmaps are broadcast; max_bits bounds them (32 MB by default).
Beyond about max_bits / bits_per_row rows the filter lets more unique rows through to the exact grouping, which
stays right at any size.

Defined cases: null text counts as empty; empty texts are equal to each other; of equal texts the largest id stays;
rows that repeat an id with the same text are counted one by one and share a verdict; a null id is less than any other, and
rows of null ids alone share the verdict null and stay; an empty table gives an empty result; other columns, of whatever
name, keep their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, cut, meet, packed


def text_key(text: Column) -> Column:
    """SHA-256 (binary) of the text with A-Z lower-cased."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def _filter(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, max_bits: int) -> tuple[DataFrame, DataFrame, int]:
    thin = cut(docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key")), "dedup-keys")
    bits = bloom.size(thin.count(), bits_per_row, max_bits)
    return thin, cut(bloom.bitmaps(thin, bits, 2), "dedup-filter"), bits


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = bloom.BITS_PER_ROW, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    thin, maps, bits = _filter(docs, id_col, text_col, bits_per_row, max_bits)
    marked = bloom.with_maybe(thin, maps, bits)
    alone = marked.where(~F.col("maybe")).select("id", "key", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    again = marked.where("maybe").select("id", "key")
    groups = again.groupBy("key").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    found = alone.unionByName(meet(again, cut(groups, "dedup-groups"), "key", "group_size").select("id", "key", "keep_id", "group_size"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("key")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = bloom.BITS_PER_ROW, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """docs without the rows whose text a row of a larger id has; unique rows pass without a shuffle."""
    thin, maps, bits = _filter(docs, id_col, text_col, bits_per_row, max_bits)
    again = bloom.with_maybe(thin, maps, bits).where("maybe")
    groups = again.groupBy("key").agg(F.max("id").alias("keep_id"))
    marked = bloom.with_maybe(docs.select(packed(docs), F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key")), maps, bits)
    alone = marked.where(~F.col("maybe")).select("own")
    kept = marked.where("maybe").join(groups.select(F.col("key").alias("group"), "keep_id"), (F.col("key") == F.col("group")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi").select("own")
    return alone.unionByName(kept).select("own.*")
