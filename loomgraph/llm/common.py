"""Helpers shared by the training-data operators: users' columns, the shared folder, word splitting."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, remove, shared_dir  # noqa: F401

#: Only these letters are folded; other alphabets keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The MOST largest groups of more than LARGE rows are told apart. Only speed depends on them.
LARGE, MOST = 1_000, 1_000
#: A word: everything between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct: whatever their names, they can't clash with those that an operator adds."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("own")


def meet(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with groups(key, size, ..): those of the MOST largest groups by broadcast, so that no task gets all rows of one."""
    large = F.broadcast(groups.where(F.col(size) > LARGE).orderBy(F.desc(size), key).limit(MOST))
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(groups, key))


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """A folder of shared_dir, from a Python worker."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
