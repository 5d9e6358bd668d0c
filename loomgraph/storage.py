"""The shared folder: cut lineage, fresh paths, removal. Driver and executors see the same files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine, as in tests.
OWN_DIR = "/tmp/checkpoints/loomgraph"


def shared_dir(spark: SparkSession, name: str) -> str:
    """The full URI of a fresh folder below spark.checkpoint.dir, which the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{(base or OWN_DIR).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends in files that outlive executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that no later plan reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
