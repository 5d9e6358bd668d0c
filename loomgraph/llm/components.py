"""Connected components by alternating large-star and small-star rounds over an edge table.

Every star is two partial aggregations and a join; a hub only ever meets its own minimum, so no group is
gathered in a task. Stars end in files of the shared folder, the labels never reach the driver. The edges are stored
before the first star too: a star reads them three times, and what they come from would be planned as often, in the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_dir


#: Edges have a > b.
EDGES = "a long, b long"


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its neighbourhood, itself included, to its larger neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its smaller neighbours to the others of these, and keeps it itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
    return odd.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links(a, b); component is the smallest node that can be reached.

    Self-links, repeated and reversed links are allowed, null ends are ignored; an empty table gives an empty table.
    """
    spark = links.sparkSession

    def stored(edges: DataFrame, before: str | None) -> tuple[DataFrame, str]:
        path = shared_dir(spark, "star")
        edges.write.parquet(path)
        if before:
            remove(spark, before)
        return spark.read.schema(EDGES).parquet(path), path

    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    edges, path = stored(edges, None)
    for _ in range(max_rounds):
        if _settled(edges):
            break
        for star in (_large_star, _small_star):
            edges, path = stored(star(edges), path)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
