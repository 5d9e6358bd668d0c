"""The edge table of a corpus and its traversals, as iterative joins. A node is a type and an id: item 7 and label 7 are two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..storage import cut

#: Relations that a path may not use.
NOT_STRUCTURAL = ("authored", "has_label", "commented", "reviewed", "merged_by")


def edges(corpus: Corpus) -> DataFrame:
    """(src_type, src, rel, dst_type, dst) of the corpus; ends are strings."""
    item = F.col("number").cast("string")
    row = lambda df, src_type, src, rel, dst_type, dst: df.select(F.lit(src_type).alias("src_type"), src.alias("src"), F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"), dst.alias("dst"))
    pulls = corpus.items.where("kind = 'pr'")
    return row(pulls, "actor", F.col("author"), "authored", "item", item).unionByName(row(pulls, "item", item, "has_label", "label", F.col("label"))).unionByName(row(corpus.pr_files, "item", item, "touches", "file", F.col("path")))


def incident(all_edges: DataFrame, kind: str, node: str) -> DataFrame:
    """Edges at a node, in two seeks; loops once."""
    src, dst = (F.col("src_type") == kind) & (F.col("src") == node), (F.col("dst_type") == kind) & (F.col("dst") == node)
    return all_edges.where(src).withColumn("way", F.lit("out")).unionByName(all_edges.where(dst & ~src).withColumn("way", F.lit("in")))


def adjacency(all_edges: DataFrame) -> DataFrame:
    """(u, v) over structural edges, both ways, each once; u and v are (type, id). Written once, so that the rounds of a search only read it."""
    used = all_edges.where(~F.col("rel").isin(*NOT_STRUCTURAL))
    end = lambda e: F.struct(F.col(f"{e}_type").alias("type"), F.col(e).alias("id"))
    one = used.select(end("src").alias("u"), end("dst").alias("v"))
    return cut(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "graph-adjacency")


def _start(all_edges: DataFrame, kind: str, node: str) -> DataFrame:
    return all_edges.sparkSession.createDataFrame([((kind, node),)], "node struct<type:string,id:string>")


def neighbourhood(all_edges: DataFrame, kind: str, node: str, depth: int, most: int | None = None) -> DataFrame:
    """(type, id, distance) of what can be reached in at most `depth` steps; with `most`, the first ones by distance, type and id.

    A round joins the frontier with the adjacency; once the budget is full, further rounds could add nothing.
    """
    steps = adjacency(all_edges)
    seen = _start(all_edges, kind, node).withColumn("distance", F.lit(0))
    for d in range(1, depth + 1):
        new = seen.where(F.col("distance") == d - 1).join(steps, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
        seen = cut(seen.unionByName(new.join(seen, "node", "left_anti").withColumn("distance", F.lit(d))), "graph")
        if most is not None and seen.count() >= most:
            break
    found = seen.select("node.type", "node.id", "distance")
    return found if most is None else found.orderBy("distance", "type", "id").limit(most)


def shortest_path(all_edges: DataFrame, start: tuple[str, str], end: tuple[str, str]) -> DataFrame:
    """(step, type, id) of a shortest undirected path over structural edges, of several the one of least names; or no row.

    The search ends when the end is reached or a round finds nothing new.
    """
    steps = adjacency(all_edges)
    seen = _start(all_edges, *start).select("node", F.array("node").alias("path"), F.lit(0).alias("distance"))
    goal = F.struct(F.lit(end[0]).alias("type"), F.lit(end[1]).alias("id"))
    d = 0
    while not seen.where(F.col("node") == goal).limit(1).count() and seen.where(F.col("distance") == d).limit(1).count():
        d += 1
        new = seen.where(F.col("distance") == d - 1).join(steps, F.col("node") == F.col("u")).groupBy(F.col("v").alias("node")).agg(F.min("path").alias("path"))
        new = new.join(seen.select("node"), "node", "left_anti").select("node", F.array_append("path", F.col("node")).alias("path"), F.lit(d).alias("distance"))
        seen = cut(seen.unionByName(new), "graph")
    return seen.where(F.col("node") == goal).select(F.posexplode("path").alias("step", "n")).select("step", "n.type", "n.id")


def export_nodes(corpus: Corpus, all_edges: DataFrame) -> DataFrame:
    """All nodes: stored items, and ends of edges that are no stored item."""
    stored = corpus.items.where("kind = 'pr'").select(F.lit("item").alias("type"), F.col("number").cast("string").alias("id"), F.lit(True).alias("stored"))
    ends = all_edges.select(F.col("src_type").alias("type"), F.col("src").alias("id")).unionByName(all_edges.select(F.col("dst_type").alias("type"), F.col("dst").alias("id"))).distinct()
    return stored.unionByName(ends.join(stored, ["type", "id"], "left_anti").withColumn("stored", F.lit(False)))
