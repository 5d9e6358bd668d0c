"""Issue-graph analytics on Spark: relational corpus, edge graph, derived rankings, streaming ingest."""

__version__ = "0.1.0"
