"""Similar items in many small blocks, and what the queries store."""

import numpy as np
import pytest
from test_catalog import SF, duck, rows  # noqa: F401

from loomgraph import storage
from loomgraph.operators import bundle as U
from loomgraph.operators import similarity as Y
from loomgraph.operators.similar_blocks import first
from loomgraph.plans import catalog


@pytest.mark.parametrize("name", ["similar_ranked", "similar_signals"])
def test_small_blocks_and_stored_rows(spark, duck, name, monkeypatch):  # noqa: F811
    """The same rows from many blocks with rare words joined by shuffle; what is stored grows with items, words and file pairs, not with pairs of items."""
    for constant, value in {"BLOCK_WORDS": {True: 1_000, False: 9_000}, "SPLIT": 2, "SPREAD": 1, "HOT": 20}.items():
        monkeypatch.setattr(Y, constant, value)
    stored, make = set(), storage.shared_dir
    monkeypatch.setattr(storage, "shared_dir", lambda session, folder: stored.add(folder) or make(session, folder))
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert rows(map(tuple, got.select(*cols).collect())) == rows(duck.execute(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall())
    assert {n for n in stored if n.startswith("similar-")} == {"similar-hubs", "similar-named", "similar-profiles", "similar-words", "similar-coupled"}


def test_first_keeps_ties_by_number():
    """Totals that are equal after rounding to nine digits go by number; halves go up, as in Spark."""
    totals = np.array([1.0, 2.0, 2.0 + 1e-12, 2.0 - 1e-12, 0.5, 2.0])
    assert sorted(first(totals, np.array([1, 9, 8, 7, 2, 6]), 2)) == [3, 5]
    assert list(first(np.array([0.0009765625, 0.000976563]), np.array([2, 1]), 1)) == [1]
    assert sorted(first(totals, np.arange(6), 6)) == list(range(6))


def test_bundles_query(spark, duck):  # noqa: F811
    """The bundles that grow from the SQL's totals and pairs, for the whole pool of open issues."""
    top = duck.execute(f"select number, total from ({catalog.oracle_sql()['triage_totals']}) where rank <= 50").fetchall()
    numbers = [n for n, _ in top]
    sql, asked = catalog.oracle_sql()["similar_signals"], "q as (select number from ip union select number from sg)"
    assert sql.count(asked) == 1 and len(numbers) == 50
    sql = sql.replace(asked, f"q as (select unnest({numbers}::bigint[]) as number)")
    got = duck.execute(f"select * from ({sql}) where a < b and b in (select unnest({numbers}::bigint[]))").fetchdf().to_dict("records")
    pairs = [{"a": r["a"], "b": r["b"], "anchors": ["any"], "title": r["title"], "total": sum(w * r[n] for n, w in Y.WEIGHTS.items())} for r in got]
    files = dict(duck.execute("select number, list(path) from (select doc_id * 2 + 1 as number, 'part/' || (doc_id % 300) || '.py' as path from documents where doc_id % 8 in (2, 3) union select doc_id * 2 + 1, 'part/' || (doc_id % 211) || '.py' from documents where doc_id % 8 = 3) group by 1").fetchall())
    found = U.grow([U.Member(n, s, frozenset(files.get(n, ()))) for n, s in top], pairs, [], set(), U.Rules(floor=0.5))
    want = {(b["id"], i, n, round(b["score"], 6)) for b in found for i, n in enumerate(b["members"])}
    assert want and {(*r[:3], round(r.score, 6)) for r in catalog.queries()["bundles"](spark, SF).collect()} == want


def test_every_pair_of_a_pool(spark):
    """Pairs without an anchor come too; words weigh by all items, also those outside the pool."""
    items = spark.createDataFrame([(n, t, "", "a", 0, None) for n, t in [(1, "alpha beta"), (2, "alpha gamma"), (3, "delta"), (4, "alpha")]], "number long, title string, body string, author string, created long, due long")
    none = lambda schema: spark.createDataFrame([], schema)
    labels, paths, signatures, neighbours, hubs = (none(s) for s in ("number long, name string", "number long, path string", "number long, signature string", "number long, other long", "path string"))
    own = Y.profiles(items.where("number < 4"), labels, paths, signatures, neighbours, hubs)
    pairs = Y.coupled(none("number long, path string"), hubs)
    got = {(r.a, r.b): r for r in U.pool_pairs(own, items, pairs).collect()}
    alpha, alone = np.log(1 + 4 / 3), np.log(1 + 4)
    assert set(got) == {(1, 2), (1, 3), (2, 3)} and abs(got[1, 2].lexical - alpha / (alpha + 2 * alone)) < 1e-12 and got[1, 3].lexical == 0


@pytest.mark.parametrize("few", [0, 100])
def test_only_what_anchors_reach(spark, few, monkeypatch):
    """Items without a signature, neighbour, file or co-changed file of an asked one are not reached; only the asked files' pairs are counted."""
    monkeypatch.setattr(Y, "FEW", few)
    merged = spark.createDataFrame([(10, "a"), (10, "b"), (11, "b"), (11, "c"), (12, "x"), (12, "y"), (13, "z"), (14, "q"), (14, "p")], "number long, path string")
    hubs = spark.createDataFrame([], "path string")
    pairs = Y.coupled(merged, hubs, spark.createDataFrame([("a",), ("a",)], "path string"))
    assert [(r.fa, r.fb, r.support, r.na, r.nb, r.anchors) for r in pairs.collect()] == [("a", "b", 1, 1, 2, True)]
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in Y.coupled(merged, hubs).where("fa = 'a'").collect()}
    paths = merged.unionByName(spark.createDataFrame([(1, "a")], "number long, path string"))
    signatures = spark.createDataFrame([(1, "E"), (20, "E"), (21, "F")], "number long, signature string")
    neighbours = spark.createDataFrame([(1, 30), (30, 1), (31, 30), (30, 31), (32, 33), (33, 32)], "number long, other long")
    asked = spark.createDataFrame([(1,)], "number long")
    assert sorted(r.number for r in Y.reached(asked, paths, signatures, neighbours, pairs).collect()) == [1, 10, 11, 20, 31]


def test_equal_texts_are_read_once(spark):
    """An extractor runs once for equal rows of a batch, and gives every row its own."""
    from pyspark.sql import functions as F

    from loomgraph.functions import extract as X

    runs = spark.sparkContext.accumulator(0)
    f = lambda text: (runs.add(1), None if text is None else [int(x) for x in text.split()])[1]
    rows = spark.range(0, 90, 1, 1).select("id", F.when(F.col("id") % 3 < 2, F.concat(F.lit("7 "), (F.col("id") % 3).cast("string"))).alias("t"))
    got = rows.select("id", X._column("array<long>", f, F.col("t")).alias("x")).collect()
    assert all(r.x == (None if r.id % 3 == 2 else [7, r.id % 3]) for r in got) and len(got) == 90 and runs.value == 3


def test_keyword_edges_read_texts_once(spark):
    """Titles and bodies are read by one extraction; a closing word counts in a pull request's body only, and what it closes isn't mentioned too."""
    from loomgraph.operators import edges as E

    items = spark.createDataFrame([("o/r", 2, "pr", "see #5", "fixes #5, #7"), ("o/r", 4, "pr", "fixes #9", "#11 duplicate of #11"), ("o/r", 6, "issue", "t", "fixes #9"), ("o/r", 8, "issue", None, "#8")], "repo string, number long, kind string, title string, body string")
    found = E.keyword_edges(items)
    assert {(r.src, r.rel, r.dst, r.evidence) for r in found.collect()} == {("2", "closes_keyword", "5", "body@6 closing keyword"), ("2", "mentions", "7", "body@10"), ("4", "mentions", "9", "title"), ("4", "mentions", "11", "body@0"), ("4", "duplicate_keyword", "11", "body@17"), ("6", "mentions", "9", "body@6")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
