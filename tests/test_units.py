import json

import pytest

from loomgraph.corpus import Corpus
from loomgraph.operators import derived as D
from loomgraph.operators import graph as G
from loomgraph.operators import reads as R
from loomgraph.streaming import ingest as S


def test_shortest_path_takes_the_least_names(spark):
    edges = spark.createDataFrame([("item", a, "touches", "file", b) for a, b in (("1", "x"), ("2", "x"), ("2", "y"), ("1", "w"), ("3", "w"), ("3", "y"))], "src_type string, src string, rel string, dst_type string, dst string")
    assert [r.id for r in G.shortest_path(edges, ("item", "1"), ("file", "y")).orderBy("step").collect()] == ["1", "w", "3", "y"]
    assert G.shortest_path(edges, ("item", "1"), ("file", "nowhere")).count() == 0 == G.shortest_path(edges, ("item", "1"), ("item", "y")).count()
    odd = spark.createDataFrame([("item", "1", "touches", "file", "a>b"), ("item", "2", "touches", "file", "a>b"), ("label", "1", "x", "file", "c")], edges.schema)
    assert [r.id for r in G.shortest_path(odd, ("item", "1"), ("item", "2")).orderBy("step").collect()] == ["1", "a>b", "2"]
    assert {(r.type, r.id) for r in G.neighbourhood(odd, "item", "1", 5).collect()} == {("item", "1"), ("file", "a>b"), ("item", "2")}
    assert G.neighbourhood(edges, "item", "1", 5, most=3).count() == 3


def test_limits_are_validated(spark):
    from loomgraph import corpus

    with pytest.raises(ValueError):
        R.open_items(corpus.load(spark, "/root/testdata/sf0.001"), "pr", "x", 0)


def test_stream_split_equals_whole(spark, tmp_path):
    rows = [{"number": i % 7, "updated": f"2024-01-{1 + (i * 5) % 28:02d}", "seq": i, "state": f"s{i}"} for i in range(40)]
    schema = "number long, updated string, seq long, state string"
    states = []
    for parts in (1, 4):
        folder = tmp_path / f"in{parts}"
        folder.mkdir()
        for k in range(parts):
            (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k::parts]))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        store = S.ingest(spark, source, str(tmp_path / f"out{parts}"), "number", "updated", "seq")
        states.append(sorted(map(tuple, store.read().collect())))
        assert store.watermark("updated") == max(r["updated"] for r in rows)
    assert states[0] == states[1] and len(states[0]) == 7


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "t"))
    batch = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "a", 1)], "k long, updated string, seq long")
    store.upsert(batch, 0, "k", "updated", "seq")
    store.upsert(batch, 1, "k", "updated", "seq")
    store.upsert(batch, 1, "k", "updated", "seq")
    assert sorted(map(tuple, store.read().collect())) == [(1, "b", 1), (2, "a", 1)]
    one = spark.createDataFrame([(1, "c", 3)], batch.schema)
    store.upsert(one, 2, "k", "updated", "seq")
    assert len(set(store.manifest().values())) == 2  # only the touched bucket is new
    store.upsert(one.limit(0), 3, "k", "updated", "seq")
    store.expire(1)
    assert store.versions() == [3] and sorted(map(tuple, store.read().collect())) == [(1, "c", 3), (2, "a", 1)]


def test_evidence_over_the_cap_loses_whole_newest_parts(spark):
    rows = [(1, i, f"part {i:03d} " + "x" * 40) for i in range(30)] + [(1, 25, "closing_ref: closes"), (1, 40, "part 000 " + "x" * 40), (1, 31, "the newest")]
    rows += [(2, 1, "b; a"), (2, 2, " a ; c;"), (3, 1, None), (3, 2, "  "), (4, 1, "y" * 600), (5, 1, "z" * 510), (5, 2, "ab")]
    df = spark.createDataFrame(rows, "k long, s long, t string")
    got = {r.k: r.evidence for r in R.merged_evidence(df, ["k"], "s", "t", reserve=("closing_ref",)).collect()}
    first = [f"part {i:03d} " + "x" * 40 for i in range(9)]  # 9 x 51 + 31 = 490 of 512
    assert got == {1: "; ".join([*first, "closing_ref: closes", "the newest"]), 2: "b; a; c;", 3: None, 4: "y" * 512, 5: "ab"}


def test_shortest_path_follows_long_chains(spark):
    edges = spark.createDataFrame([("item", f"n{i:02d}", "blocked_by", "item", f"n{i + 1:02d}") for i in range(10)], "src_type string, src string, rel string, dst_type string, dst string")
    assert [r.id for r in G.shortest_path(edges, ("item", "n00"), ("item", "n10")).orderBy("step").collect()] == [f"n{i:02d}" for i in range(11)]


def test_bots_are_no_participants(spark):
    items = spark.createDataFrame([(1, "issue", "open", "ann", "x"), (2, "issue", "open", "bot", "x")], "number long, kind string, state string, author string, label string")
    comments = spark.createDataFrame([(1, "bob"), (1, "bot"), (1, "bob"), (2, "bot")], "number long, author string")
    events = spark.createDataFrame([], "number long, type string")
    actors = spark.createDataFrame([("ann", 0), ("bob", 0), ("bot", 1)], "login string, is_bot int")
    corpus = Corpus(items, None, comments, events, actors)
    assert {r.number: r.participants for r in R.participants(corpus).collect()} == {1: 2, 2: 0}
    got = {r.number: r.stage1 for r in D.triage(corpus, {"demand": 1.0, "risk": 0.0}).collect()}
    assert got == {1: round((1 / 3 + 3 / 5) / 2, 9), 2: round((0 + 1 / 5) / 2, 9)}
