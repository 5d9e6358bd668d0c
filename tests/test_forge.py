"""Extraction, SQL surface, settings, logs, snapshots, bundles and packets, against cases made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.corpus import Corpus, merged_pr_files
from loomgraph.functions import extract as X
from loomgraph.functions import sql as Q
from loomgraph.functions import text as T
from loomgraph.operators import bundle as U
from loomgraph.operators import claims as K
from loomgraph.operators import edges as E
from loomgraph.operators import evaluate as V
from loomgraph.operators import export as B
from loomgraph.operators import items as I
from loomgraph.operators import search as S
from loomgraph.operators import triage as T3
from loomgraph.sources import bundles, config
from loomgraph.streaming import integrity as Z

REPO = "acme/app"
mentions = lambda text: [n for k, n, _ in X.references_of(text, REPO) if k == "mentions"]
closes = lambda text: [n for k, n, _ in X.references_of(text, REPO) if k == "closes"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("see #12 and `#13`\n> quoted #14\n```\n#15\n```\nother/repo#16 #12 word#17 (#18)", [12, 18]),
        ("````\n```\n#1\n```\n#2\n````\n#3", [3]),
        ("~~~\n#1\n```\n#2\n~~~\n#3", [3]),
        ("``a ` #1`` #2 ` #3", [2, 3]),
        ("@@ -1 +1 @@\n+ #1\n- #2\n  #3\nplain #4", [3, 4]),
        ("- list #1\n+ list #2", [1, 2]),
        ("comment #5 Comment   #6 acomment #7", [7]),
        ("other/repo #8 acme/app #9 Acme/App#10 https://github.com/acme/app/pull/11 https://github.com/x/y/issues/12", [9, 10, 11]),
        ("#12345678901 #1234567890", [1234567890]),
        ("", []),
        (None, []),
    ],
)
def test_mentions(text, want):
    assert mentions(text) == want


def test_closing_words_and_duplicates():
    assert closes("Fixes #1, closes: #2 resolved this #3 fix acme/app#4 closing #5 fixed https://github.com/acme/app/issues/6 fix other/x#7 prefix #8") == [1, 2, 3, 4, 6]
    assert [n for k, n, _ in X.references_of("duplicate of #3, dup #4, duplicates acme/app#5, dup of other/x#6", REPO) if k == "duplicates"] == [3, 4, 5]
    assert X.references_of("x #5 then #5", REPO) == [("mentions", 5, 2)]


def test_paths_signatures_tasks():
    text = 'File "a/b.py", line 3, in f\nat src/x.go:10:2 and `lib/y.rs` `not a path` `lib/y.rs` http://h/z:1:2 https://github.com/acme/app/blob/main/doc/r.md#L3 https://github.com/o/p/blob/main/no.md 10:20:30'
    assert X.paths_of(text, REPO) == [("a/b.py", False), ("doc/r.md", False), ("lib/y.rs", True), ("src/x.go", False)]
    block = '```\nFile "m.py", line 3, in go\nKeyError: 12 at 0xAF x12\nKeyError: 13 at 0xB0 x12\n```\nValueError: outside'
    assert X.signatures_of(block) == [("KeyError", "KeyError: <n> at <hex> x12", "go")]
    assert X.task_refs_of("- [ ] #4 a\n* [x] done #5\n- #6\n  + [X] see #7 and #8") == [4, 5, 7]


def test_claims_and_releases():
    token = "a" * 16
    assert X.claim_of(f"hi\nagent CLAIM session={token} issues=#4,5,x/y#6 and #7 other/r#8 #9x") == ("claim", token, [4, 5, 7])
    assert X.claim_of("```\nAgent claim\n```\n> Agent claim") is None and X.claim_of(f"Agent claim session={'a' * 65}") == ("claim", None, [])
    assert X.claim_of(f"**Claim released** session={token} Agent claim") == ("release", token, []) and X.claim_of("so **Claim released") is None


def test_which_claim_holds(spark):
    t = [c * 16 for c in "abc"]
    rows = [(1, 1, "x", "OWNER", 0, f"Agent claim session={t[0]}"), (1, 2, "x", "NONE", 10, "Agent claim"), (1, 3, "y", "MEMBER", 20, f"Agent claim session={t[1]}"), (1, 4, "x", "OWNER", 30, f"**Claim released session={t[0]}"), (2, 5, "z", "MEMBER", 40, "Working this issue"), (2, 6, "z", "MEMBER", 40, "**Claim released"), (3, 7, "z", "MEMBER", 50, "Working this issue"), (3, 8, "z", "MEMBER", 60, f"**Claim released session={t[2]}"), (4, 9, "z", "OWNER", None, "Agent claim"), (5, 10, "z", "OWNER", -300_000, "Agent claim")]
    found = K.claims(spark.createDataFrame(rows, "number long, comment_id long, author string, association string, created long, body string"), 100)
    assert {r.comment_id: (r.trusted, r.ended, r.active) for r in found.collect()} == {1: (True, True, False), 2: (False, False, False), 3: (True, False, True), 5: (True, True, False), 7: (True, False, True), 9: (True, False, False), 10: (True, False, False)}
    assert {(r.number, r.comment_id) for r in K.gate(found).collect()} == {(1, 3), (3, 7)}


def test_snippet_and_query_words():
    assert X.snippet(" ".join(f"w{i}" for i in range(40)) + " key word", ["key", "WORD"], 4) == "…w38 w39 «key» «word»"
    assert X.snippet("a key b", ["key"]) == "a «key» b" and X.snippet("", ["x"]) == ""
    assert S.parse("the Fix of it") == (["the", "fix", "of", "it"], ["fix"]) and S.parse("the of") == (["the", "of"], ["the", "of"])


def test_globs_bots_and_similar_paths(spark):
    df = spark.createDataFrame([("tests/a_test.py", "x[bot]", "User"), ("src/a.py", "ann", "Bot"), ("Src/A.py", None, None)], "p string, login string, kind string")
    got = df.select(X.glob_matches(F.col("p"), "tests/*_test.py").alias("g"), X.is_bot(F.col("login"), F.col("kind"), ["ann"]).alias("b"), X.like_paths(F.col("p"), "lib/a.py").alias("l")).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, True, True), (False, False, True)]


@pytest.mark.parametrize("sql", ["select ';' as a -- ;\n", "WITH x as (select 1) select * from x;", "/* c */ explain select 1", "﻿select 1", "select 'drop table x'"])
def test_read_sql_is_allowed(spark, sql):
    Q.assert_read(spark, sql)


@pytest.mark.parametrize("sql", ["", "drop table x", "select 1; select 2", "insert into t select 1", "with x as (select 1) insert into t select * from x", "set a=b", "create view v as select 1", "explain insert into t select 1", "cache table t", "show tables"])
def test_other_sql_is_refused(spark, sql):
    with pytest.raises(ValueError):
        Q.assert_read(spark, sql)


def test_sql_within_limits(spark):
    tables = {"items": spark.createDataFrame([("acme/app", i, "open", "x" * 50) for i in range(30)] + [("acme/lib", 99, "closed", "y")], "repo string, number long, state string, body string")}
    out = Q.run(spark, tables, "select number, number, body from items order by number", limit=5, cell=10)
    assert out["columns"] == ["number", "number", "body"] and len(out["rows"]) == 5 and out["truncated"] and out["rows"][1] == [1, 1, "x" * 10]
    assert not Q.run(spark, tables, "select 1 as a")["truncated"]
    assert [r[1] for r in Q.run(spark, tables, "select repo, number from items where number > 28", repo="Acme/Lib")["rows"]] == [99]
    assert Q.run(spark, tables, "select * from items where state = 'opened'")["warnings"] == ["items.state is never 'opened'; near: open"]
    with pytest.raises(ValueError, match="did you mean items"):
        Q.run(spark, tables, "select * from item")
    with pytest.raises(ValueError, match="state"):
        Q.run(spark, tables, "select stat from items")
    assert Q.run(spark, tables, "select body from items", most_bytes=120)["truncated"]
    assert {r["column"] for r in Q.schema(tables, "items")} == {"repo", "number", "state", "body"}
    with pytest.raises(ValueError):
        Q.schema(tables, "nothing")


def test_settings_chain(tmp_path):
    store, own = tmp_path / "s.toml", tmp_path / "o.toml"
    store.write_text("[triage]\ntop_k = 7\n[triage.labels]\nurgent = 1\n")
    own.write_text("[triage]\ndemand = 2\n[triage.labels]\nlow = 0.1\n")
    defaults = {"top_k": 50, "demand": 1.0, "labels": {}, "enabled": True}
    assert config.chain("triage", defaults, str(store), str(own), str(tmp_path / "none.toml")) == ({"top_k": 7.0, "demand": 2.0, "labels": {"urgent": 1.0, "low": 0.1}, "enabled": True}, str(own))
    for bad in ({"other": 1}, {"demand": -1}, {"demand": float("nan")}, {"demand": True}, {"labels": 3}, {"enabled": 1}, {"demand": 2e9}):
        with pytest.raises(ValueError):
            config.merged(defaults, bad)


def test_observation_log(spark, tmp_path):
    one = lambda n, updated, title, **more: {"resource": "item_bundle", "payload": {"number": n, "item": {"number": n, "title": title, "updated_at": updated, "user": {"login": "ann"}}, **more}}
    rows = [one(2, "2024-02", "b"), one(1, "2024-01", "a", files=[{"filename": "x.py", "status": "added"}], children_complete={"files": True}), one(1, "2024-01", "a", files=[{"filename": "x.py", "status": "added"}], children_complete={"files": True}), one(1, "2024-03", "a2", files=[], timeline=[{"type": "closed", "created_at": f"{i:04d}"} for i in range(600)]), {"resource": "release", "payload": {}}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    log = bundles.read(spark, str(tmp_path / "log.jsonl"))
    assert [(r.payload.number, r.payload.item.title) for r in bundles.replay(log).collect()] == [(1, "a"), (2, "b"), (1, "a2")]
    latest = bundles.fetch(log, [1, 2])
    assert {r.number: r.payload.item.title for r in latest.collect()} == {1: "a2", 2: "b"}
    assert bundles.children(latest, "files").count() == 0 and bundles.children(latest, "timeline").count() == 500
    assert {r.number: (r.carried, r.whole) for r in bundles.complete(latest, "files").collect()} == {1: (True, False), 2: (False, False)}
    assert [(r.number, r.page) for r in bundles.listed(log, "2024-02", 1).orderBy("page").collect()] == [(2, 0), (1, 1)]
    stream = bundles.read(spark, str(tmp_path), stream=True)
    assert stream.isStreaming


def test_passes_and_watermarks(spark):
    sets = {1: [1, 2], 2: [1, 3], 3: [3, 1]}
    run = lambda k: spark.createDataFrame([(x,) for x in sets[k]], "n long")
    assert Z.drain(run)[1:] == (3, True) and Z.drain(lambda k: spark.createDataFrame([(k,)], "n long"))[1:] == (4, False)
    batch = spark.createDataFrame([("2024-01",), ("2024-03",)], "u string")
    assert Z.next_watermark(None, batch, "u") == "2024-03" and Z.next_watermark("2024-09", batch, "u") == "2024-09" and Z.next_watermark("2024-09", batch.limit(0), "u") == "2024-09"


def test_unknown_verdicts_and_open_listings_delete_nothing(spark):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "n long")
    verdicts = spark.createDataFrame([(2, "deleted"), (3, None)], "n long, status string")
    assert Z.deletions(rows(1, 2), rows(1), verdicts, "n", True).count() == 1
    assert Z.deletions(rows(1, 2, 3), rows(1), verdicts, "n", True).count() == 0 == Z.deletions(rows(1, 2), rows(1), verdicts, "n", False).count()
    old, new = (spark.createDataFrame([(n, o) for n in (1, 2)], "n long, o string") for o in ("old", "new"))
    assert {tuple(r) for r in Z.kept_on_error(old, new, rows(2), "n").collect()} == {(1, "new"), (2, "old")}
    assert {r.n for r in Z.pending(rows(1, 2), rows(2, 3), rows(1), "n").collect()} == {2, 3}


def test_two_unique_keys(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "n long, id long, t string")
    batch = spark.createDataFrame([(3, 20, "moved", ["id", "t"])], "n long, id long, t string, present array<string>")
    assert {tuple(r) for r in Z.upsert(old, batch, "n", ["id", "t"], "id").collect()} == {(1, 10, "a"), (3, 20, "moved")}


def test_snapshots(spark, tmp_path):
    store = B.Snapshots(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.pull()
    rows = spark.range(100).withColumn("x", F.lit("é"))
    first = store.publish({"items": rows})
    second = store.publish({"items": rows.where("id < 50")})
    assert store.pull()["items"].count() == 50 and store.verify(first)["items"]["rows"] == 100
    spark.range(3).withColumn("x", F.lit("z")).write.mode("append").parquet(f"{tmp_path}/s/{second}/items")
    with pytest.raises(ValueError, match="damaged"):
        store.pull()
    store.drop(first)
    with pytest.raises(ValueError):
        store.drop(second)


def test_canonical_lines_and_formats(spark):
    df = spark.createDataFrame([("r", 2, "é\"", None), ("r", 10, "b", 1.5)], "repo string, number long, title string, score double")
    lines = {r.number: r.line for r in B.lines(df, {}).collect()}
    assert lines[2] == '{"number":2,"repo":"r","score":null,"title":"\\u00e9\\""}'
    hashes = {B.corpus_hash(B.lines(df.repartition(n), {})).first()["hash"] for n in (1, 5)}
    assert len(hashes) == 1
    assert B.formatted(df.orderBy("number"), "jsonl", ["number", "score"]) == '{"number":2,"score":null}\n{"number":10,"score":1.5}'
    assert json.loads(B.formatted(df, "json")) and B.formatted(df.limit(1), "text", ["number"]) == "number=2"
    with pytest.raises(ValueError):
        B.formatted(df, "jsonl", ["nothing"])
    rows = spark.createDataFrame([("Acme/A", 1, 5), ("acme/a", 1, 7), ("x/y", 1, 1)], "repo string, number long, at long")
    assert {tuple(r) for r in B.folded(rows, "repo", ["number"], "at").collect()} == {("acme/a", 1, 7), ("x/y", 1, 1)} and B.duplicates(rows, "repo", ["number"]).count() == 1


def test_files_of_unknown_status_are_kept(spark):
    items = spark.createDataFrame([(1, "pr", 5)], "number long, kind string, merged_at long")
    files = spark.createDataFrame([(1, "a", 1, None), (1, "b", 1, "removed"), (1, "c", 1, "modified")], "number long, path string, additions long, status string")
    assert {r.path for r in merged_pr_files(Corpus(items, files, None, None, None)).collect()} == {"a", "c"}


def test_as_of_hides_comments_of_hidden_items(spark):
    items = spark.createDataFrame([(1, "open", "2024-01-01 00:00:00", None), (2, "open", "2024-03-01 00:00:00", None)], "number long, state string, created_at string, merged_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "merged_at")})
    child = spark.createDataFrame([(1, "x"), (2, "y")], "number long, body string")
    events = child.withColumn("created_at", F.lit("2024-01-02").cast("timestamp"))
    assert [r.number for r in Corpus(items, child, child, events, None).as_of("2024-02-01 00:00:00").comments.collect()] == [1]


def test_rows_hash_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "-"), ("a", "~")], "x string, y string")
    assert df.select(T.content_hash(F.col("x"), F.col("y")).alias("h")).distinct().count() == 5


def test_suffixes_both_ways(spark):
    paths = spark.createDataFrame([("src/a/x.py",), ("src/b/x.py",), ("lib/y.py",), ("z.py",)], "path string")
    refs = spark.createDataFrame([("x.py",), ("a/x.py",), ("src/b/x.py",), ("home/me/lib/y.py",), ("q/z.py",), ("none.py",)], "ref string")
    assert {r.ref: r.path for r in T.suffix_join(refs, paths).collect()} == {"a/x.py": "src/a/x.py", "src/b/x.py": "src/b/x.py", "home/me/lib/y.py": "lib/y.py", "q/z.py": "z.py"}


def test_closes_are_one_row_a_pair(spark):
    rows = [("r", "item", "1", "closes", "item", "2", e, s) for e, s in (("timeline closed event", "timeline"), ("closingIssuesReferences", "closing_ref"))] + [("r", "item", "3", "closes", "item", "2", "timeline closed event", "timeline")]
    got = {(r.src, r.source, r.evidence) for r in E.merged_closes(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in E.COLUMNS))).collect()}
    assert got == {("1", "closing_ref", "closingIssuesReferences; timeline closed event"), ("3", "timeline", "timeline closed event")}


def test_stage_one_by_hand(spark):
    """Demand 0.7, leverage 2/9, risk 0, priority 0.75 of features that were worked out by hand; and nothing known at all."""
    cols = "number long, reactions long, participants long, comments long, duplicates long, mentions long, blocking long, gap long, due long, reopens long, file_reverts long, type_weight double, label_weight double, field_weight double"
    rows = spark.createDataFrame([(1, 3, 3, 5, 0, 5, 1, 1, 10**12, 0, 0, None, 0.75, None), (2, None, None, None, None, None, None, None, None, None, None, None, None, None), (3, 9, 9, 9, 9, 99, 9, 9, 5, 9, 9, 2.0, -1.0, None)], cols)
    got = {r.number: (round(r.demand, 9), round(r.leverage, 9), r.risk, r.priority) for r in T3.stage1(rows, 1000).collect()}
    assert got == {1: (0.7, round(2 / 9, 9), 0.0, 0.75), 2: (0.0, 0.0, 0.0, 0.0), 3: (1.0, 1.0, 1.0, 0.5)}


def test_pages_join_up(spark):
    rows = spark.createDataFrame([(i, float(i % 4), []) for i in range(20)] + [(99, 9.0, ["blocked"])], "number long, total double, gates array<string>")
    whole = [(r.total, r.number) for r in T3.page(rows, 100)[0].collect()]
    seen, cursor = [], None
    while True:
        part = [(r.total, r.number) for r in T3.page(rows, 6, cursor)[0].collect()]
        if not part:
            break
        seen += part
        cursor = f"{part[-1][0]}:{part[-1][1]}"
    assert seen == whole and len(whole) == 20
    assert T3.page(rows, 3, "nonsense")[1] and T3.page(rows, 3, "nan:3")[1] and T3.page(rows, 50, include_gated=True)[0].collect()[-1].number == 99


def test_bundles():
    pair = lambda a, b, total, anchors=("structural",), title=0.0: {"a": a, "b": b, "total": total, "anchors": list(anchors), "title": title}
    pool = [U.Member(1, 5.0, frozenset("ab")), U.Member(2, 4.0, frozenset("bc"), blocked_by=frozenset({3})), U.Member(3, 3.0, frozenset("c")), U.Member(4, 2.9, frozenset("a")), U.Member(5, 2.0), U.Member(6, 9.0, blocked_by=frozenset({77})), U.Member(7, 1.0, blocked_by=frozenset({6}))]
    pairs = [pair(1, 2, 3.0), pair(1, 3, 2.0), pair(2, 3, 2.0), pair(1, 4, 9.0, ()), pair(4, 5, 1.5), pair(1, 5, 9.0), pair(6, 1, 9.0)]
    assert U.merge_candidates([*pairs, pair(8, 9, 0.0, (), 0.95)], {(1, 5)}) == [(1, 5), (8, 9)]
    found = U.grow(pool, pairs, [(1, 5)], set(), U.Rules(size=3, count=3))
    assert [b["members"] for b in found] == [[1, 3, 2]] and found[0]["files"] == ["a", "b", "c"] and found[0]["weakest"] == 2.0
    assert [b["members"] for b in U.grow(pool, pairs, [(1, 5)], {"a"}, U.Rules(size=3, count=3))] == [[1, 3, 2], [4, 5]]
    assert U.grow(pool, pairs, [], set(), U.Rules(size=3)) == U.grow(pool[::-1], pairs[::-1], [], set(), U.Rules(size=3))
    assert [b["members"] for b in U.grow(pool, pairs, [(1, 5)], set(), U.Rules(size=3, max_files=2))] == [[3, 2], [4, 5]]
    assert U.in_order([U.Member(1, 0, blocked_by=frozenset({2})), U.Member(2, 0, blocked_by=frozenset({1})), U.Member(3, 0)]) == [3, 1, 2]


def test_briefs_fit():
    item = {"number": 1, "body": "\n\n".join(f"para {i} " + "x" * 200 for i in range(40))}
    out = U.brief(item, [{"id": i, "body": "y" * 300} for i in range(9)], [{"number": i} for i in range(5)], budget_tokens=500)
    assert U.size_of(out) <= 2100 and out["shed"] == ["comments", "partners", "body"] and out["item"]["body"].startswith("para 0")
    assert U.brief({"number": 1, "body": "short"}, [], [])["shed"] == []
    assert U.shortened("z" * 100, 52) == "z" * 50 and U.shortened("é" * 10, 12) == "é" * 10


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "c", 2), (2, "d", 3)], "case long, answer string, rank int")
    truth = spark.createDataFrame([(1, "a"), (1, "z"), (2, "d"), (3, "q")], "case long, answer string")
    r = V.ranking(ranked, truth, 2).first()
    assert (r.cases, r.recall, r.precision, r.mrr, r.top1, r.top3, r.acc) == (3, round(0.5 / 3, 9), round(0.5 / 3, 9), round((1 + 1 / 3) / 3, 9), round(1 / 3, 9), round(2 / 3, 9), round(1 / 3, 9))
    sets = V.exact_sets(spark.createDataFrame([(1, "z"), (1, "a"), (2, "c")], "case long, answer string"), truth).first()
    assert tuple(sets) == (3, 1) and 0 < V.random_baseline(list("abcd"), {1: {"a"}}, 2, 5) < 1


def test_text_at_falls_back_to_the_live_text(spark):
    revisions = spark.createDataFrame([(1, 1, "first", 10, 20), (1, 2, "second", 20, 30), (2, 3, "old", 50, 60)], "number long, id long, content string, valid_from long, valid_to long")
    live = spark.createDataFrame([(1, "now 1"), (2, "now 2"), (3, "now 3")], "number long, content string")
    at = lambda t: {r.number: (r.content, r.origin) for r in I.text_at(revisions, live, t).collect()}
    assert at(15) == {1: ("first", "revision"), 2: (None, "unknown"), 3: (None, "unknown")} and at(30)[1] == ("now 1", "live") and at(60)[2] == ("now 2", "live")


def test_limits_and_kinds(spark):
    assert I.clamped(0) == 1 and I.clamped(1 << 40) == I.MOST
    with pytest.raises(ValueError):
        I.clamped(1 << 63)
    with pytest.raises(ValueError):
        I.listing(spark.range(1), None, None, kind="task")


def test_postings_are_read_by_word(spark, tmp_path):
    docs = spark.createDataFrame([("i1", 1, True, [("big red fox", 10.0), ("fox", 1.0)]), ("c5", 2, False, [("a red hen", 1.0)])], "doc string, number long, own boolean, fields array<struct<text:string,weight:double>>")
    S.write_postings(docs, str(tmp_path / "p"), 8)
    found, sizes = S.read_postings(spark, str(tmp_path / "p"), ["fox", "red"], 8)
    assert {(r.term, r.doc, r.tf, r["size"]) for r in found.collect()} == {("fox", "i1", 11.0, 4), ("red", "i1", 10.0, 4), ("red", "c5", 1.0, 3)} and tuple(sizes.first()) == (2, 3.5)
    items = spark.createDataFrame([(1, "big red fox", "fox", 5), (2, "hens", "", 9)], "number long, title string, body string, updated long")
    page, counts = S.search(items, found, sizes, "red fox", 10)
    assert [(r.number, r.mode, r.phrase) for r in page.collect()] == [(1, "all", True), (2, "any", False)] and tuple(counts.first()) == (1, 2)
    assert S.with_snippets(page, "red fox")[0]["snippet"] == "«fox»"


def test_tool_server(spark):
    import pyspark.sql.functions as SF

    from loomgraph.server import Server

    server = Server(spark, "x", {"numbers": lambda s, d: s.range(5).select("id", SF.lit(d).alias("folder")), "broken": lambda s, d: s.table("nowhere")})
    ask = lambda method, **params: json.loads(server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))
    assert ask("initialize", protocolVersion="2024-11-05")["result"]["protocolVersion"] == "2024-11-05" and ask("ping")["result"] == {}
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["broken", "numbers"]
    assert ask("tools/call", name="numbers", arguments={"limit": 2, "fields": ["id"]})["result"]["structuredContent"] == {"ok": True, "data": [{"id": 0}, {"id": 1}], "truncated": True}
    assert "did you mean numbers" in ask("tools/call", name="number")["error"]["message"] and ask("tools/call", name="broken")["result"]["isError"]
    assert ask("tools/call", name="numbers", arguments={"x": 1})["error"]["code"] == -32602 and ask("other")["error"]["code"] == -32601
    assert json.loads(server.handle("{"))["error"]["code"] == -32700 and json.loads(server.handle("[]"))["error"]["code"] == -32600
    assert server.handle('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None


def test_payload_signals(spark):
    from loomgraph.functions import payload as P

    raws = ['{"reactions": {"+1": 3}, "milestone": null, "pull_request": {"url": "x"}}', '{"milestone": {"due_on": "2024-01-01T00:00:00Z"}, "reactions": "odd"}', "{}", None, "junk"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = {r.i: r for r in df.select("i", P.item_kind(F.col("raw")).alias("kind"), P.signals(F.col("raw")).alias("s"), P.instant(F.get_json_object("raw", "$.milestone.due_on")).alias("due"), P.merged_signal(F.lit("old"), P.signal(F.col("raw"), "milestone", "$.milestone.due_on")).alias("m")).collect()}
    assert [got[i].kind for i in range(5)] == ["pr", "issue", "issue", "issue", "issue"]
    assert tuple(got[0].s.reactions) == (True, 3) and tuple(got[0].s.due) == (True, None) and tuple(got[1].s.reactions) == (True, None) and tuple(got[2].s.due) == (False, None) and tuple(got[4].s.reactions) == (False, None)
    assert [got[i].m for i in range(3)] == [None, "2024-01-01T00:00:00Z", "old"] and got[1].due is not None
    with pytest.raises(ValueError):
        P.strict_instant("2024-01-01T00:00:00")
    assert P.strict_instant("2024-01-01T00:00:00Z").year == 2024
    texts = spark.createDataFrame([("fine é", "cafÃ©"), ("bad �", None)], "a string, b string")
    assert {tuple(r) for r in P.garbled(texts, ["a", "b"]).collect()} == {("a", 2, 1), ("b", 2, 1)}
    state = spark.createDataFrame([("a", 90, True), ("b", None, True), ("c", 95, False)], "repo string, synced long, complete boolean")
    assert [(r.age_s, r.stale) for r in P.freshness(state, 100).orderBy("repo").collect()] == [(10, False), (None, True), (5, True)]
