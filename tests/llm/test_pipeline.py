import hashlib
import math
import random
import zlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from loomgraph.llm import bpe, queries, toxicity
from loomgraph.llm.shingles import WordHashes

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        now = docs.count()
        assert 0 < now <= before and (k == 4 or docs.columns == columns)
        before = now
        if k == 1:
            keys = [hashlib.sha256(r.text.encode().lower()).digest() for r in docs.select("text").collect()]
            assert len(keys) == len(set(keys))


@pytest.mark.parametrize("name", ["op1_mix_sources", "op10_exact_dedup"])
def test_native_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = c.execute(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))


def poured(children, budget):
    """children {name: (cap, weight)} -> {name: budget}: by weight, never over a cap, odd tokens by largest remainder, then name."""
    given, left, open_ = dict.fromkeys(children, 0), budget, {n for n, (_, w) in children.items() if w > 0}
    while full := [n for n in open_ if children[n][0] * sum(children[m][1] for m in open_) <= children[n][1] * left]:
        for n in full:
            given[n] = children[n][0]
            left -= given[n]
            open_.discard(n)
        if not open_:
            return given
    total = sum(children[n][1] for n in open_)
    for n in open_:
        given[n] = children[n][1] * left // total
    odd = left - sum(given[n] for n in open_)
    for n in sorted(open_, key=lambda n: (-(children[n][1] * left % total), n))[:odd]:
        given[n] += 1
    return given


def mixed(rows):
    """Ids of rows (id, text, lang, source) of which one epoch's mixture takes a token."""
    domain = lambda s: "web" if s == "src0" else "books" if len(s) == 4 else "forums"
    weight = lambda level, name: queries.WEIGHTS[level].get(name, 1)
    size = {i: len(t.split()) for i, t, _, _ in rows}
    leaf = {i: (domain(s), lang, s) for i, _, lang, s in rows}
    caps = lambda *at: sum(size[i] for i in size if leaf[i][: len(at)] == at)
    taken = set()
    budget = sum(size.values()) * queries.PIPELINE_PERCENT // 100
    for d, b1 in poured({d: (caps(d), weight("domain", d)) for d in {x[0] for x in leaf.values()}}, budget).items():
        for g, b2 in poured({g: (caps(d, g), weight("lang", g)) for g in {x[1] for x in leaf.values() if x[0] == d}}, b1).items():
            for s, b3 in poured({s: (caps(d, g, s), weight("source", s)) for s in {x[2] for x in leaf.values() if x[:2] == (d, g)}}, b2).items():
                own = [i for i in size if leaf[i] == (d, g, s)]
                epochs, tail = divmod(b3, max(1, caps(d, g, s)))
                for i in sorted(own, key=lambda i: (hashlib.md5(f"{queries.SEED}:{epochs}:{i}".encode()).hexdigest(), i)):
                    if (epochs or tail > 0) and size[i]:
                        taken.add(i)
                    tail -= size[i]
    return taken


def test_run_equals_brute_force(spark, tmp_path):
    r = random.Random(17)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for i in range(400):
        kind = r.random()
        if texts and kind < 0.15:
            t = r.choice(texts)[1].upper()
        elif texts and kind < 0.35:
            t = r.choice(texts)[1].split()
            t = " ".join([*t[: r.randrange(len(t) + 1)], *r.choices(words, k=r.randint(0, 2)), *t[len(t) - r.randrange(len(t) // 20 + 1) :]] or ["x"])
        else:
            t = " ".join(r.choices(words, k=r.choice((1, 4, 30, 80))))
        if i % 6 == 0:
            t += " vile scum filth"
        texts.append((i, t, r.choice(["en", "de", "fr"]), f"src{r.randrange(12)}", len(t)))
    labels = [(i, 1, int("scum" in t.lower())) for i, t, _, _, _ in texts if r.random() < 0.9]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    known = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1], "doc_id long, quality int, toxic int")
    weights = dict(toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), known))
    cache = WordHashes()
    score = lambda t: 1 / (1 + math.exp(-sum(weights.get(c, 0.0) for c in {*toxicity.features(t.encode(), cache).tolist(), 1 << toxicity.BITS})))
    rows = [x[:4] for x in texts if score(x[1]) < 0.7]
    assert {x[0] for x in texts if "scum" in x[1].lower()}.isdisjoint(x[0] for x in rows) and len(rows) > 250
    last = {}
    for i, t, _, _ in rows:
        last[t.lower()] = max(i, last.get(t.lower(), i))
    rows = [x for x in rows if last[x[1].lower()] == x[0]]
    sets = {}
    for i, t, _, _ in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((up[a], up[b]))
                up = {i: x if c == y else c for i, c in up.items()}
    before = len(rows)
    rows = [x for x in rows if up[x[0]] == x[0]]
    assert len(rows) < before
    taken = mixed(rows)
    assert 0 < len(taken) < len(rows)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.BPE_FILE)), special_tokens={})
    want = {i: (g, s, " ".join(map(str, own.encode_ordinary(t)))) for i, t, g, s in rows if i in taken}
    assert {i: (x.lang, x.source, x.ids) for i, x in got.items()} == want
    assert all(x.n_tokens == len(x.ids.split()) for x in got.values())
