"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and clashing names."""

import base64
import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from loomgraph.llm import bpe, components, embed_dedup, exact_dedup, license_scan, mixing, ngram_join, sentence_spans, toxicity, url_filter, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, e string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, ("en", "de", None)[i % 3], f"src{i % 4}", 0, "x", "y", "z") for i, t in texts], DOC)


def random_texts(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            base = (r.choice(out)[1] or "").split()
            for _ in range(r.randint(0, 3)):
                if base:
                    base[r.randrange(len(base))] = r.choice(words)
            out.append((i, " ".join(base)))
        else:
            out.append((i, " ".join(r.choices(words, k=r.choice((0, 1, 3, 20, 60, 150))))))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "É a b c"), (n + 4, "x " * 30_000)]


def roots(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(500, i) for i in range(501, 700)]
    got = dict(map(tuple, components.components(spark.createDataFrame([*links, (1, None)], "a long, b long")).collect()))
    want = roots({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}


def test_components_of_chains_and_hubs(spark):
    r = random.Random(5)
    own = list(range(1200))
    r.shuffle(own)
    links = [*itertools.pairwise(own[:400]), *((own[400], i) for i in own[401:700]), *((i, own[900]) for i in own[700:900]), (own[450], own[750]), *itertools.pairwise(sorted(own[1000:]))]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == roots({x for p in links for x in p}, links)


def test_components_plans_stay_short(spark, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 3) for i in range(40)], "a long, b long")
    links = links.join(spark.range(80).withColumn("a", F.col("id")), "a", "left_semi")
    assert components.components(links).count() == 60
    assert len(plans) > 2 and max(p.count("Join") for p in plans) == 1 and sum("LeftSemi" in line for p in plans for line in p.split("\n")) == 1


def test_exact_dedup(spark):
    texts = [(1, "Abc"), (2, "abc"), (3, "ÀBC"), (4, "àbc"), (5, None), (6, ""), (7, "only"), (7, "only"), (8, "z" * 100_000)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 2, True), (8, 8, 1, True)}
    kept = exact_dedup.drop_copies(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 7, 7, 8]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_of_many_copies(spark):
    rows = docs(spark, [(i, "same" if i % 3 else f"own {i}") for i in range(3000)])
    for bits in (1 << 15, 64):  # a filter too small lets unique rows through to the exact grouping
        got = exact_dedup.exact_dedup(rows, max_bits=bits)
        assert got.where("kept").count() == 1001 and got.agg(F.max("group_size")).first()[0] == 2000


@pytest.mark.parametrize("block", [3_000_000, 300])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HOT", 64 if block > 300 else 5)
    texts = random_texts(250)
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    ids = list(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, texts), 4, 85).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in ids}
    kept = ngram_join.one_of_each(docs(spark, texts), 4, 85)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in ids if want[i] == i)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0


def test_bpe(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello world's  end\n\n x", "naïve façade 😀👍🏽 日本語", "a" * 300, " \t\x1c\x85  ", "<|endoftext|>", "don't DON'T 123456 ...!!!", "\x00\x01", "abcabcabcabc " * 50, "Hello world's  end\n\n x"]
    rows = docs(spark, list(enumerate(texts))).withColumn("ids", F.lit("clash"))
    for hot in (10, 0):
        encoded = bpe.encode(rows, ranks, public_tokenizers.PATTERN, hot_words=hot)
        for r in bpe.decode(encoded, ranks).select("text", "ids", "decoded", bpe.n_ids(F.col("ids")).alias("n")).collect():
            want = own.encode_ordinary(r.text or "")
            assert r.ids == " ".join(map(str, want)) and r.n == len(want) and bytes(r.decoded) == (r.text or "").encode()


def test_mixing(spark):
    rows = docs(spark, [(i, "w " * (i % 9)) for i in range(200)] + [(900, None)])
    got = mixing.mix(rows, {"domain": {"src0": 1, "src1": 5}, "lang": {"de": 0}}, 50, 2, 3)
    sums = got.agg(F.sum("n_tokens").alias("all"), F.sum("tokens_taken").alias("taken")).first()
    assert got.count() == 201 and sums["taken"] == sums["all"] * 50 // 100
    assert got.where("lang = 'de'").agg(F.sum("tokens_taken")).first()[0] == 0
    assert got.where("tokens_taken > 2 * n_tokens or tail_tokens > n_tokens").count() == 0
    again = mixing.mix(rows, {"domain": {"src0": 1, "src1": 5}, "lang": {"de": 0}}, 50, 2, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    assert mixing.mix(docs(spark, []), {}).count() == 0


def test_mixing_gives_shortages_to_siblings_first(spark):
    rows = spark.createDataFrame([(1, "w " * 10, "en", "a1"), (2, "w " * 100, "en", "a2"), (3, "w " * 100, "en", "b1")], "doc_id long, text string, lang string, source string")
    got = {r.source: r.tokens_taken for r in mixing.mix(rows, {}, 50, 1, domain="substr(source, 1, 1)").collect()}
    assert got == {"a1": 10, "a2": 43, "b1": 52} or got == {"a1": 10, "a2": 42, "b1": 53}


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 5000, "WARC/1.1\r\n\r\nContent-Length: 3"]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i else None, h, "clash") for i, h in enumerate(html)], "page_id long, url string, html string, name string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    for i, h in enumerate(html):
        data = (h or "").encode()
        top = max(k for k, x in enumerate(html) if (x or "") == (h or ""))
        assert got[i] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if top == i else "revisit", None if top == i else top)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_embed_dedup(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((30, 16))
    vectors = [(base[i % 30] + r.standard_normal(16) * 0.05 * (i % 4)).tolist() for i in range(240)]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [1.0, 2.0]]
    rows = spark.createDataFrame([(i, v, 0, "clash") for i, v in enumerate([*vectors, *bad])], "vec_id long, embedding array<double>, label int, v string")
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = x @ x.T
    got = {r.vec_id: r for r in embed_dedup.embed_dedup(rows).collect()}
    want = roots(range(240), [(a, b) for a in range(240) for b in range(a + 1, 240) if sims[a, b] >= 0.9])
    degree = (sims >= 0.9).sum(1) - 1
    assert sum(got[i].n_links for i in range(240)) >= 0.9 * degree.sum() and all(got[i].n_links <= degree[i] for i in range(240))
    assert all(got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(240))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(240, 246))


def test_toxicity(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        own = r.choices(words, k=60)
        if bad:
            for w in r.sample(["vile", "scum", "filth"], 2):
                own.insert(r.randrange(60), w)
        texts.append((i, " ".join(own)))
        labels.append((i, 1, int(bad)))
    rows = docs(spark, [*texts, (5000, None), (5001, "")])
    got = {r.doc_id: r for r in toxicity.toxicity(rows, spark.createDataFrame([*labels, (7777, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert 200 < len(held) < 400
    assert np.mean([got[i].predicted == int(i % 5 == 0) for i in held]) > 0.97
    assert got[5000].predicted == got[5001].predicted == 0
    assert {r.score for r in toxicity.toxicity(rows, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.0}


def test_url_filter(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/")]
    urls = ["http://A.Example.com/en/71?q=/x", "http://example.com/en/8#f", "http://xexample.com/en/7", "https://a.net/de/1", "http://net/de/", "no url", None, "http://h?x/y", "http://a.org/en/1"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, score string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).orderBy("page_id").collect()]
    assert got == [("a.example.com", "/en/71", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("xexample.com", "/en/7", "com/en/", "block"), ("a.net", "/de/1", "net/de/", "allow"), ("net", "/de/", "net/de/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"), ("a.org", "/en/1", None, "allow")]


def test_url_models_tell_spam(spark):
    r = random.Random(2)
    syl = ["the", "ion", "ble", "ing", "er"]
    good = [f"http://{''.join(r.choices(syl, k=3))}.org/{r.randrange(999)}" for _ in range(600)]
    spam = [f"http://casino-{r.choice(['win', 'max', 'pro'])}{r.randrange(9)}.org/{r.randrange(999)}" for _ in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*good, *spam])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages, []).collect()}
    assert all(got[i] == "block" for i in range(600, 660)) and sum(got[i] == "block" for i in range(600)) <= 6


def test_url_scores_against_brute_force(spark):
    r = random.Random(3)
    urls = [f"http://{r.choice(['casino', 'news', 'näws', 'bet', 'blog'])}-{r.choice('abc')}.org/{r.randrange(40)}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, None, "x"])], "page_id long, url string, row string")
    host, path = url_filter.host_path(F.col("url"))
    text = url_filter._text(host, path)
    rows = pages.select("page_id", host.alias("h"), text.alias("t"), F.pmod(F.xxhash64(text), F.lit(10)).alias("fold")).collect()
    k = url_filter.ORDER + 1
    windows = lambda t: [t[i : i + k] for i in range(len(t) - k + 1)]
    counts = [Counter(w for x in rows if x.h and x.fold and bool({"casino", "bet"} & set(x.h.replace("-", ".").split("."))) == bad for w in windows(x.t)) for bad in (False, True)]
    runs = [dict(c) for c in counts]
    for n in range(k, 1, -1):
        for c in runs:
            for short, m in Counter(w[1:] for w in c if len(w) == n).items():
                c[short] = m
    alphabet = len({w[-1] for x in rows for w in windows(x.t)}) + 1

    def p(c, w):
        lower = p(c, w[1:]) if len(w) > 1 else 1 / alphabet
        follow = [n for v, n in c.items() if len(v) == len(w) and v[:-1] == w[:-1]]
        return (c.get(w, 0) + len(follow) * lower) / (sum(follow) + len(follow)) if follow else lower

    known = {w: math.log(p(runs[1], w) / p(runs[0], w)) for x in rows for w in windows(x.t)}
    got = {x.page_id: x.score for x in url_filter.url_filter(pages, []).collect()}
    assert len(got) == len(rows)
    for x in rows:
        assert abs(got[x.page_id] - sum(known[w] for w in windows(x.t)) / len(windows(x.t))) < 1e-6


def test_alignment_and_licenses(spark):
    r = random.Random(4)
    for _ in range(200):
        a, b = r.choices("abcdefgh", k=r.randrange(12)), r.choices("abcdefgh", k=r.randrange(12))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    filler = " ".join(f"z{i}" for i in range(300))
    texts = [(0, f"{filler}\nReleased under the MIT License.\n{filler}"), (1, "licensed UNDER the apache license , version 2.0"), (2, filler), (3, None), (4, ""), (5, "This work is licensed under the terms of GNU General Public License, version 3.")]
    got = {r.doc_id: r.license for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert got == {0: "MIT", 1: "Apache-2.0", 2: None, 3: None, 4: None, 5: "GPL-3.0"}


def test_sentence_spans(spark):
    passage = "Now this is a sentence of many words. And here comes another one of many words! Then a third, which is the last."
    texts = [(5, f"Alone here. {passage} The end of it."), (2, f"{passage}\nSomething else at the end."), (9, None), (10, ""), (11, "Short. Short."), (12, "Short. Short."), (13, "no end   \n")]
    got = {r.doc_id: r for r in sentence_spans.sentence_dedup(docs(spark, texts), least_words=12).collect()}
    assert got[2].text == texts[1][1] and got[2].n_removed == 0
    assert got[5].text == "Alone here. The end of it." and got[5].n_removed == 3 and got[5].words_removed == 23
    assert got[9].text is None and [got[i].text for i in (10, 11, 12, 13)] == ["", "Short. Short.", "Short. Short.", "no end   \n"]
    for i, t in texts:
        if t:
            assert b"".join(sentence_spans.sentences(t.encode())) == t.encode()


def test_sentence_spans_of_short_sentences(spark):
    short = " ".join(f"Line {i} is here." for i in range(15))  # 60 words in sentences of 4
    lines = "\n".join(f"row {i}" for i in range(9))  # every end must be reached too: 18 words in lines of 2
    mixed = "One long sentence that holds more than twelve words all by itself, as you see. Yes. No."
    texts = [(1, short), (2, f"First of all. {short} And so on."), (3, lines), (4, f"head\n{lines}\ntail"), (5, mixed), (6, f"Ahead of it. {mixed} Behind it."), (7, "A b. C d."), (8, "A b. C d.")]
    got = {r.doc_id: (r.text, r.n_removed, r.words_removed) for r in sentence_spans.sentence_dedup(docs(spark, texts), least_words=12).collect()}
    assert all(got[i] == (t, 0, 0) for i, t in texts if i in (1, 3, 5, 7, 8))
    assert got[2] == ("First of all. And so on.", 15, 60)
    assert got[4] == ("head\ntail", 9, 18)
    assert got[6] == ("Ahead of it. Behind it.", 3, 17)


def test_embed_dedup_counts_all_links_of_a_dense_group(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.standard_normal(16) + r.standard_normal((600, 16)) * 0.2, r.standard_normal((200, 16))])
    x = np.concatenate([x, x[:3]])  # copies count in their partners' links
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    degree = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embed_dedup.embed_dedup(rows, window=8).collect()}
    assert degree.max() > 2 * 8 * embed_dedup.PASSES
    assert [got[i] for i in range(len(x))] == degree.tolist()


def test_two_licenses_of_a_text(spark):
    texts = [(0, "Licensed under CC BY-NC 4.0. And more words. Released under the MIT License."), (1, "nothing"), (2, None)]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert {m.license for m in got[0].matches} >= {"CC-BY-NC-4.0", "MIT"} and got[0].license in ("CC-BY-NC-4.0", "MIT") and got[0].coverage == 1.0
    assert got[1].matches == [] and got[2].matches == [] and got[1].license is None
