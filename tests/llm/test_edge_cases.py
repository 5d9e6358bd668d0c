"""Clashing names by value, nulls, repeats, empty tables, long words, and brute force where SQL can't say it."""

import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomgraph.llm import bpe, embed_dedup, exact_dedup, license_scan, mixing, ngram_join, sentence_spans, toxicity, url_filter, warc
from loomgraph.llm.shingles import WordHashes

from test_operators import roots

#: Names that operators use inside, as users' columns.
CLASH = ["key", "maybe", "own", "id", "group", "keep_id", "lost", "places", "all", "gone", "g", "ids_", "_g", "_id", "_gone", "_all", "_starts", "_score", "score", "bucket", "bitmap", "_b0", "_m0", "a.b", "a`b", "stretch"]


def clashing(spark, texts):
    rows = [(i, t, ("en", "de")[i % 2], f"src{i % 3}", *[f"{c}-{k}" for c in CLASH]) for k, (i, t) in enumerate(texts)]
    names = ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASH)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {names}")


PASSAGE = " ".join(f"Here is sentence number {i} of the passage that repeats." for i in range(8))
TEXTS = [(1, "Same text here"), (2, "same TEXT here"), (3, f"{PASSAGE} One more."), (4, f"Ahead of it. {PASSAGE}"), (5, " ".join(f"w{i}" for i in range(60))), (6, " ".join(f"w{i}" for i in range(61))), (7, "vile scum"), (8, "x"), (9, "y z")]


def test_users_columns_keep_their_values(spark):
    rows = clashing(spark, TEXTS)
    before = {r.doc_id: r for r in rows.collect()}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, toxic int")
    mixed = mixing.mix(rows, {"source": {"src0": 0}}, 80, 1, 3)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(rows, ranks, public_tokenizers.PATTERN)
    found = {
        "drop_copies": exact_dedup.drop_copies(rows),
        "reject": toxicity.reject(rows, labels),
        "sentence_dedup": sentence_spans.sentence_dedup(rows),
        "one_of_each": ngram_join.one_of_each(rows),
        "take": mixing.take(rows, mixed),
        "encode": encoded,
        "decode": bpe.decode(encoded, ranks),
    }
    kept = {}
    for name, out in found.items():
        assert out.columns[: len(rows.columns)] == rows.columns, name
        kept[name] = {r.doc_id: r for r in out.collect()}
        for i, r in kept[name].items():
            assert all(r[k] == before[i][k] for k in range(len(rows.columns)) if rows.columns[k] != "text"), name
            assert r.text == before[i].text or (name == "sentence_dedup" and i == 4), name
    assert set(kept["drop_copies"]) == set(before) - {1} and set(kept["one_of_each"]) == set(before) - {2, 4, 6}
    assert kept["sentence_dedup"][4].text == "Ahead of it. " and set(kept["take"]) and {r.source for r in kept["take"].values()} == {"src1", "src2"}


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "Same text"), (None, "same text"), (1, "other"), (None, "Other"), (None, None)], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    assert exact_dedup.drop_copies(rows).count() == 4 and exact_dedup.exact_dedup(rows).count() == 5
    assert ngram_join.one_of_each(rows).count() == 5 and sentence_spans.sentence_dedup(rows).count() == 5
    assert mixing.take(rows, mixing.mix(rows, {}, 100, 1)).count() == 5
    pages = spark.createDataFrame([(None, "u", "abc"), (3, "u", "abc"), (None, None, "x"), (None, "u", "x")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in warc.round_trip(pages).collect()) == [("3", "response", "None", 3), ("None", "response", "None", 1), ("None", "response", "None", 1), ("None", "revisit", "3", 3)]
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.01])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embed_dedup.embed_dedup(vectors).collect()), key=str) == [(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]


def test_repeated_ids(spark):
    rows = clashing(spark, [(1, "a b c d e"), (1, "a b c d e"), (1, "other words"), (2, "A b c d e"), (3, "own text of it")])
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(rows).collect()) == [(1, 1, 1), (1, 2, 3), (1, 2, 3), (2, 2, 3), (3, 3, 1)]
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(rows).collect()} == {1: 1, 2: 1, 3: 3}
    mixed = mixing.mix(rows, {}, 50, 2)
    assert mixed.count() == 5 and mixed.agg(F.sum("tokens_taken")).first()[0] == 10
    pages = spark.createDataFrame([(1, "u", "abc"), (1, "v", "abc"), (1, "w", "d"), (0, "x", "abc")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()) == [(0, "x", "revisit", 1), (1, "u", "response", None), (1, "v", "response", None), (1, "w", "response", None)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [sorted(map(tuple, embed_dedup.embed_dedup(vectors.repartition(k)).collect())) for k in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 4
    urls = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x")], "page_id long, url string")
    assert url_filter.url_filter(urls, []).count() == 2
    assert license_scan.license_scan(clashing(spark, [(1, "Released under the MIT License.")] * 2)).where("license = 'MIT'").count() == 2


def test_empty_tables(spark):
    rows = clashing(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    outs = [exact_dedup.drop_copies(rows), toxicity.toxicity(rows, labels), toxicity.reject(rows, labels), sentence_spans.sentence_dedup(rows), ngram_join.one_of_each(rows), mixing.take(rows, mixing.mix(rows, {})), bpe.decode(bpe.encode(rows, ranks, public_tokenizers.PATTERN), ranks), license_scan.license_scan(rows)]
    outs.append(url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), []))
    outs.append(embed_dedup.embed_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")))
    outs.append(warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")))
    assert [o.count() for o in outs] == [0] * len(outs)


def test_long_words_are_folded_in_time(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    blobs = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH", k=100_000)), "a" * 30_000, "é" * 500, "=" * 5_000, "".join(r.choices("аб日éß", k=4_000)), "x" * 64, "y" * 65]
    for blob in blobs[1:]:
        assert bpe.fold_long(blob.encode(), ranks) == own.encode_ordinary(blob) or len(re.findall(r"\w+|[^\w]+", blob)) > 1
    rows = clashing(spark, list(enumerate([*blobs, f"before {blobs[0]} after"])))
    began = time.time()
    for row in bpe.encode(rows, ranks, public_tokenizers.PATTERN).select("text", "ids").collect():
        assert row.ids == " ".join(map(str, own.encode_ordinary(row.text)))
    assert time.time() - began < 60


def scalar_ftrl(rows, labels, times, alpha, beta, l1, l2, bias):
    """FTRL-proximal by its definition, a coordinate at a time."""
    z, n = Counter(), Counter()

    def weight(i):
        least = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= least else -(z[i] - (1 if z[i] > 0 else -1) * least) / ((beta + n[i] ** 0.5) / alpha + l2)

    for x, y in zip(rows, labels, strict=True):
        own = {i: weight(i) for i in x}
        p = 1 / (1 + np.exp(-sum(own.values())))
        g = (p - y) * (times if y else 1.0)
        for i, w in own.items():
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w
            n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_its_scalar_form():
    r = random.Random(8)
    bias = 1 << toxicity.BITS
    rows = [sorted(r.sample(range(50), r.randint(0, 12))) + [bias] for _ in range(400)]
    labels = [int(3 in x or r.random() < 0.1) for x in rows]
    model = toxicity.Ftrl(alpha=0.7, beta=1.5, l1=2.0, l2=0.3)
    for x, y in zip(rows, labels, strict=True):
        model.learn(np.array(x), y, 3.0 if y else 1.0)
    want = scalar_ftrl(rows, labels, 3.0, 0.7, 1.5, 2.0, 0.3, bias)
    got = model.weights(np.arange(bias + 1))
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items()) and np.count_nonzero(got) == sum(w != 0 for w in want.values()) > 3


def test_features_are_ngrams_and_skipgrams():
    known = WordHashes()
    one = lambda t: set(toxicity.features(t, known).tolist())
    assert len(one(b"a b c")) == 6 and one(b"A b") < one(b"a b c") and one(b"a x c") & one(b"a y c") > one(b"a") and one(None) == one(b" ") == set()


def test_the_fit_holds_a_bounded_sample():
    import pyarrow as pa

    xs = [np.arange(k % 7 + 1, dtype=np.int32) for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([x.tolist() for x in xs], pa.list_(pa.int32())), pa.array([k % 2 for k in range(100)], pa.int32())], ["h", "x", "y"])
    whole, part = (next(toxicity._fit(2, most)(iter([batch]))) for most in (10**6, 30))
    again = next(toxicity._fit(2, 30)(iter([batch.slice(0, 50), batch.slice(50)])))
    assert part.equals(again) and whole.num_columns == 2


def naive_patience(a, b):
    """Patience alignment from its definition: equal ends, unique anchors, longest increasing run of them, gaps alike."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + naive_patience(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + naive_patience(a[:-1], b[:-1])
    marks = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    runs = [[m] for m in marks]
    for k, (_, j) in enumerate(marks):
        before = [runs[h] for h in range(k) if marks[h][1] < j]
        if before:
            runs[k] = max(before, key=len) + [marks[k]]
    if not runs:
        return 0
    best = max(map(len, runs))
    ends = {tuple(x) for x in runs if len(x) == best}
    totals = set()
    for run in ends:
        cuts = [(-1, -1), *run, (len(a), len(b))]
        totals.add(best + sum(naive_patience(a[i + 1 : k], b[j + 1 : m]) for (i, j), (k, m) in zip(cuts, cuts[1:], strict=False)))
    return totals if len(ends) > 1 else totals.pop()


def test_alignment_equals_patience_by_definition():
    r = random.Random(12)
    checked = 0
    for _ in range(400):
        b = r.sample("abcdefghijkl", r.randint(3, 10)) + r.choices("xyz", k=r.randint(0, 3))
        a = [w for w in b if r.random() < 0.8]
        for _ in range(r.randint(0, 4)):
            a.insert(r.randint(0, len(a)), r.choice("abcxyzpq"))
        try:
            want = naive_patience(a, b)
        except TypeError:  # ties between runs below: either is a patience alignment
            continue
        if isinstance(want, int):
            checked += 1
            assert len(license_scan.align(a, b)) == want, (a, b)
    assert checked > 200


def test_scan_finds_what_aligning_everywhere_finds():
    r = random.Random(13)
    templates = {"T1": " ".join(f"t{i}" for i in range(20)) + " the of and", "T2": "alpha beta gamma delta epsilon", "T3": " ".join(f"t{i}" for i in range(5, 30))}
    scanner = license_scan.Scanner(templates)
    hits = 0
    for _ in range(150):
        words = [r.choice(["the", "of", "z1", "z2", "alpha", "t3", "t9"]) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            t = license_scan.words_of(r.choice(list(templates.values())))
            t = [w for w in t if r.random() < 0.93]
            for _ in range(r.choice((0, 0, 2, 8))):
                t.insert(r.randint(0, len(t)), r.choice(["z3", "the"]))
            at = r.randint(0, len(words))
            words[at:at] = t
        got = {name: cov for name, cov, _, _ in scanner.scan(" ".join(words))[0]}
        best = {}
        for (name, template), rare in zip(scanner.templates, scanner.rare, strict=True):
            n = len(template)
            places = [(0, len(words)), *((max(0, i - n), min(len(words), i + 2 * n)) for i, w in enumerate(words) if w in rare)]
            cov = max(len(license_scan.align(words[lo:hi], template)) / n for lo, hi in places) if words else 0.0
            if cov >= 0.8:
                best[name] = cov
        assert got.items() <= best.items()
        dropped = set(best) - set(got)
        assert all(any(c > best[d] for c in got.values()) for d in dropped)
        hits += len(got)
    assert hits > 100


def test_long_insertions_and_bodies(spark):
    mit = license_scan.TEMPLATES["MIT-body"]
    half = len(mit) // 2
    cut = mit.rfind(" ", 0, half)
    texts = [(0, mit[:cut] + " " + " ".join(f"z{i}" for i in range(2000)) + mit[cut:]), (1, mit + " " + mit), (2, license_scan.TEMPLATES["BSD-3-Clause"]), (3, license_scan.TEMPLATES["LGPL-header"])]
    got = {r.doc_id: (r.license, r.coverage) for r in license_scan.license_scan(clashing(spark, texts)).collect()}
    assert got == {0: ("MIT-body", 1.0), 1: ("MIT-body", 1.0), 2: ("BSD-3-Clause", 1.0), 3: ("LGPL-header", 1.0)}


def spans_by_force(texts, run, least):
    """Which sentences go: those of shortest runs, from every start and to every end, that stood at an earlier (id, place)."""
    pattern = re.compile(r"\s*\S.*?(?:[.!?]+(?=\s|$)|(?=\n)|$)\s*", re.S)
    split, first, later = {}, {}, []
    for i, t in texts:
        s = split[i] = pattern.findall(t or "")
        plain = [" ".join(x.lower().split()) for x in s]
        words = [len(x.split()) for x in plain]
        places = set()
        for k in range(len(s)):
            for ahead in (True, False):
                n = 0
                while (k + n < len(s) if ahead else k - n >= 0) and (n < run or sum(words[k : k + n] if ahead else words[k - n + 1 : k + 1]) < least):
                    n += 1
                part = (k, k + n) if ahead else (k - n + 1, k + 1)
                if part[0] >= 0 and part[1] <= len(s) and n >= run and sum(words[part[0] : part[1]]) >= least:
                    places.add(part)
        for lo, hi in sorted(places):
            key = tuple(plain[lo:hi])
            later.append((key, (i, lo, hi)))
            first[key] = min(first.get(key, (i, lo, hi)), (i, lo, hi))
    gone = {i: set() for i, _ in texts}
    for key, (i, lo, hi) in later:
        if first[key] != (i, lo, hi):
            gone[i] |= set(range(lo, hi))
    return {i: (t if not gone[i] else "".join(s for k, s in enumerate(split[i]) if k not in gone[i]), len(gone[i])) for i, t in texts}


@pytest.mark.parametrize("run, least", [(2, 30), (2, 12), (3, 8)])
def test_sentence_spans_against_brute_force(spark, run, least):
    r = random.Random(least)
    known = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "eps"], k=r.randint(1, 9))) + r.choice([".", "!", "?", "\n"]) for _ in range(40)]
    texts = [(i, " ".join(known[(j := r.randrange(40)) : j + r.randint(1, 9)]) + " " + " ".join(r.choices(known, k=r.randint(0, 6)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, " \n "), (203, texts[0][1]), (204, "one. " * 3000)]
    got = {x.doc_id: (x.text, x.n_removed) for x in sentence_spans.sentence_dedup(clashing(spark, texts), run, least).collect()}
    want = spans_by_force(texts, run, least)
    assert got == want and sum(n for _, n in want.values()) > 100


def test_a_passage_goes_and_a_common_line_stays(spark):
    passage = " ".join(f"Sentence number {i} of a passage with some words." for i in range(6))  # 54 words
    line = "Subscribe to our letter now. It is free of charge. See you soon."
    texts = [(1, f"{line} First text. {passage} Its end."), (2, f"Second text begins and {passage} so it ends. {line}"), (3, line)]
    got = {r.doc_id: (r.text, r.n_removed) for r in sentence_spans.sentence_dedup(clashing(spark, texts)).collect()}
    assert got[1] == (texts[0][1], 0) and got[3] == (line, 0)
    assert got[2][1] == 5 and line in got[2][0]


def test_windows_run_across_partitions(spark):
    """The pairs of the passes join what those of one sorted list join, whatever the partitions."""
    r = np.random.default_rng(3)
    x = (r.standard_normal((12, 8))[r.integers(0, 12, 300)] + 0.25 * r.standard_normal((300, 8))).astype(np.float32)
    reps = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<float>")
    keyed = embed_dedup._keyed(reps, range(3))
    keys = sorted(map(tuple, keyed.collect()))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    window, span = 20, 24
    want = set()
    for k, (p, _, i) in enumerate(keys):
        for q, _, j in keys[k + 1 : k + 1 + window]:
            if p == q and u[i] @ u[j] >= 0.9:
                want.add((min(i, j), max(i, j)))
    spark.conf.set("spark.sql.shuffle.partitions", "64")  # fewer rows a partition than a window has
    try:
        found = embed_dedup._close(embed_dedup._stretches(keyed, span, window).join(reps, "id"), 0.9, span, window)
        got = [tuple(p) for p in found.collect()]
        assert roots(range(300), got) == roots(range(300), want) and len(want) > 100 and len(got) < 3 * 300 * 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_plain_splitting_equals_the_pattern():
    import regex

    plain = re.compile(bpe.latin(public_tokenizers.PATTERN)).findall
    whole = regex.compile(public_tokenizers.PATTERN).findall
    r = random.Random(4)
    chars = [chr(i) for i in range(256)] + list(" \n\t'stredvml'") * 12
    for _ in range(3000):
        text = "".join(r.choices(chars, k=r.randint(0, 40)))
        assert plain(text) == whole(text) == bpe.splitter(public_tokenizers.PATTERN)(text)
    assert bpe.latin(r"(?i:x)|\w") is None and bpe.splitter(r"\w+")("a b") == ["a", "b"]
    assert bpe.splitter(public_tokenizers.PATTERN)("œuvre 日本 x") == whole("œuvre 日本 x")


def test_the_table_is_read_as_it_was_written(spark, tmp_path):
    words = [" a", "", "été", "x\ny", "日本"] * 1000
    rows = spark.createDataFrame([(f"{w}{i}", str(i)) for i, w in enumerate(words)], "word string, ids string")
    rows.repartition(3).write.parquet(f"{tmp_path}/t")
    assert bpe._table(f"file:{tmp_path}/t") == {f"{w}{i}": str(i) for i, w in enumerate(words)}
