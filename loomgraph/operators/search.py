"""Ranked search over items and their comments from one postings table.

postings() is written once and laid out by term (write_postings); a query reads the rows of its own words. A document is an
item (title, body, labels, paths, each with its weight) or a comment; documents of an item are merged. Rank: rows with every word
of the query, then (broadened) rows with any word that matters; within each, items whose own text matches before those whose comments do,
then the whole phrase, BM25, the latest update, the number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import snippet

#: Weights of the fields, constants of BM25, words that a broadened query leaves out.
WEIGHTS = {"title": 10.0, "body": 1.0, "labels": 3.0, "paths": 0.5}
K1, B = 1.2, 0.75
STOPWORDS = frozenset("a an and are as at be been being but by for from has have had he her his i in is it its of on or she that the their them then there these they this those to was were what when where which who will with you your".split())


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def parse(query: str) -> tuple[list[str], list[str]]:
    """The words of a query, and those that a broadened one keeps (all, if none or the only one matters)."""
    words = list(dict.fromkeys(w for part in query.lower().split() for w in _words(part)))
    content = [w for w in words if w not in STOPWORDS]
    return words, content or words


def _words(part: str) -> list[str]:
    out, word = [], ""
    for c in part + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def documents(items: DataFrame, labels: DataFrame, files: DataFrame, comments: DataFrame) -> DataFrame:
    """(doc, number, own, fields): a row for each item and comment; fields are (text, weight)."""
    named = labels.groupBy("number").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("labels"))
    touched = files.groupBy("number").agg(F.array_join(F.array_sort(F.collect_set("path")), " ").alias("paths"))
    field = lambda c, w: F.struct(F.coalesce(F.col(c), F.lit("")).alias("text"), F.lit(w).alias("weight"))
    own = items.join(named, "number", "left").join(touched, "number", "left")
    own = own.select(F.concat(F.lit("i"), "number").alias("doc"), "number", F.lit(True).alias("own"), F.array(*[field(c, w) for c, w in WEIGHTS.items()]).alias("fields"))
    said = comments.select(F.concat(F.lit("c"), "comment_id").alias("doc"), "number", F.lit(False).alias("own"), F.array(field("body", 1.0)).alias("fields"))
    return own.unionByName(said)


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc, number, own, tf, size): weighted frequency of each term of a document, and the document's size in words."""
    sized = docs.select("doc", "number", "own", F.transform("fields", lambda f: F.struct(tokens(f["text"]).alias("words"), f["weight"].alias("weight"))).alias("f"))
    sized = sized.withColumn("size", F.aggregate("f", F.lit(0).cast("long"), lambda a, f: a + F.size(f["words"])))
    words = sized.select("doc", "number", "own", "size", F.explode(F.flatten(F.transform("f", lambda f: F.transform(f["words"], lambda w: F.struct(w.alias("term"), f["weight"].alias("weight")))))).alias("w"))
    return words.groupBy(F.col("w.term").alias("term"), "doc", "number", "own", "size").agg(F.sum("w.weight").alias("tf"))


def write_postings(docs: DataFrame, folder: str, buckets: int = 64) -> None:
    """Postings laid out by term: a query prunes to its words' buckets, and to their pages within."""
    found = postings(docs).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    found.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    docs.agg(F.count("*").alias("docs"), F.avg(F.aggregate("fields", F.lit(0).cast("long"), lambda a, f: a + F.size(tokens(f["text"])))).alias("mean")).write.mode("overwrite").parquet(f"{folder}/sizes")


def read_postings(spark: SparkSession, folder: str, words: list[str], buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """(postings of these words, sizes)."""
    rows = spark.read.parquet(f"{folder}/postings")
    wanted = [r[0] for r in spark.createDataFrame([(w,) for w in words], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).collect()]
    return rows.where(F.col("bucket").isin(wanted) & F.col("term").isin(words)).drop("bucket"), spark.read.parquet(f"{folder}/sizes")


def hits(found: DataFrame, sizes: DataFrame, words: list[str]) -> DataFrame:
    """Documents that hold any of the words: doc, number, own, words (how many), score. found: postings; sizes(docs, mean)."""
    df = found.where(F.col("term").isin(words)).groupBy("term").agg(F.countDistinct("doc").alias("df"))  # a row for each word
    scored = found.where(F.col("term").isin(words)).join(F.broadcast(df), "term").crossJoin(F.broadcast(sizes))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return scored.groupBy("doc", "number", "own").agg(F.count("*").alias("words"), F.sum(part).alias("score"))


def phrase_hits(items: DataFrame, words: list[str]) -> DataFrame:
    """Items whose title or body holds the words side by side."""
    phrase = F.lit(" " + " ".join(words) + " ")
    holds = lambda c: F.contains(F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" ")), phrase)
    some = reduce(lambda a, w: a & F.lower(F.concat_ws(" ", "title", "body")).contains(w), words, F.lit(True))
    return items.where(some).where(holds("title") | holds("body")).select("number").withColumn("phrase", F.lit(True))


def search(items: DataFrame, found: DataFrame, sizes: DataFrame, query: str, limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page (number, mode, in_item, phrase, comment_hits, score, rank) and the counts (strict, total), which don't depend on the page."""
    words, content = parse(query)
    docs = hits(found, sizes, words)
    keep = docs.where(F.col("words") == len(words)).withColumn("strict", F.lit(True))
    if content != words or len(words) > 1:
        broad = hits(found, sizes, content)
        keep = keep.unionByName(broad.withColumn("strict", F.lit(False)))
    # what any document has in full outranks all that only has some: of both passes an item's better one counts
    merged = keep.groupBy("number", "strict").agg(F.max("score").alias("score"), F.max("own").alias("in_item"), F.count_if(~F.col("own")).alias("comment_hits"))
    passes = merged.where("strict").unionByName(merged.where("not strict").join(merged.where("strict").select("number"), "number", "left_anti"))
    counts = passes.agg(F.count_if("strict").alias("strict"), F.count("*").alias("total"))
    rows = passes.join(items.select("number", "title", "body", "updated"), "number")
    rows = rows.join(phrase_hits(items, content), "number", "left").withColumn("phrase", F.coalesce("phrase", F.lit(False)) & F.col("in_item"))
    order = [F.desc("strict"), F.desc("in_item"), F.desc("phrase"), F.desc(F.round("score", 9)), F.desc("updated"), F.asc("number")]
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.select("number", F.when(F.col("strict"), "all").otherwise("any").alias("mode"), "in_item", "phrase", "comment_hits", F.round("score", 6).alias("score"), "title", "body"), counts


def with_snippets(page: DataFrame, query: str) -> list[dict]:
    """The rows of a page (which its limit bounds) with a marked excerpt of the body, else of the title."""
    words = parse(query)[0]
    return [r.asDict() | {"snippet": snippet(r["body"] or r["title"] or "", words)} for r in page.collect()]
