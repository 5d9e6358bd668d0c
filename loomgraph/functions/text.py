"""Text functions: tokens, closing numbers, path suffixes, ranked search, row hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are no terms.
STOPWORDS = "the and for with this that from into have has not are was were but you your their there then when what which will would can could should may might issue pull request merge merged close closed fix fixed bug error file test tests".split()
#: Fixed values of BM25.
K1, B = 1.2, 0.75
#: Fixed pattern: a closing keyword before a reference of at most ten digits: `#n`, `this #n`, `owner/name#n`, or a link.
CLOSES = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?):?\s+(?:this\s+)?(?:[\w.-]+/[\w.-]+#|#|https?://github\.com/[\w.-]+/[\w.-]+/(?:issues|pull)/)(\d{1,10})\b"


def terms(text: Column) -> Column:
    """Distinct lower-case ASCII words of three or more characters that are no stopwords."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)))


def term_weights(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf) over all texts; idf = ln(1 + N / df)."""
    total = docs.agg(F.count("*").alias("total"))
    df = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("term", "df", F.round(F.log(1 + F.col("total") / F.col("df")), 9).alias("idf"))


def _is(word: str):
    return lambda x: x == word


def search(docs: DataFrame, query: list[str], limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """BM25: rows with all words first, then rows with any; ties by key. Only the query's words leave the scan."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    rows = docs.select(F.col(key).alias("key"), words.alias("w")).select("key", F.size("w").alias("len"), *[F.size(F.filter("w", _is(q))).alias(f"tf{i}") for i, q in enumerate(query)])
    stats = rows.agg(F.count("*").alias("total"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    rows = rows.where(" or ".join(f"tf{i} > 0" for i in range(len(query)))).join(F.broadcast(stats))
    idf = lambda i: F.log(1 + (F.col("total") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    tf = lambda i: F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    score = sum((idf(i) * tf(i) for i in range(1, len(query))), idf(0) * tf(0))
    strict = F.when(F.expr(" and ".join(f"tf{i} > 0" for i in range(len(query)))), 1).otherwise(0)
    return rows.select("key", strict.alias("strict"), F.round(score, 6).alias("score")).orderBy(F.desc("strict"), F.desc("score"), "key").limit(limit)


def closing_numbers(text: Column) -> Column:
    """Numbers that a text closes, in order, whatever repository they are of (extract.references knows its own)."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLOSES), F.lit(1)), lambda x: x.cast("long"))


def branch_tokens(name: Column) -> Column:
    """Digit runs of a branch name that don't stand within a word."""
    return F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"(?<![A-Za-z0-9])(\d+)(?![A-Za-z0-9])"), F.lit(1))


def suffix_join(refs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """refs(ref) resolved to vocabulary(path): the path itself, else the only path that ends in /ref, else the only path that ref ends in."""
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    index = vocabulary.select("path", F.explode(tails(F.col("path"))).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"), F.min("path").alias("only"), F.max(F.when(F.col("path") == F.col("ref"), F.col("path"))).alias("exact"))
    asked = refs.distinct()
    forward = asked.join(index, "ref").select("ref", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("path")).where("path is not null")
    longer = asked.join(forward.select("ref"), "ref", "left_anti").select("ref", F.explode(tails(F.col("ref"))).alias("path")).where("path <> ref")
    back = longer.join(vocabulary.select("path").distinct(), "path", "left_semi").groupBy("ref").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("ref", "path")
    return forward.unionByName(back)


def content_hash(*cols: Column) -> Column:
    """A digest of a row: each value behind its length, null as a length of none, so that no two rows read alike."""
    cells = [F.coalesce(F.concat(F.char_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws("|", *cells), 256)
