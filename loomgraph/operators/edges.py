"""Typed edges from what is stored: texts, payloads, commits, links, timelines, branch names, titles.

Every edge is (repo, src_type, src, rel, dst_type, dst, evidence, source); ends are strings, an item of another repository is
`owner/name#n`. The rules that join items (merge commits, reverts, branch names) are equi-joins over the whole corpus, so they
don't depend on the order in which items arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from .reads import merged_evidence

COLUMNS = ("repo", "src_type", "src", "rel", "dst_type", "dst", "evidence", "source")
#: Relations that a path may use.
STRUCTURAL = ("closes", "closes_keyword", "mentions", "duplicate_keyword", "duplicate_of", "cross_referenced", "blocked_by", "child_of", "linked_pr", "touches", "branch_ref", "reverts", "merged_commit", "closed_by_commit")


def row(df: DataFrame, src_type: str, src: Column, rel, dst_type: str, dst: Column, evidence: Column, source: str) -> DataFrame:
    rel = F.lit(rel) if isinstance(rel, str) else rel
    values = (F.col("repo"), F.lit(src_type), src.cast("string"), rel, F.lit(dst_type), dst.cast("string"), evidence, F.lit(source))
    return df.select(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)])


def marked_references(texts: DataFrame, *more: str) -> DataFrame:
    """texts(repo, number, part, rank, text, more) -> (.., kind, ref, at) for every text and number it refers to."""
    marked = texts.where(F.col("text").contains("#") | F.lower("text").contains("http"))
    found = marked.select("repo", "number", "part", "rank", *more, F.explode(X.references(F.col("text"), F.col("repo"))).alias("r"))
    return found.select("repo", "number", "part", "rank", *more, F.col("r.kind").alias("kind"), F.col("r.number").alias("ref"), F.col("r.at").alias("at"))


def text_references(texts: DataFrame) -> DataFrame:
    """texts(repo, number, part, rank, text) -> (.., kind, ref, part, at): of every kind and number the first place, by rank and offset.

    Only texts that hold a `#` or a link leave the JVM.
    """
    first = marked_references(texts).groupBy("repo", "number", "kind", "ref").agg(F.min(F.struct("rank", "at", "part")).alias("first"))
    return first.select("repo", "number", "kind", "ref", "first.part", "first.at")


def item_texts(items: DataFrame, *more: str) -> DataFrame:
    title = items.select("repo", "number", *more, F.lit("title").alias("part"), F.lit(0).alias("rank"), F.col("title").alias("text"))
    return title.unionByName(items.select("repo", "number", *more, F.lit("body").alias("part"), F.lit(1).alias("rank"), F.col("body").alias("text")))


def keyword_edges(items: DataFrame) -> DataFrame:
    """What items' titles and bodies say. Only a pull request's body closes; what it closes it doesn't also mention."""
    texts = item_texts(items.withColumn("pull", F.col("kind") == "pr"), "pull")
    found = marked_references(texts, "pull").where("kind <> 'closes' or (pull and part = 'body')")
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("rank", "at", "part"))).alias(kind)
    found = found.groupBy("repo", "number", "ref").agg(*[first(k) for k in ("closes", "mentions", "duplicates")])  # texts are read once
    said = lambda kind: F.when(F.col(kind).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}.at").alias("at"), F.col(f"{kind}.part").alias("part")))
    said = F.array(F.coalesce(said("closes"), said("mentions")), said("duplicates"))
    found = found.select("repo", "number", "ref", F.explode(said).alias("s")).where("s is not null").select("repo", "number", "ref", "s.*")
    place = F.when(F.col("part") == "title", "title").otherwise(F.concat("part", F.lit("@"), "at"))
    edge = lambda df, rel, evidence: row(df.where("ref <> number"), "item", F.col("number"), rel, "item", F.col("ref"), evidence, "keyword")
    kinds = F.when(F.col("kind") == "closes", "closes_keyword").when(F.col("kind") == "mentions", "mentions").otherwise("duplicate_keyword")
    return edge(found, kinds, F.concat(place, F.when(F.col("kind") == "closes", " closing keyword").otherwise("")))


def comment_edges(comments: DataFrame) -> DataFrame:
    """comments(repo, number, comment_id, author, body): who commented, and what comments mention (they close nothing); the latest comment's evidence counts."""
    place = F.concat(F.lit("comment:"), F.col("comment_id"))
    wrote = row(comments.where("author is not null").groupBy("repo", "number", "author").agg(F.max("comment_id").alias("comment_id")), "actor", F.col("author"), "commented", "item", F.col("number"), place, "payload")
    texts = comments.select("repo", "number", place.alias("part"), (-F.col("comment_id")).alias("rank"), F.col("body").alias("text"))
    found = text_references(texts).where("kind <> 'closes' and ref <> number")
    kinds = F.when(F.col("kind") == "mentions", "mentions").otherwise("duplicate_keyword")
    return wrote.unionByName(row(found, "item", F.col("number"), kinds, "item", F.col("ref"), F.concat("part", F.lit("@"), "at"), "keyword"))


def payload_edges(items: DataFrame, labels: DataFrame, files: DataFrame) -> DataFrame:
    """Authors, labels and files. labels(number, name) and files(number, path) belong to the items' repositories."""
    of = items.select("repo", "number")
    own = row(items.where("author is not null"), "actor", F.col("author"), "authored", "item", F.col("number"), F.lit("user.login"), "payload")
    tagged = row(labels.join(of, "number"), "item", F.col("number"), "has_label", "label", F.col("name"), F.lit("labels[]"), "payload")
    touched = row(files.join(of, "number"), "item", F.col("number"), "touches", "file", F.col("path"), F.lit("pulls.files"), "payload")
    return own.unionByName(tagged).unionByName(touched)


def commit_edges(commits: DataFrame) -> DataFrame:
    """commits(repo, number, sha, message): what a message closes, with the commit as evidence."""
    texts = commits.where("trim(sha) <> ''").select("repo", "number", F.trim("sha").alias("part"), F.lit(0).alias("rank"), F.col("message").alias("text"))
    marked = texts.where(F.col("text").contains("#") | F.lower("text").contains("http"))
    found = marked.select("repo", "number", "part", F.explode(X.references(F.col("text"), F.col("repo"))).alias("r")).where("r.kind = 'closes' and r.number <> number")
    return row(found, "item", F.col("number"), "closes_keyword", "item", F.col("r.number"), F.concat(F.lit("commit "), "part", F.lit(" closing keyword")), "keyword")


def qualified(number: Column, repo: Column, own: Column) -> Column:
    """An item's id seen from its own repository: its number, or owner/name#number of another."""
    return F.when(F.lower(repo) == F.lower(own), number.cast("string")).otherwise(F.concat(repo, F.lit("#"), number.cast("string")))


def link_edges(links: DataFrame) -> DataFrame:
    """links(repo, number, kind, other, other_repo): what the forge itself reports; unknown kinds and rows without a target are malformed and left out."""
    rel = F.create_map(*[F.lit(x) for x in ("blocked_by", "blocked_by", "parent", "child_of", "duplicate_of", "duplicate_of", "open_prs", "linked_pr")])
    known = links.withColumn("rel", rel[F.col("kind")]).where("rel is not null and other is not null and other_repo is not null")
    known = known.where("not (number = other and lower(repo) = lower(other_repo))")
    return row(known, "item", F.col("number"), F.col("rel"), "item", qualified(F.col("other"), F.col("other_repo"), F.col("repo")), F.col("kind"), "link")


def timeline_edges(timeline: DataFrame, items: DataFrame) -> DataFrame:
    """timeline(repo, number, type, commit_id, source, source_repo): closing commits, the pull requests whose merge they are, cross references."""
    closed = timeline.where("type = 'closed' and trim(commit_id) <> ''").withColumn("commit_id", F.trim("commit_id"))
    by = row(closed, "item", F.col("number"), "closed_by_commit", "commit", F.col("commit_id"), F.lit("timeline closed event"), "timeline")
    merges = items.where("merge_commit is not null").select("repo", F.col("merge_commit").alias("commit_id"), F.col("number").alias("closer"))
    closes = row(closed.join(merges, ["repo", "commit_id"]).where("closer <> number"), "item", F.col("closer"), "closes", "item", F.col("number"), F.lit("timeline closed event"), "timeline")
    crossed = timeline.where("type = 'cross_referenced' and source is not null and source_repo <> '' and not (source = number and lower(source_repo) = lower(repo))")
    cross = row(crossed, "item", qualified(F.col("source"), F.col("source_repo"), F.col("repo")), "cross_referenced", "item", F.col("number"), F.lit("timeline cross-referenced event"), "timeline")
    return by.unionByName(closes).unionByName(cross)


def pull_edges(items: DataFrame) -> DataFrame:
    """What a pull request's state says: its merge commit, the one it reverts by title, the item its branch names (if it names one only)."""
    pulls = items.where("kind = 'pr'")
    merged = row(pulls.where("merge_commit is not null and merged is not null"), "item", F.col("number"), "merged_commit", "commit", F.col("merge_commit"), F.lit("merge_commit_sha"), "payload")
    wanted = pulls.select("repo", "number", F.regexp_extract("title", r'^Revert "(.*)"$', 1).alias("title")).where("title <> ''")
    found = wanted.join(pulls.select("repo", "title", F.col("number").alias("other")), ["repo", "title"]).where("other <> number")
    reverts = row(found, "item", F.col("number"), "reverts", "item", F.col("other"), F.lit("title"), "payload")
    tokens = F.regexp_extract_all(F.coalesce("head_ref", F.lit("")), F.lit(r"(?<![A-Za-z0-9])(\d{1,10})(?![A-Za-z0-9])"), F.lit(1))
    named = pulls.select("repo", "number", tokens.alias("t")).where("size(t) = 1").select("repo", "number", F.get("t", F.lit(0)).cast("long").alias("other"))
    named = named.join(items.select("repo", F.col("number").alias("other")), ["repo", "other"], "left_semi").where("other <> number")
    return merged.unionByName(reverts).unionByName(row(named, "item", F.col("number"), "branch_ref", "item", F.col("other"), F.lit("head_ref"), "payload"))


def collapsed(edges: DataFrame, seq: str) -> DataFrame:
    """One edge a key and source, the last by seq; those of closing words merge their evidence."""
    key = ["repo", "src_type", "src", "rel", "dst_type", "dst", "source"]
    others = edges.where("rel <> 'closes_keyword'").groupBy(*key).agg(F.max_by("evidence", seq).alias("evidence"))
    closing = merged_evidence(edges.where("rel = 'closes_keyword'"), key, seq, "evidence")
    return others.select(*COLUMNS).unionByName(closing.select(*COLUMNS))


def merged_closes(edges: DataFrame) -> DataFrame:
    """closes edges with one row for each pair, whatever streams report it: evidence of all, closing_ref as the surviving source if it is one of them."""
    of = edges.where("rel = 'closes'").withColumn("seq", F.when(F.col("source") == "closing_ref", 0).otherwise(1))
    key = ["repo", "src_type", "src", "rel", "dst_type", "dst"]
    source = of.groupBy(*key).agg(F.min_by("source", F.struct("seq", "source")).alias("source"))
    return source.join(merged_evidence(of, key, "seq", "evidence", reserve=("closingIssuesReferences",)), key).select(*COLUMNS)


def item_ends(edges: DataFrame, items: DataFrame, end: str = "dst") -> DataFrame:
    """edges whose end is a stored item of their repository, with its number: digits only, so `owner/name#5` is nobody here."""
    number = F.when(F.col(end).rlike("^[0-9]{1,18}$"), F.col(end).cast("long"))
    return edges.where(F.col(f"{end}_type") == "item").withColumn("end_number", number).join(items.select("repo", F.col("number").alias("end_number")), ["repo", "end_number"])


def what_closed(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(repo, number, closers) of items that something closes: pull requests and commits, sorted."""
    closing = item_ends(edges.where(F.col("rel").isin("closes", "closes_keyword")), items).select("repo", F.col("end_number").alias("number"), F.concat(F.lit("#"), "src").alias("by"))
    commits = edges.where("rel = 'closed_by_commit'").select("repo", F.col("src").cast("long").alias("number"), F.col("dst").alias("by"))
    return closing.unionByName(commits).groupBy("repo", "number").agg(F.array_join(F.array_sort(F.collect_set("by")), ",").alias("closers"))


def routed(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Every edge once, with the item under which an export writes it: its stored source, else its stored target, else none (an orphan)."""
    known = items.select("repo", F.col("number").cast("string").alias("id"))
    out = edges.withColumn("at_src", F.when(F.col("src_type") == "item", F.col("src"))).withColumn("at_dst", F.when(F.col("dst_type") == "item", F.col("dst")))
    out = out.join(known.withColumnsRenamed({"id": "at_src"}).withColumn("has_src", F.lit(True)), ["repo", "at_src"], "left")
    out = out.join(known.withColumnsRenamed({"id": "at_dst"}).withColumn("has_dst", F.lit(True)), ["repo", "at_dst"], "left")
    return out.select(*COLUMNS, F.when(F.col("has_src"), F.col("at_src")).when(F.col("has_dst"), F.col("at_dst")).alias("home"))
