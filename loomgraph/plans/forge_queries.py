"""Registered queries over the project history (forge.py), and the SQL that must give the same rows.

The SQL knows what the texts say from the keys they were made of, not by extracting it; it shares no constant with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import forge as G
from ..functions import extract as X
from ..functions import payload as P
from ..operators import bundle as U
from ..operators import claims as K
from ..operators import edges as E
from ..operators import evaluate as V
from ..operators import export as B
from ..operators import items as I
from ..operators import search as S
from ..operators import similarity as Y
from ..operators import triage as T3
from ..storage import cut
from ..streaming import integrity as Z

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None, *tables: str):
    """Register a query; its SQL may use the tables as f_<name>."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (f"with {G.views(*tables)}" + (", " if sql.lstrip().startswith("also ") else "\n") if tables else "") + sql.lstrip().removeprefix("also ")
        return f

    return register


class Forge:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return G.table(self.spark, self.sf_dir, name)

    def of_items(self, name: str) -> DataFrame:
        """A table with its items' repository."""
        rows = getattr(self, name)
        return rows.join(self.items.select("repo", "number"), "number")


_REFS = """also r as (
  select repo, number, 'closes_keyword' as rel, (k % 200) * 2 + 1 as ref, 'body@6 closing keyword' as evidence from p where k % 5 = 0
  union all select repo, number, 'mentions', (k % 90) * 2 + 1, 'body@' || length('Fixes #' || ((k % 200) * 2 + 1) || ' and see ') from p where k % 5 = 0 and k % 90 <> k % 200
  union all select repo, number, 'closes_keyword', (k % 70) * 2 + 1, 'body@22 closing keyword' from p where k % 5 = 1 and repo = 'acme/app'
  union all select repo, number, 'closes_keyword', (k % 40) * 2 + 1, 'body@' || length('closes: https://github.com/acme/app/issues/') || ' closing keyword' from p where k % 5 = 2 and repo = 'acme/app'
  union all select 'acme/app', number, rel, ref, case when min(pos) = -1 then 'title' else 'body@' || min(pos) end from d where ref <> number group by all),
  """
_SAID = """p as (select repo, number, number // 2 as k from f_items where kind = 'pr'),
  t as (select doc_id as k, doc_id * 2 + 1 as number, length(coalesce(text, '')) as n from documents),
  d as (select number, 'mentions' as rel, (k % 30) * 2 + 1 as ref, -1 as pos from t where k % 9 = 0 union all select number, 'duplicate_keyword', (k % 30) * 2 + 1, -1 from t where k % 9 = 0
    union all select number, 'mentions', (k + 5) * 2 + 1, n + 5 from t where k % 8 = 0
    union all select number, 'mentions', (k % 50) * 2 + 1, n + length(' See #' || ((k + 5) * 2 + 1) || ' duplicate of ') from t where k % 8 = 0
    union all select number, 'duplicate_keyword', (k % 50) * 2 + 1, n + length(' See #' || ((k + 5) * 2 + 1) || ' duplicate of ') from t where k % 8 = 0
    union all select number, 'mentions', (k + 2) * 2 + 1, n + length(' > quoted #3 - [ ] ') from t where k % 8 = 1
    union all select number, 'mentions', (k + 3) * 2 + 1, n + length(' > quoted #3 - [ ] #' || ((k + 2) * 2 + 1) || ' todo - [x] done ') from t where k % 8 = 1),
  """
REFS = "also " + _SAID + _REFS.removeprefix("also ")


@query(REFS + "x as (select 1) select repo, 'item' as src_type, number::varchar as src, rel, 'item' as dst_type, ref::varchar as dst, evidence, 'keyword' as source from r", "items")
def keyword_edges(spark, sf_dir):
    return E.keyword_edges(Forge(spark, sf_dir).items)


@query("""select i.repo, 'actor' as src_type, c.author as src, 'commented' as rel, 'item' as dst_type, number::varchar as dst, 'comment:' || max(comment_id) as evidence, 'payload' as source from f_comments c join f_items i using (number) group by i.repo, c.author, number
  union all select i.repo, 'item', number::varchar, 'mentions', 'item', ref::varchar, 'comment:' || max(comment_id) || '@' || arg_max(pos, comment_id), 'keyword'
  from (select conv_id * 2 + 1 as number, conv_id * 1000 + turn as comment_id, (conv_id % 20) * 2 + 1 as ref, length(coalesce(text, '')) + 7 as pos from conversations where (conv_id + turn) % 5 = 2) x join f_items i using (number) where ref <> number group by i.repo, number, ref""", "items", "comments")
def comment_edges(spark, sf_dir):
    return E.comment_edges(Forge(spark, sf_dir).of_items("comments"))


@query("""select repo, 'actor' as src_type, author as src, 'authored' as rel, 'item' as dst_type, number::varchar as dst, 'user.login' as evidence, 'payload' as source from f_items
  union all select repo, 'item', number::varchar, 'has_label', 'label', name, 'labels[]', 'payload' from f_labels join f_items using (number)
  union all select repo, 'item', number::varchar, 'touches', 'file', path, 'pulls.files', 'payload' from f_pr_files join f_items using (number)""", "items", "labels", "pr_files")
def payload_edges(spark, sf_dir):
    f = Forge(spark, sf_dir)
    return E.payload_edges(f.items, f.labels, f.pr_files)


@query("""select repo, 'item' as src_type, number::varchar as src, 'closes_keyword' as rel, 'item' as dst_type, (((number // 2) % 120) * 2 + 1)::varchar as dst, 'commit ' || sha || ' closing keyword' as evidence, 'keyword' as source
  from f_commits join f_items using (number) where (number // 2) % 4 = 0""", "items", "commits")
def commit_edges(spark, sf_dir):
    return E.commit_edges(Forge(spark, sf_dir).of_items("commits"))


@query(REFS + """c as (select repo, number, ref, evidence, 0 as seq from r where rel = 'closes_keyword' union all select repo, number, ((number // 2) % 120) * 2 + 1, 'commit c0ffee' || (number // 2) || ' closing keyword', 1 from f_items where merged is not null and (number // 2) % 4 = 0)
  select repo, number::varchar as src, ref::varchar as dst, string_agg(evidence, '; ' order by seq) as evidence from c group by repo, number, ref""", "items")
def closing_evidence(spark, sf_dir):
    f = Forge(spark, sf_dir)
    edges = E.keyword_edges(f.items).where("rel = 'closes_keyword'").withColumn("seq", F.lit(0)).unionByName(E.commit_edges(f.of_items("commits")).withColumn("seq", F.lit(1)))
    return E.collapsed(edges, "seq").select("repo", "src", "dst", "evidence")


@query("""select i.repo, number::varchar as src, case l.kind when 'blocked_by' then 'blocked_by' else 'child_of' end as rel, case when l.repo = 'acme/app' then other::varchar else l.repo || '#' || other end as dst, l.kind as evidence
  from f_links l join f_items i using (number) where not (other = number and l.repo = 'acme/app')""", "items", "links")
def link_edges(spark, sf_dir):
    f = Forge(spark, sf_dir)
    links = f.links.withColumnRenamed("repo", "other_repo").join(f.items.select("repo", "number"), "number")
    return E.link_edges(links).select("repo", "src", "rel", "dst", "evidence")


@query("""also t as (select i.repo, l.* from f_timeline l join f_items i using (number))
  select repo, number::varchar as src, 'closed_by_commit' as rel, commit_id as dst, 'timeline' as source from t where type = 'closed'
  union all select t.repo, m.number::varchar, 'closes', t.number::varchar, 'timeline' from t join f_items m on m.merge_commit = t.commit_id and m.repo = t.repo
  union all select repo, case when source_repo = 'acme/app' then source::varchar else source_repo || '#' || source end, 'cross_referenced', number::varchar, 'timeline' from t where type = 'cross_referenced'""", "items", "timeline")
def timeline_edges(spark, sf_dir):
    f = Forge(spark, sf_dir)
    return E.timeline_edges(f.of_items("timeline"), f.items).select("repo", "src", "rel", "dst", "source")


@query("""select repo, number::varchar as src, 'merged_commit' as rel, merge_commit as dst from f_items where merged is not null
  union all select a.repo, a.number::varchar, 'reverts', b.number::varchar from f_items a join f_items b on a.repo = b.repo and b.number = a.number - 2 where a.kind = 'pr' and (a.number // 2) % 77 = 1 and (b.number // 2) % 77 <> 1
  union all select a.repo, a.number::varchar, 'branch_ref', b.number::varchar from f_items a join f_items b on a.repo = b.repo and b.number = ((a.number // 2) % 150) * 2 + 1 where a.kind = 'pr' and (a.number // 2) % 3 = 0""", "items")
def pull_edges(spark, sf_dir):
    return E.pull_edges(Forge(spark, sf_dir).items).select("repo", "src", "rel", "dst")


@query(REFS + """tl as (select i.repo, l.number, l.commit_id from f_timeline l join f_items i using (number) where type = 'closed'),
  c as (select r.repo, r.ref as number, '#' || r.number as who from r join f_items i on i.repo = r.repo and i.number = r.ref where rel = 'closes_keyword'
    union select t.repo, t.number, '#' || m.number from tl t join f_items m on m.merge_commit = t.commit_id and m.repo = t.repo union select repo, number, commit_id from tl)
  select repo, number, string_agg(who, ',' order by who) as closers from c group by 1, 2""", "items", "timeline")
def what_closed(spark, sf_dir):
    f = Forge(spark, sf_dir)
    edges = E.keyword_edges(f.items).unionByName(E.timeline_edges(f.of_items("timeline"), f.items))
    return E.what_closed(edges, f.items)


@query("""also e as (select repo, number::varchar as src, 'link' as source, case when l.repo = 'acme/app' then other::varchar else l.repo || '#' || other end as dst from (select i.repo as own, l.* from f_links l join f_items i using (number)) l where not (other = number and repo = 'acme/app'))
  select src, dst, src as home from e""", "items", "links")
def routed_edges(spark, sf_dir):
    f = Forge(spark, sf_dir)
    links = f.links.withColumnRenamed("repo", "other_repo").join(f.items.select("repo", "number"), "number")
    return E.routed(E.link_edges(links), f.items).select("src", "dst", "home")


@query("""also d as (select doc_id as k, doc_id * 2 + 1 as number from documents)
  select number, 'part/' || (k % 300) || '.py' as path, false as ticked from d where k % 8 = 2 union all select number, 'part/' || (k % 300) || '.py', true from d where k % 8 = 3
  union all select number, 'part/' || (k % 211) || '.py', false from d where k % 8 = 3 and k % 211 <> k % 300""".replace("also d as", "with d as"))
def path_references(spark, sf_dir):
    items = Forge(spark, sf_dir).items.where(F.col("body").contains("/") | F.col("body").contains("."))
    return items.where("kind = 'issue'").select("number", F.explode(X.paths(F.col("body"), F.col("repo"))).alias("p")).where("p.path like 'part/%'").select("number", "p.path", "p.ticked")


@query("select doc_id * 2 + 1 as number, 'ValueError' as exception, 'ValueError: bad <n> at <hex>' as line, 'run' as function from documents where doc_id % 8 = 2")
def error_signatures(spark, sf_dir):
    items = Forge(spark, sf_dir).items.where(F.col("body").contains("```"))
    return items.select("number", F.explode(X.signatures(F.col("body"))).alias("s")).select("number", "s.exception", "s.line", "s.function")


@query("select doc_id * 2 + 1 as number, ((doc_id + 2) * 2 + 1) || ',' || ((doc_id + 3) * 2 + 1) as tasks from documents where doc_id % 8 = 1")
def task_lists(spark, sf_dir):
    """Numbers of check boxes that the text also mentions."""
    items = Forge(spark, sf_dir).items.where(F.col("body").contains("["))
    mentioned = F.transform(F.filter(X.references(F.col("body"), F.col("repo")), lambda r: r["kind"] == "mentions"), lambda r: r["number"])
    found = items.select("number", F.array_intersect(X.task_refs(F.col("body")), mentioned).alias("t")).where("size(t) > 0")
    return found.select("number", F.array_join(F.array_sort("t").cast("array<string>"), ",").alias("tasks"))


# ---- claims


@query("""also c as (select conv_id, turn, conv_id * 2 + 1 as number, conv_id * 1000 + turn as comment_id, role, 1700000000 - 3600 * ((conv_id * 7 + turn * 5) % 120) as created, (conv_id + turn) % 5 as what from conversations),
  k as (select *, lpad(conv_id::varchar, 16, '0') as token from c where what = 0), r as (select * from c where what = 1),
  e as (select k.*, exists (select 1 from r where r.number = k.number and (r.created > k.created or (r.created = k.created and r.comment_id > k.comment_id))) as ended from k)
  select number, comment_id, token, number::varchar as named, role <> 'user' as trusted, ended, round((1700000000 - created) / 3600.0, 4)::double as age_hours, role <> 'user' and not ended and (1700000000 - created) / 3600.0 < 72 as active from e""".replace("also c as", "with c as"))
def claims(spark, sf_dir):
    found = K.claims(Forge(spark, sf_dir).comments, G.NOW)
    return found.select("number", "comment_id", "token", F.array_join(F.col("named").cast("array<string>"), ",").alias("named"), "trusted", "ended", "age_hours", "active")


@query("""also c as (select conv_id, turn, conv_id * 2 + 1 as number, conv_id * 1000 + turn as comment_id, role, 1700000000 - 3600 * ((conv_id * 7 + turn * 5) % 120) as created, (conv_id + turn) % 5 as what from conversations),
  k as (select * from c where what = 0 and role <> 'user' and (1700000000 - created) / 3600.0 < 72 and not exists (select 1 from c r where r.what = 1 and r.number = c.number and (r.created > c.created or (r.created = c.created and r.comment_id > c.comment_id))))
  select number, arg_min(comment_id, created * 10000000 + comment_id) as comment_id, lpad(((number - 1) // 2)::varchar, 16, '0') as token from k group by number""".replace("also c as", "with c as"))
def claim_gate(spark, sf_dir):
    return K.gate(K.claims(Forge(spark, sf_dir).comments, G.NOW)).select("number", "comment_id", "token")


# ---- items


@query("""select repo, kind, state, count(*) as items, sum(octet_length(encode(body)))::bigint as body_bytes, count(*) filter (exists (select 1 from f_pr_files p where p.number = i.number)) as with_files from f_items i group by all""", "items", "pr_files")
def coverage(spark, sf_dir):
    f = Forge(spark, sf_dir)
    return I.coverage(f.items, f.pr_files)


@query("""select repo, number, title, state, author, created, (select string_agg(name, ',' order by name) from f_labels l where l.number = i.number) as labels, (select count(*) from f_comments c where c.number = i.number) as comments,
  (select string_agg(path, ',' order by path) from f_pr_files p where p.number = i.number) as files from f_items i where repo = 'acme/lib'""", "items", "labels", "comments", "pr_files")
def item_view(spark, sf_dir):
    f = Forge(spark, sf_dir)
    rows = I.view(I.scoped(f.items, "Acme/Lib"), f.labels, f.comments, f.pr_files)
    flat = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return rows.select("repo", "number", "title", "state", "author", "created", flat("labels"), F.size("comments").cast("long").alias("comments"), flat("files"))


@query("""select number, title, updated, author from f_items i where state = 'open' and kind = 'issue' and exists (select 1 from f_labels l where l.number = i.number and l.name = 'P0')
  and not exists (select 1 from f_actors a where a.login = i.author and a.bot) order by updated desc, number desc limit 25 offset 5""", "items", "labels", "actors")
def listed_items(spark, sf_dir):
    f = Forge(spark, sf_dir)
    return I.listing(f.items, f.labels, f.actors, kind="issue", state="open", label="P0", limit=25, offset=5).select("number", "title", "updated", "author")


@query("""also r as (select number, event_id as id, type as content, created as valid_from, lead(created) over (partition by number order by created, event_id) as valid_to from f_events),
  s as (select number, max(valid_to) as live_from from r where valid_to is not null group by 1), v as (select number, arg_max(content, id) as content from r where valid_to is not null and valid_from <= 1704800000 and valid_to > 1704800000 group by 1)
  select i.number, coalesce(v.content, case when s.live_from <= 1704800000 then 'live' end) as content, case when v.content is not null then 'revision' when s.live_from <= 1704800000 then 'live' else 'unknown' end as origin
  from (select distinct number from r) i left join v using (number) left join s using (number)""", "events")
def text_at(spark, sf_dir):
    events = Forge(spark, sf_dir).events
    revisions = I.intervals(events)
    live = events.select("number", F.lit("live").alias("content")).distinct()
    return I.text_at(revisions, live, 1_704_800_000)


@query("""also r as (select number, event_id, type, created, lead(created) over (partition by number order by created, event_id) as until from f_events)
  select number, string_agg(type || '@' || created || '-' || coalesce(until::varchar, 'now'), ' ' order by created, event_id) as history from r group by number""", "events")
def item_history(spark, sf_dir):
    return I.history(I.intervals(Forge(spark, sf_dir).events))


@query("""select i.number, count(c.comment_id) as visible from f_items i left join f_comments c on c.number = i.number and c.created <= 1699800000 where i.kind = 'issue' and i.created <= 1699800000 group by i.number""", "items", "comments")
def visible_comments(spark, sf_dir):
    f = Forge(spark, sf_dir)
    seen = I.as_of(f.items.where("kind = 'issue'"), 1_699_800_000)
    return I.visible(seen, f.comments, 1_699_800_000)


@query("""select number, state, merged, closed from (select number, case when (merged > 900000000) or (kind = 'issue' and closed > 900000000) or (closed > 900000000) then 'open' else state end as state,
  case when merged <= 900000000 then merged end as merged, case when closed <= 900000000 then closed end as closed from f_items where created <= 900000000)""", "items")
def items_as_of(spark, sf_dir):
    return I.as_of(Forge(spark, sf_dir).items, 900_000_000).select("number", "state", "merged", "closed")


@query("""select path, count(*) as changes, sum(additions)::bigint as additions, sum(deletions)::bigint as deletions from f_pr_files join f_items using (number) where merged is not null and (status is null or status <> 'removed') group by path""", "items", "pr_files")
def file_churn(spark, sf_dir):
    f = Forge(spark, sf_dir)
    return I.churn(f.pr_files, f.items)


@query("""also b as (select x.number, c.comment_id, row_number() over (partition by x.number order by case c.association when 'OWNER' then 0 when 'MEMBER' then 1 else 2 end, c.created desc, c.comment_id desc) as rank from f_items x join f_comments c using (number))
  select number, comment_id, rank::int as rank from b where rank <= 5""", "items", "comments")
def brief_comments(spark, sf_dir):
    return I.ranked_comments(Forge(spark, sf_dir).comments, 5).select("number", "comment_id", "rank")


@query("""select login, count(*) as items, count(distinct kind) as kinds from (select author as login, kind from f_items where author not in (select login from f_actors where bot)) group by login having count(*) > 1""", "items", "actors")
def duplicate_authors(spark, sf_dir):
    f = Forge(spark, sf_dir)
    people = f.items.join(f.actors.where("bot").select(F.col("login").alias("author")), "author", "left_anti")
    return people.groupBy(F.col("author").alias("login")).agg(F.count("*").alias("items"), F.countDistinct("kind").alias("kinds")).where("items > 1")


# ---- search

QUERY = "the revert of Change"
_PHRASE = "contains(' ' || array_to_string(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ', ' revert change ')"


@query("""also n as (select number, string_agg(distinct name, ' ' order by name) as labels from f_labels group by 1), fl as (select number, string_agg(distinct path, ' ' order by path) as paths from f_pr_files group by 1),
  x as (select 'i' || number as doc, number, true as own, unnest([{'t': title, 'w': 10.0}, {'t': body, 'w': 1.0}, {'t': labels, 'w': 3.0}, {'t': paths, 'w': 0.5}], recursive := true) from f_items left join n using (number) left join fl using (number)
    union all select 'c' || comment_id, number, false, body, 1.0 from f_comments),
  w as (select doc, number, own, w, regexp_extract_all(lower(coalesce(t, '')), '[\\p{L}\\p{N}]+') as ws from x), z as (select doc, number, own, sum(len(ws)) as size from w group by all),
  st as (select count(*) as docs, avg(size) as mean from z), e as (select doc, w, unnest(ws) as term from w), p as (select term, doc, sum(w)::double as tf from e where term in ('the', 'revert', 'of', 'change') group by all),
  df as (select term, count(*) as df from p group by 1),
  s as (select p.term, z.*, ln(1 + (docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * size / mean)) as part from p join df using (term) join z using (doc), st),
  a as (select doc, number, own, true as strict, sum(part) as score from s group by all having count(*) = 4 union all select doc, number, own, false, sum(part) from s where term in ('revert', 'change') group by all),
  m as (select number, strict, max(score) as score, max(own) as in_item, count(*) filter (not own) as comment_hits from a group by all),
  g as (select * from m where strict union all select * from m where not strict and number not in (select number from m where strict))
  select number, case when strict then 'all' else 'any' end as mode, in_item, ("""
       + _PHRASE.format("title") + " or " + _PHRASE.format("body")
       + """) and in_item as phrase, comment_hits, round(score, 6) as score from g join f_items using (number) order by strict desc, in_item desc, phrase desc, round(score, 9) desc, updated desc, number limit 40 offset 3""", "items", "labels", "pr_files", "comments")
def ranked_search(spark, sf_dir):
    f = Forge(spark, sf_dir)
    docs = S.documents(f.items, f.labels, f.pr_files, f.comments)
    sizes = docs.agg(F.count("*").alias("docs"), F.avg(F.aggregate("fields", F.lit(0).cast("long"), lambda a, x: a + F.size(S.tokens(x["text"])))).alias("mean"))
    return S.search(f.items, S.postings(docs), sizes, QUERY, 40, 3)[0].drop("title", "body")


# ---- triage


def _edges(f: Forge) -> DataFrame:
    links = f.links.withColumnRenamed("repo", "other_repo").join(f.items.select("repo", "number"), "number")
    return E.keyword_edges(f.items).unionByName(E.link_edges(links)).unionByName(E.pull_edges(f.items))


def _paths(f: Forge) -> DataFrame:
    bodies = f.items.where("kind = 'issue'").where(F.col("body").contains(".py"))
    return bodies.select("number", F.explode(X.paths(F.col("body"), F.col("repo"))).alias("p")).select("number", F.col("p.path").alias("path")).distinct()


def _tasks(f: Forge) -> DataFrame:
    marked = f.items.where("kind = 'issue'").where(F.col("body").contains("["))
    return marked.select("number", F.explode(X.task_refs(F.col("body"))).alias("child"))


def _gates(f: Forge, edges: DataFrame) -> DataFrame:
    issues = f.items.where("kind = 'issue' and state = 'open'")
    nobody = f.items.select("number").limit(0)
    return T3.gates(issues, f.items, edges, K.gate(K.claims(f.comments, G.NOW)), nobody, _tasks(f))


def _scored(f: Forge) -> DataFrame:
    edges = cut(_edges(f), "triage-edges")  # read for every feature
    gated = cut(_gates(f, edges), "triage-gates")
    paths = cut(_paths(f), "triage-paths")
    issues = f.items.where("kind = 'issue' and state = 'open'")
    rows = T3.features(issues, f.items, edges, f.comments, f.events, f.labels, f.actors, paths, f.pr_files, gated)
    scored = T3.stage1(rows, G.NOW).join(gated, "number")
    reverted = T3.item_edges(edges, ("reverts",)).select(F.col("b").alias("number")).distinct()
    hot = T3.heat(I.merged_files(f.pr_files, f.items), HEAT_AT)
    return T3.stage2(scored, paths, hot, f.pr_files.where(I.kept(F.col("status"))).join(reverted, "number", "left_semi"))


HEAT_AT = 904_000_000
_ISSUE_PATHS = """ip as (select doc_id * 2 + 1 as number, 'part/' || (doc_id % 300) || '.py' as path from documents where doc_id % 8 in (2, 3) union select doc_id * 2 + 1, 'part/' || (doc_id % 211) || '.py' from documents where doc_id % 8 = 3),"""
_GATES = REFS + _ISSUE_PATHS + """
  st as (select number, kind, state, merged, subs, subs_done, locked, author, repo, reactions, due, title from f_items),
  lk as (select number as a, other as b, kind as rel from f_links where repo = 'acme/app' and number <> other),
  ke as (select repo, number as a, ref as b, rel from r),
  cl as (select conv_id * 2 + 1 as number, conv_id * 1000 + turn as comment_id, role, 1700000000 - 3600 * ((conv_id * 7 + turn * 5) % 120) as created, (conv_id + turn) % 5 as what from conversations),
  claimed as (select distinct number from cl k where what = 0 and role <> 'user' and (1700000000 - created) / 3600.0 < 72 and not exists (select 1 from cl r where r.what = 1 and r.number = k.number and (r.created > k.created or (r.created = k.created and r.comment_id > k.comment_id)))),
  oi as (select * from st where kind = 'issue' and state = 'open'),
  kids as (select lk.b as number, bool_and(coalesce(s.state = 'closed', false)) as done from lk left join st s on s.number = lk.a where rel = 'parent' group by 1),
  boxes as (select t.number, bool_and(coalesce(s.state = 'closed' and s.kind = 'issue', false)) as done from (select doc_id * 2 + 1 as number, unnest([(doc_id + 2) * 2 + 1, (doc_id + 3) * 2 + 1]) as child from documents where doc_id % 8 = 1) t left join st s on s.number = t.child group by 1),
  gt as (select oi.number, list_filter([case when oi.number in (select number from claimed) then 'claimed' end,
    case when exists (select 1 from lk join st s on s.number = lk.b where rel = 'blocked_by' and lk.a = oi.number and s.state = 'open') then 'blocked' end,
    case when exists (select 1 from ke join st s on s.number = ke.a where rel = 'closes_keyword' and ke.b = oi.number and s.state = 'open' and s.kind = 'pr') then 'linked_pr (append-only evidence; may be stale)' end,
    case when locked then 'locked' end, case when (subs > 0 and subs = subs_done) or oi.number in (select number from kids where done) or oi.number in (select number from boxes where done) then 'tracking' end], lambda x: x is not null) as gates from oi),"""
_FEATURES = _GATES + """
  bot as (select login from f_actors where bot), au as (select number, author from f_comments union select number, author from st),
  fe as (select oi.number, oi.reactions, (select count(distinct author) from au where au.number = oi.number and author not in (select login from bot)) as participants,
    (select count(*) from f_comments c where c.number = oi.number) as comments, (select count(distinct a) from ke where rel = 'duplicate_keyword' and b = oi.number) as duplicates,
    (select count(distinct ke.a) from ke join st s on s.number = ke.a where rel = 'mentions' and ke.b = oi.number and s.state = 'open' and s.author not in (select login from bot) and not exists (select 1 from lk where rel = 'parent' and lk.a = ke.a and lk.b = oi.number)) as mentions,
    (select count(distinct lk.a) from lk join gt g on g.number = lk.a where rel = 'blocked_by' and lk.b = oi.number and len(g.gates) = 0) as blocking,
    case when subs > 0 then subs - subs_done end as gap, due, (select count(*) from f_events e where e.number = oi.number and type = 'reopened') as reopens,
    (select max(case lower(name) when 'p0' then 1.0 when 'bug' then 0.75 end) from f_labels l where l.number = oi.number)::double as label_weight from oi),
  rv as (select distinct b.number from st a join st b on a.repo = b.repo and b.number = a.number - 2 where a.kind = 'pr' and (a.number // 2) % 77 = 1 and (b.number // 2) % 77 <> 1),
  rf as (select number, path from f_pr_files where number in (select number from rv) and (status is null or status <> 'removed')),
  fr as (select ip.number, count(distinct rf.number) as file_reverts from ip join rf using (path) group by 1),
  no as (select fe.number, gates, coalesce(file_reverts, 0) as file_reverts, (least(1.0, reactions / 3.0) + least(1.0, participants / 3.0) + least(1.0, comments / 5.0) + case when duplicates > 0 then 1.0 else 0.0 end + least(1.0, mentions / 10.0))::double / 5 as demand,
    (least(1.0, blocking / 3.0) + case when gap is null then 0 else least(1.0, gap / 3.0) end + case when due <= 1700000000 + 14 * 86400 then 1.0 else 0.0 end)::double / (1 + (gap is not null)::int + (due is not null)::int) as leverage,
    (least(1.0, reopens) + least(1.0, coalesce(file_reverts, 0)))::double / 2 as risk, coalesce(label_weight, 0) as priority from fe join gt using (number) left join fr using (number)),
  """
_TRIAGE_TABLES = ("items", "links", "comments", "events", "labels", "actors", "pr_files")


@query(_GATES + "z as (select 1) select number, array_to_string(gates, ', ') as gates from gt", "items", "links")
def triage_gates(spark, sf_dir):
    f = Forge(spark, sf_dir)
    return _gates(f, _edges(f)).select("number", F.array_join("gates", ", ").alias("gates"))


@query(_FEATURES + "z as (select 1) select number, round(demand, 9) as demand, round(leverage, 9) as leverage, round(risk, 9) as risk, round(priority, 9) as priority, round(demand + leverage + risk + priority, 9) as stage1 from no", *_TRIAGE_TABLES)
def triage_features(spark, sf_dir):
    f = Forge(spark, sf_dir)
    edges = cut(_edges(f), "triage-edges")
    issues = f.items.where("kind = 'issue' and state = 'open'")
    rows = T3.features(issues, f.items, edges, f.comments, f.events, f.labels, f.actors, _paths(f), f.pr_files, _gates(f, edges))
    return T3.stage1(rows, G.NOW).select("number", *[F.round(c, 9).alias(c) for c in (*T3.GROUPS, "stage1")])


_TOTALS = _FEATURES + """
  ht as (select path, sum(exp(-((904000000 - merged) / 86400.0 / 45.0))) as heat from f_pr_files join f_items using (number) where merged <= 904000000 and (status is null or status <> 'removed') group by 1),
  s1 as (select number, gates, demand + leverage + risk + priority as stage1 from no), tp as (select number from s1 where len(gates) = 0 order by stage1 desc, number limit 50),
  wm as (select number, sum(heat) as heat from ip join ht using (path) where number in (select number from s1 where len(gates) = 0) group by 1), ag as (select distinct number from ip where path in (select path from rf)),
  tt as (select number, gates, stage1, case when number in (select number from tp) then 0.25 * (coalesce(heat / (select max(heat) from wm), 0) + (number in (select number from ag))::int) / 2 else 0 end as bonus from s1 left join wm using (number)),
  """


@query(_TOTALS + "z as (select 1) select number, round(stage1 + bonus, 9) as total, row_number() over (order by round(stage1 + bonus, 9) desc, number)::int as rank from tt where len(gates) = 0", *_TRIAGE_TABLES)
def triage_totals(spark, sf_dir):
    return T3.with_rank(_scored(Forge(spark, sf_dir))).select("number", F.round("total", 9).alias("total"), "rank")


@query(_TOTALS + "z as (select 1) select number, total, array_to_string(gates, ', ') as gates from (select number, gates, round(stage1 + bonus, 9) as total from tt) where total < 0.9 or (total = 0.9 and number > 51) order by len(gates) > 0, total desc, number limit 30", *_TRIAGE_TABLES)
def triage_page(spark, sf_dir):
    rows, _ = T3.page(_scored(Forge(spark, sf_dir)), 30, "0.9:51", include_gated=True)
    return rows.select("number", "total", F.array_join("gates", ", ").alias("gates"))


# ---- similarity


def _evidence(f: Forge) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(merged files, paths that issues name, files of items, error signatures, neighbours), from what is written once."""
    merged = f.items.where("kind = 'pr' and merged is not null").select("number", F.lit(True).alias("merged"))
    touched = f.pr_files.where(I.kept(F.col("status"))).groupBy("number").agg(F.collect_set("path").alias("paths"))
    touched = cut(touched.join(merged, "number", "left"), "kept-files")
    named = cut(_paths(f), "similar-named")
    fenced = f.items.where(F.col("body").contains("```"))
    signatures = fenced.select("number", F.explode(X.signatures(F.col("body"))).alias("s")).select("number", F.concat_ws("|", "s.exception", "s.line").alias("signature"))
    ends = cut(T3.item_edges(_edges(f).where("rel <> 'reverts'"), ("mentions", "branch_ref", "blocked_by", "child_of")), "item-ends")
    neighbours = ends.select(F.col("a").alias("number"), F.col("b").alias("other")).unionByName(ends.select(F.col("b").alias("number"), F.col("a").alias("other")))
    files = touched.select("number", "merged", F.explode("paths").alias("path"))
    return files.where("merged").select("number", I.normal_path(F.col("path")).alias("path")), named, named.unionByName(files.select("number", "path")), cut(signatures, "item-signatures"), neighbours


def _similar(f: Forge, best: int | None = None) -> DataFrame:
    """Scores of issues that name files or errors with all items; profiles, of the items that an anchor reaches, and co-changed files are written once."""
    merged, named, paths, signatures, neighbours = _evidence(f)
    hubs = cut(Y.hub_files(merged, f.items), "similar-hubs")
    asked = cut(named.select("number").unionByName(signatures.select("number")).distinct(), "asked-items")
    own_files = cut(paths.join(Y.small(asked), "number", "left_semi").select("path").distinct(), "asked-files")
    pairs = cut(Y.coupled(merged, hubs, own_files), "similar-coupled")
    near = cut(Y.reached(asked, paths, signatures, neighbours, pairs), "reached-items")
    few = near.count() <= Y.NEAR
    part = lambda rows: rows.join(F.broadcast(near) if few else near, "number", "left_semi")
    items = part(f.items) if few else f.items  # texts are not shuffled; an item that is not reached has no features then
    rows = cut(Y.profiles(items, *[part(t) for t in (f.labels, paths, signatures, neighbours)], hubs), "similar-profiles")
    return Y.scored(asked, rows, f.items, pairs, best, own=items)


_SIMILAR = REFS + _ISSUE_PATHS + """
  mf as (select distinct number, path from f_pr_files join f_items using (number) where merged is not null and (status is null or status <> 'removed')),
  bk as (select * from mf where number in (select number from mf group by 1 having count(*) between 2 and 50)), nb as (select path, count(*) as n from bk group by 1),
  cp as (select x.path as fa, y.path as fb, count(*) as support from bk x join bk y on x.number = y.number and x.path <> y.path group by 1, 2),
  cq as (select fa, fb, support, a.n as na, b.n as nb, (select count(distinct number) from bk) * support > a.n * b.n as lifted from cp join nb a on a.path = fa join nb b on b.path = fb),
  ps as (select distinct number, path from (select number, path from ip union all select number, path from f_pr_files where status is null or status <> 'removed')), pl as (select number, list(path order by path) as paths from ps group by 1),
  sg as (select doc_id * 2 + 1 as number from documents where doc_id % 8 = 2),
  ne as (select number as a, ref as b from r where rel = 'mentions' union select number, other from f_links where repo = 'acme/app' and number <> other union select a.number, b.number from f_items a join f_items b on a.repo = b.repo and b.number = ((a.number // 2) % 150) * 2 + 1 where a.kind = 'pr' and (a.number // 2) % 3 = 0),
  nn as (select a as number, b as other from ne union select b, a from ne), nl as (select number, list(other) as others from nn group by 1),
  wd as (select number, author, created, due, list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', title, body)), '[a-z0-9_]+'), lambda w: length(w) >= 3 and w not in (SW))) as words, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9_]+'), lambda w: length(w) >= 3 and w not in (SW))) as tw from f_items),
  ln as (select number, list(distinct name) as labels from f_labels group by 1),
  pr as (select wd.*, coalesce(labels, []) as labels, coalesce(paths, []) as paths, coalesce(others, []) as others, number in (select number from sg) as err from wd left join ln using (number) left join pl using (number) left join nl using (number)),
  q as (select number from ip union select number from sg),
  cd as (select q.number as a, y.number as b from q join sg x using (number), sg y union select q.number, y.number from q join nn x using (number) join nn y on x.other = y.other union select q.number, y.number from q join ps x using (number) join ps y on x.path = y.path
    union select q.number, y.number from q join ps x using (number) join cq on fa = x.path and lifted join ps y on y.path = fb),
  df as (select word, ln(1 + (select count(*) from f_items) / count(*)) as idf from (select unnest(words) as word from wd) group by 1),
  it as (select number, sum(idf) as idf from (select number, unnest(words) as word from wd) join df using (word) group by 1),
  pa as (select cd.a, cd.b, x.words as xw, y.words as yw, x.tw as xt, y.tw as yt, x.paths as xp, y.paths as yp, x.others as xo, y.others as yo, x.labels as xl, y.labels as yl, x.err and y.err as sig, x.author = y.author as sa, x.due = y.due as sd, abs(x.created - y.created) <= 2592000 as nr from cd join pr x on x.number = cd.a join pr y on y.number = cd.b where cd.a <> cd.b),
  sh as (select a, b, sum(idf) as idf from (select a, b, unnest(list_intersect(xw, yw)) as word from pa) join df using (word) group by 1, 2),
  co as (select a, b, max(support / greatest(na, nb)) as cochange, max(lifted) as lifted from (select a, b, fa, unnest(yp) as fb from (select a, b, unnest(xp) as fa, yp from pa)) join cq using (fa, fb) group by 1, 2),
  sc as (select pa.a, pa.b, coalesce(sh.idf, 0) / (coalesce(i.idf, 0) + coalesce(j.idf, 0) - coalesce(sh.idf, 0)) as lexical, case when len(xt) > 0 and len(yt) > 0 then len(list_intersect(xt, yt)) / least(len(xt), len(yt)) else 0 end as title, sig::int::double as signature,
    case when len(xp) + len(yp) > 0 then len(list_intersect(xp, yp)) / (len(xp) + len(yp) - len(list_intersect(xp, yp))) else 0 end as files_direct,
    case when len(xp) > 0 and len(yp) > 0 and not list_has_any(xp, yp) then 1 / least(len(xp), len(yp)) else 0 end as files_analog, coalesce(co.cochange, 0) as cochange,
    case when len(xo) + len(yo) > 0 then len(list_intersect(xo, yo)) / len(list_distinct(xo || yo)) else 0 end as structural, (list_has_any(xl, yl)::int + coalesce(sa, false)::int + coalesce(sd, false)::int + coalesce(nr, false)::int) / 4 as context,
    len(xp) > 0 and len(yp) > 0 and len(list_intersect(xp, yp)) / greatest(1, least(len(xp), len(yp))) >= 0.5 as share, coalesce(co.lifted, false) as lifted
    from pa left join sh using (a, b) left join co using (a, b) left join it i on i.number = pa.a left join it j on j.number = pa.b),
  """.replace("SW", ", ".join(f"'{w}'" for w in "and are bug but can close closed could error file fix fixed for from has have into issue may merge merged might not pull request should test tests that the their then there this was were what when which will with would you your".split()))
_SIMILAR_TABLES = ("items", "labels", "pr_files", "links")
_SIGNALS = ("lexical", "title", "signature", "files_direct", "files_analog", "cochange", "structural", "context")


@query(_SIMILAR + "z as (select 1) select a, b, " + ", ".join(f"round({c}, 9)::double as {c}" for c in _SIGNALS) + " from sc where share or lifted or signature > 0 or structural > 0", *_SIMILAR_TABLES)
def similar_signals(spark, sf_dir):
    nine = lambda c: F.floor(F.col(c) * 1e9 + 0.5) / 1e9  # noqa: E731  no score is negative; many rows, and round() goes through decimals
    return Y.anchored(_similar(Forge(spark, sf_dir))).select("a", "b", *[nine(c).alias(c) for c in _SIGNALS])


@query(_SIMILAR + """tt as (select *, round(lexical + 2 * title + 4 * signature + 4 * files_direct + files_analog + 3 * cochange + 2 * structural + context, 9)::double as total from sc where share or lifted or signature > 0 or structural > 0)
  select a, b, total, rank from (select *, row_number() over (partition by a order by total desc, b)::int as rank from tt) where rank <= 5""", *_SIMILAR_TABLES)
def similar_ranked(spark, sf_dir):
    return Y.ranked(Y.anchored(_similar(Forge(spark, sf_dir), 5)), 5).select("a", "b", F.round("total", 9).alias("total"), "rank")


# ---- integrity and exports


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price"))


@query("""with b as (select o_orderkey as number, o_custkey + case when o_orderkey % 3 = 0 then 1 else 0 end as id, o_orderkey % 3 = 0 as touched, o_orderpriority as title, o_totalprice as price, o_orderkey % 6 as m from orders)
  select number, case when touched and m = 0 then null else title end as title, case when touched and m <> 0 then price + 1 else price end as price from b
  union all select o_orderkey + 1000000000, 'new', 1.0 from orders where o_orderkey % 10 = 0""")
def upserted(spark, sf_dir):
    """A batch of new rows, rows whose title is carried as null, and rows whose title is absent and whose price is carried."""
    old = _orders(spark, sf_dir).select("number", "title", "price")
    cleared = old.where("number % 6 = 0").select("number", F.lit(None).cast("string").alias("title"), F.lit(0.0).alias("price"), F.array(F.lit("title")).alias("present"))
    priced = old.where("number % 6 = 3").select("number", F.lit("ignored").alias("title"), (F.col("price") + 1).alias("price"), F.array(F.lit("price")).alias("present"))
    new = old.where("number % 10 = 0").select((F.col("number") + 1_000_000_000).alias("number"), F.lit("new").alias("title"), F.lit(1.0).alias("price"), F.array(F.lit("title"), F.lit("price")).alias("present"))
    return Z.upsert(old, cleared.unionByName(priced).unionByName(new), "number", ["title", "price"])


@query("""with l as (select l_orderkey as number, l_linenumber as line, max(l_quantity) as quantity from lineitem group by 1, 2), s as (select *, number % 4 as m from l)
  select number, line, case when m in (0, 1) and line <= 2 then quantity + 100 else quantity end as quantity from s where m <> 0 or line <= 2""")
def replaced_children(spark, sf_dir):
    """Whole sections replace, partial ones refresh, absent ones leave alone."""
    old = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("number"), F.col("l_linenumber").alias("line")).agg(F.max("l_quantity").alias("quantity"))
    batch = old.where("line <= 2").withColumn("quantity", F.col("quantity") + 100)
    m = F.col("number") % 4
    sections = old.select("number").distinct().select("number", m.isin(0, 1).alias("carried"), (m == 0).alias("whole"))
    return Z.replace_children(old, batch, sections, "number", ["line"])


@query("""select doc_id as number, 'edit' as origin, length(text) as size from documents where doc_id % 5 = 0 and text is not null union all select doc_id, 'deleted', length(text) from documents where doc_id % 5 = 1""")
def displaced_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("number"), F.col("doc_id").alias("key"), "text")
    batch = docs.where("number % 5 <> 1").withColumn("text", F.when(F.col("number") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    sections = docs.select("number", (F.col("number") % 5 != 2).alias("carried"), F.lit(True).alias("whole"))
    found = Z.displaced(docs, batch, sections, "number", "key", "text", F.lit(1))
    return found.select("number", "origin", F.char_length("content").cast("long").alias("size"))


@query("select o_orderkey as number, 'refresh' as action from orders where o_orderkey % 9 = 0 and o_orderkey % 2 = 1")
def torn_rows(spark, sf_dir):
    listing = _orders(spark, sf_dir).select("number", (F.col("number") % 100).alias("updated"))
    detail = listing.select("number", (F.col("updated") + F.when((F.col("number") % 9 == 0) & (F.col("number") % 2 == 1), 1).otherwise(0)).alias("updated"))
    return Z.torn(listing, detail, "number", "updated", refreshes=1)


@query("select o_orderkey as number, case when o_orderkey % 2 = 0 then 'deleted' else 'transferred' end as status from orders where o_orderkey % 25 = 0 and o_orderkey % 3 <> 0")
def deleted_items(spark, sf_dir):
    stored = _orders(spark, sf_dir)
    missing = (F.col("number") % 25) == 0
    verdicts = stored.where(missing).select("number", F.when(F.col("number") % 3 == 0, "present").when(F.col("number") % 2 == 0, "deleted").otherwise("transferred").alias("status"))
    return Z.deletions(stored, stored.where(~missing), verdicts, "number", drained=True)


@query("select event_type as k, sum(case when rk <= had then 1 else 0 end)::bigint as covered, count(*) as delivered from (select event_type, user_id, row_number() over (partition by event_type, user_id) as rk, count(*) filter (event_id % 2 = 0) over (partition by event_type, user_id) as had from events) group by 1")
def covered_deliveries(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("k"), F.col("user_id").alias("d"), "event_id")
    found = Z.covered(rows.select("k", "d"), rows.where("event_id % 2 = 0").select("k", "d"), "k", "d")
    return found.groupBy("k").agg(F.count_if("covered").alias("covered"), F.count("*").alias("delivered"))


@query("""select repo, number, sha256('{"author":"' || author || '","kind":"pr","number":' || number || ',"paths":[' || coalesce((select string_agg('{"path":"' || path || '"}', ',' order by path) from f_pr_files p where p.number = i.number), '') || '],"repo":"' || repo || '","state":"' || state || '"}') as hash from f_items i where kind = 'pr'""", "items", "pr_files")
def export_lines(spark, sf_dir):
    f = Forge(spark, sf_dir)
    items = f.items.where("kind = 'pr'").select("repo", "number", "kind", "state", "author")
    return B.lines(items, {"paths": f.pr_files.select("number", "path")}).select("repo", "number", "hash")


@query("""also h as (select repo, number, sha256('{"number":' || number || ',"repo":"' || repo || '"}') as hash from f_items), p as (select repo, number // 10000 as range, count(*) as n, sha256(string_agg(hash, '' order by number)) as h from h group by all)
  select repo, sum(n)::bigint as items, sha256(string_agg(h, '' order by range)) as hash from p group by repo""", "items")
def corpus_hashes(spark, sf_dir):
    return B.corpus_hash(B.lines(Forge(spark, sf_dir).items.select("repo", "number"), {}))


@query("""also e as (select i.repo, 'item' as src_type, number::varchar as src, 'file' as dst_type, path as dst from f_pr_files join f_items i using (number) union all select repo, 'actor', author, 'item', number::varchar from f_items),
  s as (select repo, 'item' as type, number::varchar as id from f_items), n as (select repo, src_type as type, src as id from e union select repo, dst_type, dst from e)
  select repo, type, id, true as stored from s union all select repo, type, id, false from n where not exists (select 1 from s where s.repo = n.repo and s.type = n.type and s.id = n.id)""", "items", "pr_files")
def typed_nodes(spark, sf_dir):
    f = Forge(spark, sf_dir)
    edges = E.payload_edges(f.items, f.labels.limit(0), f.pr_files)
    return B.graph(f.items, edges)[0]


@query("""with s as (select case when o_custkey % 2 = 0 then 'Acme/A' else 'acme/a' end as repo, o_custkey as number, o_orderkey as updated from orders) select 'acme/a' as repo, number, max(updated) as updated from s group by number""")
def folded_names(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.when(F.col("o_custkey") % 2 == 0, "Acme/A").otherwise("acme/a").alias("repo"), F.col("o_custkey").alias("number"), F.col("o_orderkey").alias("updated"))
    return B.folded(rows, "repo", ["number"], "updated")


@query("""select repo, 'items' as source, count(*) as rows from f_items group by repo union all select repo, 'pr_files', count(*) from f_pr_files join f_items using (number) group by repo""", "items", "pr_files")
def recounts(spark, sf_dir):
    f = Forge(spark, sf_dir)
    return B.recounted({"items": f.items, "pr_files": f.of_items("pr_files")})


@query("""with a as (select 'acme/x' as repo, o_orderkey as number, 'old' as origin, o_orderkey % 2 as side from orders union all select 'acme/y', o_orderkey, 'old', 0 from orders)
  select repo, case when side = 1 then 'new' else origin end as origin, count(*) as rows from a group by all""")
def adopted_revisions(spark, sf_dir):
    """A store whose revisions of odd items a candidate replaces; another repository and even items stay."""
    numbers = _orders(spark, sf_dir).select("number")
    of = lambda repo, origin: numbers.select(F.lit(repo).alias("repo"), "number", F.lit(origin).alias("origin"))
    store = of("acme/x", "old").unionByName(of("acme/y", "old"))
    out = B.adopt({"revisions": store}, {"revisions": of("Acme/X", "new").where("number % 2 = 1").withColumn("repo", F.lit("acme/x"))}, "Acme/X")
    return out["revisions"].groupBy("repo", "origin").agg(F.count("*").alias("rows"))


# ---- evaluation, bundles, packets

SPLIT = 800_000_000
_FIXES = REFS + """tl as (select l.number, m.number as pr from f_timeline l join f_items i using (number) join f_items m on m.merge_commit = l.commit_id and m.repo = i.repo where type = 'closed'),
  fx as (select number as kase, ref as answer from r where rel = 'closes_keyword' union select pr, number from tl union select number, ((number // 2) % 120) * 2 + 1 from f_items where merged is not null and (number // 2) % 4 = 0), fc as (select kase, answer from fx where kase in (select number from f_items where merged is not null) and answer in (select number from f_items where kind = 'issue')),
  """


def _closing(f: Forge) -> DataFrame:
    return E.keyword_edges(f.items).unionByName(E.commit_edges(f.of_items("commits"))).unionByName(E.timeline_edges(f.of_items("timeline"), f.items))


@query(_FIXES + "z as (select 1) select kase as \"case\", answer from fc".replace('as "case"', "as fix"), "items", "timeline")
def fix_cases(spark, sf_dir):
    f = Forge(spark, sf_dir)
    return V.fix_cases(_closing(f), f.items).select(F.col("case").alias("fix"), "answer")


@query(_FIXES + "tp as (select distinct x.answer as a, y.answer as b from fc x join fc y on x.kase = y.kase and x.answer < y.answer where x.kase in (select kase from fc group by 1 having count(*) between 2 and 50)) select a, b from tp", "items", "timeline")
def truth_pairs(spark, sf_dir):
    f = Forge(spark, sf_dir)
    return V.truth_pairs(V.fix_cases(_closing(f), f.items))


@query(_FIXES + "z as (select 1) select count(*) as pairs, count(*) filter (i.merged <= 800000000) as merged_before, count(*) filter (j.closed <= 800000000) as closed_before from fc join f_items i on i.number = kase join f_items j on j.number = answer", "items", "timeline")
def leakage(spark, sf_dir):
    f = Forge(spark, sf_dir)
    return V.leakage(V.fix_cases(_closing(f), f.items), f.items, SPLIT)


_LOCALISE = """also mf as (select distinct number, path, merged from f_pr_files join f_items using (number) where merged is not null and (status is null or status <> 'removed')), od as (select number, path from mf where merged <= 800000000),
  bk as (select * from od where number in (select number from od group by 1 having count(*) between 2 and 50)), nb as (select path, count(*) as n from bk group by 1),
  cp as (select x.path as fa, y.path as fb, count(*) as support, any_value(n) as na from bk x join bk y on x.number = y.number and x.path <> y.path join nb on nb.path = x.path group by 1, 2),
  tr as (select number as kase, path as answer from mf where merged > 800000000), sd as (select kase, min(answer) as fa from tr group by 1), wn as (select t.* from tr t join sd using (kase) where answer <> fa),
  rk as (select kase, fb as answer, row_number() over (partition by kase order by support desc, support / na desc, fb) as rank from sd join cp using (fa)),
  n as (select kase, count(*) as n from wn group by 1), s as (select kase, count(*) filter (rank <= 5) as s from rk group by 1), h as (select kase, count(*) filter (rank <= 5) as h, min(rank) as f from rk join wn using (kase, answer) group by 1)
  """


@query(_LOCALISE + """select count(*) as cases, round(avg(coalesce(h / n, 0)), 9) as recall, round(avg(coalesce(h / s, 0)), 9) as precision, round(avg(coalesce(1.0::double / f, 0)), 9) as mrr, round(avg(coalesce((f <= 1)::int, 0)), 9) as top1,
  round(avg(coalesce((f <= 3)::int, 0)), 9) as top3, round(avg(coalesce((f <= 5)::int, 0)), 9) as acc from n left join h using (kase) left join s using (kase)""", "items", "pr_files")
def eval_localise(spark, sf_dir):
    f = Forge(spark, sf_dir)
    old, later = V.split(I.merged_files(f.pr_files, f.items), SPLIT)
    coupled = cut(Y.coupled(old, f.items.limit(0).select(F.lit("").alias("path"))), "eval-coupled")
    return V.ranking(*V.localise(coupled, later), 5)


@query(REFS + """du as (select distinct least(number, ref) as a, greatest(number, ref) as b from r where rel = 'duplicate_keyword'), pd as (select number as kase, least(number, ref) as a, greatest(number, ref) as b from r where rel = 'mentions' and number % 2 = 1),
  hp as (select kase, pd.a, pd.b, (du.a is not null)::int as hit from pd left join du on du.a = pd.a and du.b = pd.b), mi as (select count(*) as predicted, sum(hit)::bigint as hits from (select distinct a, b, hit from hp))
  select predicted, hits, round(hits / predicted, 9) as precision, round(hits / (select count(*) from du), 9) as recall, (select round(avg(p), 9) from (select avg(hit) as p from hp group by kase)) as macro_precision from mi""", "items")
def eval_pairs(spark, sf_dir):
    """Mentions among issues as a prediction of duplicates."""
    f = Forge(spark, sf_dir)
    edges = cut(E.keyword_edges(f.items), "eval-edges")
    issues = f.items.where("kind = 'issue'").select(F.col("number").alias("a"))
    found = T3.item_edges(edges, ("mentions",)).join(issues, "a", "left_semi")
    return V.pairs(found.select(F.col("a").alias("case"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), V.duplicate_pairs(edges))


@query(None)
def bundles(spark, sf_dir):
    """Bundles of the best open issues (their number is the feature)."""
    f = Forge(spark, sf_dir)
    top = [(r["number"], r["total"]) for r in T3.with_rank(_scored(f)).where("rank <= 50").select("number", F.round("total", 9).alias("total")).collect()]
    pool = F.col("number").isin([n for n, _ in top])
    merged, _, paths, signatures, neighbours = _evidence(f)
    hubs = cut(Y.hub_files(merged, f.items), "bundle-hubs")
    own = cut(Y.profiles(*[t.where(pool) for t in (f.items, f.labels, paths, signatures, neighbours)], hubs), "bundle-profiles")
    coupled = cut(Y.coupled(merged, hubs, paths.where(pool).select("path")), "bundle-coupled")
    scored = cut(U.pool_pairs(own, f.items, coupled, f.items.where(pool)), "bundle-pairs")
    pairs = U.judged(scored)
    files = {r["number"]: frozenset(r["paths"]) for r in own.select("number", "paths").collect()}
    found = U.grow([U.Member(n, s, files.get(n, frozenset())) for n, s in top], pairs, U.merge_candidates(pairs), {r["path"] for r in hubs.collect()}, U.Rules(floor=0.5))
    return spark.createDataFrame([(b["id"], i, n, b["score"]) for b in found for i, n in enumerate(b["members"])], "id string, place int, number long, score double")


@query("select event_type, count(*) as events, count(json_extract_string(props, '$.k')) as with_k, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as sum_k from events group by 1")
def event_signals(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", P.signal(F.col("props"), "k", kind="bigint").alias("k"))
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if("k.present").alias("with_k"), F.sum("k.value").alias("sum_k"))


@query("select rel, count(*) as edges from (" + (f"with {G.views('items')}, " + REFS.removeprefix("also ") + "z as (select 1) select rel, evidence from r") + ") where evidence ilike 'BODY@%' and not evidence ilike '%CLOSING%' group by rel")
def edges_by_evidence(spark, sf_dir):
    """Evidence is matched whatever its case."""
    found = E.keyword_edges(Forge(spark, sf_dir).items).where(F.ilike("evidence", F.lit("BODY@%")) & ~F.ilike("evidence", F.lit("%CLOSING%")))
    return found.groupBy("rel").agg(F.count("*").alias("edges"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
