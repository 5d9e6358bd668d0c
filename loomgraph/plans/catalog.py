"""Registered queries over the corpus, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import corpus as C
from ..functions import text as T
from ..operators import derived as D
from ..operators import graph as G
from ..operators import reads as R
from . import forge_queries

NOW, AS_OF, FILE, QUERY = "1999-01-01 00:00:00", "2024-01-15 00:00:00", "part/7", ["the", "and", "from"]
#: Views over the source tables under the corpus' names.
VIEWS = """
pulls as (select o_orderkey as number, case when o_orderstatus = 'O' then 'open' else 'closed' end as state, 'c' || o_custkey as author, o_orderdate::timestamp as created_at,
  case when o_orderstatus = 'F' then o_orderdate::timestamp end as merged_at, o_orderpriority as label, 'order ' || o_orderkey as title from orders),
files as (select l_orderkey as number, 'part/' || l_partkey as path, l_quantity::bigint as additions, case when l_returnflag = 'R' then 'removed' else 'modified' end as status from lineitem
  qualify row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_suppkey, l_quantity, l_returnflag) = 1),
merged as (select f.number, path, additions, merged_at from files f join pulls p using (number) where status <> 'removed' and merged_at is not null),
issues as (select doc_id + 1000000000 as number, 's' || source as author, lang as label, coalesce(split_part(text, chr(10), 1), '') as title from documents),
comments as (select conv_id + 1000000000 as number, conv_id * 1000 + turn as comment_id, case role when 'assistant' then 'MEMBER' when 'system' then 'OWNER' else 'NONE' end as association, role || (conv_id % 7) as author from conversations),
item_events as (select event_id, user_id as number, case when event_type = 'error' then 'reopened' else event_type end as type, ts::timestamp as created_at, props from events),
bots as (select 'c' || c_custkey as login from customer where c_custkey % 97 = 0),
baskets as (select number, path from merged where number in (select number from merged group by 1 having count(*) between 2 and 50)),
coupled as (select x.path as a, y.path as b, count(*) as support from baskets x join baskets y on x.number = y.number and x.path <> y.path group by 1, 2),
counted as (select path, count(*) as n from baskets group by 1),
coupling as (select a, b, support, support / ca.n as confidence, (select count(distinct number) from baskets) * support / (ca.n * cb.n) as lift from coupled join counted ca on ca.path = a join counted cb on cb.path = b),
hubs as (select path, count(distinct number) as prs, count(distinct number) / (select count(*) from pulls where merged_at is not null) as share from merged group by 1),
edges as (select 'actor' as src_type, author as src, 'authored' as rel, 'item' as dst_type, number::varchar as dst from pulls
  union all select 'item', number::varchar, 'has_label', 'label', label from pulls union all select 'item', number::varchar, 'touches', 'file', path from files)"""
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = (f"with {VIEWS}, " if sql.lstrip().startswith("also ") else f"with {VIEWS}\n") + sql.lstrip().removeprefix("also ")
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("select * from coupling")
def coupling(spark, sf_dir):
    return D.coupling(C.load(spark, sf_dir))


@query("select * from coupling where a = 'part/7' order by support desc, b limit 20")
def coupling_partners(spark, sf_dir):
    return D.partners(C.load(spark, sf_dir), FILE, 20)


@query("select * from merged")
def merged_pr_files(spark, sf_dir):
    return C.merged_pr_files(C.load(spark, sf_dir)).select("number", "path", "additions", "merged_at")


@query("select 'pr' as kind, state, count(*) as items, sum(strlen(title))::bigint as title_bytes from pulls group by all union all select 'issue', 'open', count(*), sum(strlen(title))::bigint from issues")
def status_counts(spark, sf_dir):
    return R.status_counts(C.load(spark, sf_dir))


@query("select path, count(*) as changes, sum(additions)::bigint as additions from merged group by 1")
def churn(spark, sf_dir):
    return R.churn(C.load(spark, sf_dir))


@query("select number, author, created_at from pulls where state = 'open' and label = '1-URGENT' and author not in (select login from bots) order by created_at desc, number desc limit 50 offset 10")
def open_items(spark, sf_dir):
    return R.open_items(C.load(spark, sf_dir), "pr", "1-URGENT", 50, 10)


@query("select number, author from pulls where author not in (select login from bots)")
def without_bots(spark, sf_dir):
    corpus = C.load(spark, sf_dir)
    return R.without_bots(corpus.items.where("kind = 'pr'"), corpus.actors).select("number", "author")


@query("select path, changes from (select path, count(*) as changes from merged group by 1) where changes < 5 or (changes = 5 and path > 'part/5') order by changes desc, path limit 30")
def keyset_page(spark, sf_dir):
    return R.page_after(R.churn(C.load(spark, sf_dir)).select("path", "changes"), "changes", "path", (5, "part/5"), 30)


@query("select number, status, additions, state, author, created_at from files join pulls using (number) where path = 'part/7'")
def file_history(spark, sf_dir):
    return R.file_history(C.load(spark, sf_dir), FILE)


@query("select number, count(*) as shared, string_agg(path, ',' order by path) as paths from files where number <> 1 and path in (select path from files where number = 1) group by 1")
def pr_overlap(spark, sf_dir):
    return R.pr_overlap(C.load(spark, sf_dir), 1)


@query("""select number, comment_id, association, rank from (select *, row_number() over (partition by number order by case when comment_id = first then 0 when comment_id = last then 1
  when association = 'OWNER' then 2 else 3 end, comment_id desc)::int as rank from (select *, min(comment_id) over (partition by number) as first, max(comment_id) over (partition by number) as last from comments)) where rank <= 4""")
def capped_comments(spark, sf_dir):
    return R.capped_comments(C.load(spark, sf_dir), 4)


@query("select number, count(distinct author) as participants from (select number, author from comments union all select number, author from issues) group by 1")
def participants(spark, sf_dir):
    return R.participants(C.load(spark, sf_dir))


@query("select number, count(*) filter (type = 'reopened') as reopens, count(*) as events from item_events group by 1")
def event_counts(spark, sf_dir):
    return R.event_counts(C.load(spark, sf_dir))


@query("select number, event_id, type, rank from (select *, row_number() over (partition by number order by created_at desc, event_id desc)::int as rank from item_events) where rank <= 5")
def newest_events(spark, sf_dir):
    return R.newest_events(C.load(spark, sf_dir), 5)


@query("select number, event_id, type from (select *, lag(type) over (partition by number order by created_at, event_id) as before from item_events) where before is null or before <> type")
def collapsed_events(spark, sf_dir):
    return R.collapsed(C.load(spark, sf_dir))


@query("""select number, arg_max(type, event_id) as content, max(event_id) as id from (select *, lead(created_at) over (partition by number order by created_at, event_id) as until from item_events)
  where created_at <= timestamp '2024-01-15' and (until is null or until > timestamp '2024-01-15') group by 1""")
def text_as_of(spark, sf_dir):
    return R.text_as_of(R.revisions(C.load(spark, sf_dir)), AS_OF)


@query("select number, type, created_at from item_events qualify row_number() over (partition by number order by created_at desc, event_id desc) = 1")
def last_wins(spark, sf_dir):
    return R.last_wins(C.load(spark, sf_dir).item_events, ["number"], [F.desc("created_at"), F.desc("event_id")]).select("number", "type", "created_at")


@query("select number, substring(string_agg(type, '; ' order by s), 1, 512) as evidence from (select number, type, min(event_id) as s from item_events group by 1, 2) group by 1")
def merged_evidence(spark, sf_dir):
    return R.merged_evidence(C.load(spark, sf_dir).item_events, ["number"], "event_id", "type")


@query("""select state, count(*) as items, count(merged_at) as merged from (select case when merged_at > timestamp '1996-06-01' then 'open' else state end as state,
  case when merged_at <= timestamp '1996-06-01' then merged_at end as merged_at from pulls where created_at <= timestamp '1996-06-01') group by 1""")
def corpus_as_of(spark, sf_dir):
    return C.load(spark, sf_dir).as_of("1996-06-01 00:00:00").items.groupBy("state").agg(F.count("*").alias("items"), F.count("merged_at").alias("merged"))


@query("select path, prs, share from hubs")
def hub_share(spark, sf_dir):
    return D.hub_share(C.load(spark, sf_dir))


@query("""also heat as (select path, sum(exp(-((epoch(timestamp '1999-01-01') - epoch(merged_at)) / 86400.0) / 45.0)) as heat from merged group by 1)
  select path, round(heat / (select max(heat) from heat), 6) as hotspot from heat""")
def hotspots(spark, sf_dir):
    return D.hotspots(C.load(spark, sf_dir), NOW)


@query("""also w as (select f.number, f.path, case when h.share >= 0.5 then 0.25 else 1.0 end::double as w from files f left join hubs h using (path) where status <> 'removed'),
  z as (select number, sum(w) as size from w group by 1),
  s as (select x.number as a, y.number as b, sum(x.w) as shared from w x join w y using (path) join pulls p on p.number = x.number and p.state = 'open' join pulls q on q.number = y.number and q.merged_at is not null group by 1, 2),
  t as (select a, b, shared / (za.size + zb.size - shared) as score from s join z za on za.number = a join z zb on zb.number = b)
  select a, b, round(score, 9) as score, rank from (select *, row_number() over (partition by a order by score desc, b)::int as rank from t) where rank <= 3""")
def similar_items(spark, sf_dir):
    return D.similar(C.load(spark, sf_dir), 3)


@query("""also own as (select f.number, path as a from files f join pulls using (number) where status <> 'removed' and state = 'open'),
  found as (select number, b, max(confidence) as confidence, arg_max(support, confidence * 1e6 + support) as support from own join coupling using (a) group by 1, 2),
  kept as (select f.* from found f where not exists (select 1 from own o where o.number = f.number and o.a = f.b))
  select number, b as path, round(confidence, 9) as confidence, rank from (select *, row_number() over (partition by number order by confidence desc, support desc, b)::int as rank from kept) where rank <= 3""")
def localised_files(spark, sf_dir):
    return D.localised(C.load(spark, sf_dir), 3)


@query("""also c as (select number, count(*) as n, count(distinct author) as p from comments group by 1), e as (select number, count(*) filter (type = 'reopened') as r from item_events group by 1)
  select number, round(coalesce((least(1.0::double, p / 3) + least(1.0::double, n / 5)) / 2, 0) + 0.5 * coalesce(least(1.0::double, r / 1), 0), 9) as stage1 from issues left join c using (number) left join e using (number)""")
def triage_stage1(spark, sf_dir):
    return D.triage(C.load(spark, sf_dir), {"demand": 1.0, "risk": 0.5})


@query("""also truth as (select number as kase, path as answer from baskets), seeds as (select kase, min(answer) as seed from truth group by 1),
  ranked as (select kase, b as answer, row_number() over (partition by kase order by support desc, b) as rank from seeds join coupling on a = seed),
  wanted as (select kase, answer from truth t where answer <> (select min(answer) from truth u where u.kase = t.kase)),
  n as (select kase, count(*) as n from wanted group by 1), h as (select kase, count(*) filter (rank <= 5) as h, min(rank) as f from ranked join wanted using (kase, answer) group by 1)
  select count(*) as cases, round(avg(coalesce(h, 0) / n), 9) as recall, round(avg(coalesce(1.0::double / f, 0)), 9) as mrr from n left join h using (kase)""")
def ranking_metrics(spark, sf_dir):
    from pyspark.sql import Window

    corpus = C.load(spark, sf_dir)
    truth = D.baskets(corpus).select(F.col("number").alias("case"), F.col("path").alias("answer"))
    seeds = truth.groupBy("case").agg(F.min("answer").alias("a"))
    ranked = seeds.join(D.coupling(corpus), "a").withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("support"), "b"))).select("case", F.col("b").alias("answer"), "rank")
    wanted = truth.join(seeds, "case").where("answer <> a").select("case", "answer")
    return D.ranking_metrics(ranked, wanted, 5)


@query("select src_type, src, rel, dst_type, dst, 'out' as way from edges where src_type = 'item' and src = '7' union all select src_type, src, rel, dst_type, dst, 'in' from edges where dst_type = 'item' and dst = '7' and not (src_type = 'item' and src = '7')")
def incident_edges(spark, sf_dir):
    return G.incident(G.edges(C.load(spark, sf_dir)), "item", "7")


@query("""also s as (select src as u, dst as v from edges where rel = 'touches' union all select dst, src from edges where rel = 'touches'),
  d1 as (select distinct v from s where u = '1'), d2 as (select distinct v from s where u in (select v from d1) and v <> '1'), d3 as (select distinct v from s where u in (select v from d2) and v not in (select v from d1) and v <> '1')
  select 'item' as type, '1' as id, 0 as distance union all select 'file', v, 1 from d1 union all select 'item', v, 2 from d2 union all select 'file', v, 3 from d3""")
def neighbourhood(spark, sf_dir):
    return G.neighbourhood(G.edges(C.load(spark, sf_dir)), "item", "1", 3)


@query(None)
def shortest_path(spark, sf_dir):
    return G.shortest_path(G.edges(C.load(spark, sf_dir)), ("item", "1"), ("file", "part/7"))


@query("""also i as (select 'item' as type, number::varchar as id from pulls), e as (select src_type as type, src as id from edges union select dst_type, dst from edges)
  select type, id, true as stored from i union all select type, id, false from e where not exists (select 1 from i where i.type = e.type and i.id = e.id)""")
def export_nodes(spark, sf_dir):
    corpus = C.load(spark, sf_dir)
    return G.export_nodes(corpus, G.edges(corpus))


TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda w: length(w) >= 3 and w not in ({})))".format(", ".join(f"'{w}'" for w in "and are bug but can close closed could error file fix fixed for from has have into issue may merge merged might not pull request should test tests that the their then there this was were what when which will with would you your".split()))


@query(f"select term, count(*) as df, round(ln(1 + (select count(*) from documents) / count(*)), 9) as idf from (select unnest({TOKENS}) as term from documents) group by 1")
def term_weights(spark, sf_dir):
    return T.term_weights(_docs(spark, sf_dir))


_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) as tf{i}" for i, q in enumerate(QUERY))
_DF = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(QUERY)))
_SCORE = " + ".join(f"ln(1 + (total - df{i} + 0.5::double) / (df{i} + 0.5::double)) * tf{i} * 2.2::double / (tf{i} + 1.2::double * (0.25::double + 0.75::double * len / mean))" for i in range(len(QUERY)))


@query(f"""also w as (select doc_id as key, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') as w from documents), r as (select key, len(w) as len, {_TF} from w),
  s as (select count(*) as total, avg(len) as mean, {_DF} from r)
  select key, case when tf0 > 0 and tf1 > 0 and tf2 > 0 then 1 else 0 end as strict, round({_SCORE}, 6) as score from r, s where tf0 > 0 or tf1 > 0 or tf2 > 0 order by strict desc, score desc, key limit 25""")
def search(spark, sf_dir):
    return T.search(_docs(spark, sf_dir), QUERY, 25)


_BODY = "'Fixes #' || o_custkey || ', resolves: #' || o_orderkey || ' and see #' || (o_orderkey % 7) || ' closed this acme/app#8 fix https://github.com/acme/app/pull/9'"


@query("select o_orderkey as number, o_custkey || ',' || o_orderkey || ',8,9' as closes from orders")
def closing_numbers(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("number"), F.array_join(T.closing_numbers(F.expr(_BODY)).cast("array<string>"), ",").alias("closes"))


@query("select o_orderkey as number, array_to_string(regexp_extract_all('fix/' || o_custkey || '-v2-' || o_orderkey, '(?:^|[^A-Za-z0-9])(\\d+)', 1), ',') as tokens from orders")
def branch_tokens(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("number"), F.array_join(T.branch_tokens(F.expr("'fix/' || o_custkey || '-v2-' || o_orderkey")), ",").alias("tokens"))


@query("""also r as (select distinct p_size || '/' || (p_partkey % 50) as ref from part), v as (select 'src/' || p_brand || '/' || p_size || '/' || p_partkey as path, p_size || '/' || p_partkey as tail from part)
  select ref, min(path) as path from r join v on tail = ref group by 1 having count(*) = 1""")
def suffix_join(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    refs = part.select(F.expr("p_size || '/' || (p_partkey % 50)").alias("ref"))
    return T.suffix_join(refs, part.select(F.expr("'src/' || p_brand || '/' || p_size || '/' || p_partkey").alias("path")))


@query("select number, sha256(length(number::varchar) || ':' || number || '|' || length(state) || ':' || state || '|' || length(author) || ':' || author || '|' || length(label) || ':' || label) as hash from pulls")
def content_hash(spark, sf_dir):
    items = C.load(spark, sf_dir).items.where("kind = 'pr'")
    return items.select("number", T.content_hash(F.col("number"), F.col("state"), F.col("author"), F.col("label")).alias("hash"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | forge_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | forge_queries.oracle_sql()
