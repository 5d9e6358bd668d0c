"""A whole project history bound to the star-schema tables: one SQL text a table, which Spark and the SQL checks both run.

Odd numbers are issues (from documents), even ones pull requests (from orders). Bodies are the stored texts with references,
frames, task lists, claims and links that their keys determine, so that what must be extracted is known without extracting it.
Instants are seconds since 1970. `epoch(x)` stands for the engine's own function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPO = "acme/app"
#: The instant of the youngest rows, for ages.
NOW = 1_700_000_000
NL = "chr(10)"
TABLES = {
    "items": f"""select case when o_custkey % 10 = 0 then 'acme/lib' else '{REPO}' end as repo, o_orderkey * 2 as number, 'pr' as kind, case when o_orderkey % 77 = 1 then 'Revert "Change ' || (o_orderkey - 1) || '"' else 'Change ' || o_orderkey end as title,
  case o_orderkey % 5 when 0 then 'Fixes #' || ((o_orderkey % 200) * 2 + 1) || ' and see #' || ((o_orderkey % 90) * 2 + 1) when 1 then 'Resolves this {REPO}#' || ((o_orderkey % 70) * 2 + 1) || ', other/repo#7'
    when 2 then 'closes: https://github.com/{REPO}/issues/' || ((o_orderkey % 40) * 2 + 1) when 3 then '`fixes #11` and comment #12' else 'plain' end as body,
  case when o_orderstatus = 'O' then 'open' else 'closed' end as state, 'c' || o_custkey as author, case o_custkey % 4 when 0 then 'OWNER' when 1 then 'MEMBER' else 'NONE' end as association,
  epoch(o_orderdate) as created, epoch(o_orderdate) + 86400 * (o_orderkey % 30) as updated, case when o_orderstatus <> 'O' then epoch(o_orderdate) + 86400 * (o_orderkey % 30) end as closed,
  case when o_orderstatus = 'F' then epoch(o_orderdate) + 86400 * (o_orderkey % 30) end as merged, case when o_orderstatus = 'F' then 'sha' || o_orderkey end as merge_commit,
  case o_orderkey % 3 when 0 then 'fix/' || ((o_orderkey % 150) * 2 + 1) || '-slug' when 1 then 'fix/' || o_orderkey || '-' || o_custkey else 'v2-topic' end as head_ref,
  cast(o_orderkey % 6 as bigint) as reactions, cast(null as bigint) as due, o_orderkey % 50 = 0 as locked, cast(0 as bigint) as subs, cast(0 as bigint) as subs_done from orders
 union all
 select '{REPO}', doc_id * 2 + 1, 'issue', case when doc_id % 9 = 0 then 'dup of #' || ((doc_id % 30) * 2 + 1) || ' ' else '' end || substr(coalesce(text, ''), 1, 40),
  coalesce(text, '') || case doc_id % 8 when 0 then {NL} || 'See #' || ((doc_id + 5) * 2 + 1) || ' duplicate of #' || ((doc_id % 50) * 2 + 1) when 1 then {NL} || '> quoted #3' || {NL} || '- [ ] #' || ((doc_id + 2) * 2 + 1) || ' todo' || {NL} || '- [x] done #' || ((doc_id + 3) * 2 + 1)
    when 2 then {NL} || '```' || {NL} || 'File "part/' || (doc_id % 300) || '.py", line 7, in run' || {NL} || 'ValueError: bad ' || doc_id || ' at 0x1F' || {NL} || '```' when 3 then {NL} || 'broken in `part/' || (doc_id % 300) || '.py` and part/' || (doc_id % 211) || '.py:3:9' else '' end,
  case when doc_id % 3 = 0 then 'closed' else 'open' end, 's' || coalesce(source, ''), 'NONE', {NOW} - 3600 * (doc_id % 9000), {NOW} - 1800 * (doc_id % 9000), case when doc_id % 3 = 0 then {NOW} - 1800 * (doc_id % 9000) end, cast(null as bigint), cast(null as varchar(9)), cast(null as varchar(9)),
  cast(doc_id % 7 as bigint), case when doc_id % 11 = 0 then {NOW} + 86400 * (doc_id % 40 - 5) end, doc_id % 37 = 0, cast(case when doc_id % 13 = 0 then 4 else 0 end as bigint), cast(doc_id % 3 as bigint) from documents""",
    "labels": """select o_orderkey * 2 as number, o_orderpriority as name from orders union all select doc_id * 2 + 1, coalesce(lang, 'none') from documents
 union all select doc_id * 2 + 1, case doc_id % 5 when 0 then 'P0' when 1 then 'priority: low' else 'bug' end from documents""",
    "comments": f"""select conv_id * 2 + 1 as number, conv_id * 1000 + turn as comment_id, case when (conv_id + turn) % 6 = 0 then 'helper[bot]' else role || (conv_id % 7) end as author,
  case role when 'assistant' then 'MEMBER' when 'system' then 'OWNER' else 'NONE' end as association, {NOW} - 3600 * ((conv_id * 7 + turn * 5) % 120) as created,
  case (conv_id + turn) % 5 when 0 then 'Agent claim session=' || lpad(cast(conv_id as varchar(20)), 16, '0') || ' issues=' || (conv_id * 2 + 1) || ',other/x#4' || {NL} || coalesce(text, '')
    when 1 then '**Claim released** session=' || lpad(cast(conv_id as varchar(20)), 16, '0') when 2 then coalesce(text, '') || {NL} || 'as in #' || ((conv_id % 20) * 2 + 1) when 3 then coalesce(text, '') || {NL} || '> Working this issue' else coalesce(text, '') end as body from conversations""",
    "pr_files": """select number, path, max(additions) as additions, max(deletions) as deletions, case when max(kept) = 1 then null when max(kept) = 2 then 'modified' else 'removed' end as status
 from (select l_orderkey * 2 as number, 'part/' || l_partkey || '.py' as path, cast(l_quantity as bigint) as additions, cast(l_linenumber as bigint) as deletions, case l_returnflag when 'A' then 1 when 'N' then 2 else 0 end as kept from lineitem) x group by number, path""",
    "events": """select event_id, (user_id % 100) * 2 + 1 as number, case event_type when 'error' then 'reopened' else event_type end as type, epoch(ts) as created from events""",
    "links": """select doc_id * 2 + 1 as number, 'blocked_by' as kind, (doc_id + 1) * 2 + 1 as other, 'acme/app' as repo, doc_id % 40 = 0 as complete from documents where doc_id % 10 = 0
 union all select doc_id * 2 + 1, 'parent', (doc_id % 12) * 2 + 1, case when doc_id % 4 = 0 then 'other/repo' else 'acme/app' end, true from documents where doc_id % 14 = 0""",
    "commits": """select o_orderkey * 2 as number, 'c0ffee' || o_orderkey as sha, case when o_orderkey % 4 = 0 then 'fix #' || ((o_orderkey % 120) * 2 + 1) else 'work' end as message from orders where o_orderstatus = 'F'""",
    "timeline": """select (o_orderkey % 200) * 2 + 1 as number, 'closed' as type, 'sha' || o_orderkey as commit_id, cast(null as bigint) as source, cast(null as varchar(9)) as source_repo, epoch(o_orderdate) as created from orders where o_orderstatus = 'F' and o_orderkey % 10 = 0
 union all select (o_orderkey % 60) * 2 + 1, 'cross_referenced', null, o_orderkey * 2, case when o_orderkey % 30 = 1 then 'other/repo' else 'acme/app' end, epoch(o_orderdate) from orders where o_orderkey % 15 = 1""",
    "actors": """select 'c' || c_custkey as login, c_custkey % 97 = 0 as bot from customer union all select 'helper[bot]', true""",
}


def sql(name: str, epoch: str = "epoch") -> str:
    return TABLES[name].replace("epoch(", f"{epoch}(")


def views(*names: str) -> str:
    """CTEs of these tables for the SQL checks."""
    return ", ".join(f"f_{n} as ({sql(n).replace('epoch(', 'epoch_ms(').replace('epoch_ms(o_orderdate)', 'cast(epoch(o_orderdate) as bigint)').replace('epoch_ms(ts)', 'cast(floor(epoch(ts)) as bigint)')})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the history; Catalyst prunes what a query leaves out."""
    text = sql(name, "unix_timestamp")
    used = [t for t in ("orders", "documents", "conversations", "lineitem", "events", "customer") if f"from {t}" in text]
    for t in used:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text.replace("unix_timestamp(o_orderdate)", "unix_timestamp(cast(o_orderdate as timestamp))").replace("unix_timestamp(ts)", "unix_timestamp(cast(ts as timestamp))"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
