"""The registered queries of the training-data operators and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, exact_dedup, license_scan, mixing, ngram_join, sentence_spans, toxicity, url_filter, warc
from .common import documents

DOMAIN = "case when source = 'src0' then 'web' when length(source) = 4 then 'books' else 'forums' end"
WEIGHTS = {"domain": {"web": 30, "books": 50, "forums": 20}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {"src10": 3, "src1": 2}}
BUDGET_PERCENT, EPOCHS, SEED = 60, 2, 7
#: The share of its input's tokens that the pipeline's mixture asks for.
PIPELINE_PERCENT = 80
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
BPE_FILE = "byte_bpe_50k.tiktoken"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), WEIGHTS, BUDGET_PERCENT, EPOCHS, SEED, DOMAIN)


def op2_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embed_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sentence_spans.sentence_dedup(documents(spark, sf_dir))
    return cut.select("doc_id", "n_sentences", "n_removed", "words_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir), n=4, percent=85)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(BPE_FILE))
    encoded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_text=False)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        bpe.n_ids(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


OP10_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256 from d
"""


def _pour_sql(name: str, above: str, key: str, weights: dict[str, int], given: str) -> str:
    """CTEs that pour the budgets of `given`(above, budget) over the distinct `key`s below."""
    cols = [c for c in above.split(", ") if c]
    own, part = ", ".join([*cols, key]), f"partition by {above}" if above else ""
    order = f"over ({part} order by ratio, {key}"
    weight = "case " + " ".join(f"when {key} = '{k}' then {v}" for k, v in weights.items()) + " else 1 end"
    return f"""
{name}_n as (select {own}, sum(tokens) * {EPOCHS} as cap, {weight} as w from leaves group by {own}),
{name}_b as (select n.*, g.budget, case when w > 0 then cap::double / w else 'infinity'::double end as ratio from {name}_n n join {given} g {f"using ({above})" if above else "on true"}),
{name}_w as (select *, coalesce(sum(cap) {order} rows between unbounded preceding and 1 preceding), 0) as prev,
  sum(w) {order} rows between current row and unbounded following) as rest from {name}_b),
{name}_f as (select *, w > 0 and cap::hugeint * rest::hugeint <= w::hugeint * (budget - prev)::hugeint as filled from {name}_w),
{name}_l as (select *, budget - coalesce(sum(case when filled then cap end) over ({part}), 0) as remains,
  coalesce(sum(case when not filled then w end) over ({part}), 0) as opened from {name}_f),
{name}_s as (select *, case when filled then cap when opened = 0 then 0 else (w::hugeint * remains::hugeint) // opened::hugeint end as base,
  case when filled or w = 0 or opened = 0 then -1 else (w::hugeint * remains::hugeint) % opened::hugeint end as frac from {name}_l),
{name}_o as (select *, remains - coalesce(sum(case when not filled then base end) over ({part}), 0) as odd,
  row_number() over ({part} order by frac desc, {key}) as rk from {name}_s),
{name} as (select {own}, (base + case when frac >= 0 and rk <= odd then 1 else 0 end)::bigint as budget from {name}_o)"""


OP1_SQL = f"""
with d as (select doc_id, coalesce({DOMAIN}, '(none)') as domain, coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from d group by all),
root as (select least(sum(tokens) * {BUDGET_PERCENT} // 100, sum(tokens) * {EPOCHS}) as budget from leaves),
{_pour_sql("l1", "", "domain", WEIGHTS["domain"], "root")},
{_pour_sql("l2", "domain", "lang", WEIGHTS["lang"], "l1")},
{_pour_sql("l3", "domain, lang", "source", WEIGHTS["source"], "l2")},
p as (select d.*, case when tokens = 0 then 0 else budget // tokens end as full_epochs, case when tokens = 0 then 0 else budget % tokens end as tail
  from d join leaves using (domain, lang, source) join l3 using (domain, lang, source)),
c as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5(concat_ws(':', '{SEED}', full_epochs::varchar, doc_id::varchar)), doc_id
  rows between unbounded preceding and 1 preceding), 0) as before from p)
select doc_id, domain, lang, source, n_tokens, full_epochs::bigint as full_epochs, greatest(0, least(n_tokens, tail - before))::bigint as tail_tokens,
  (full_epochs * n_tokens + greatest(0, least(n_tokens, tail - before)))::bigint as tokens_taken from c
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix_sources, op2_warc_normalise, op3_embed_dedup, op4_toxicity, op5_url_filter, op6_license_scan, op7_sentence_spans, op8_ngram_join, op9_byte_bpe, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op10_exact_dedup": OP10_SQL}
