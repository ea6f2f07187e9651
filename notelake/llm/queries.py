"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import bpe, conversation_repair, hard_negatives as hard, lm, media, ngram_join, packing, pii, quality, secret_scan, sharding, topk_search, url_filter

#: The list of op4: URLs of hosts that have another page with such a title (a word with three symbols at its end).
LISTED_TITLE = "[a-z](%%%|###)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a vocabulary file; the folder is a parameter of the environment, else that of the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def op1_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_url_filter(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return url_filter.url_verdicts(pages, url_filter.urls_beside_marks(pages, LISTED_TITLE))


def op5_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op6_media(spark, sf_dir):
    return media.media_digest(_table(spark, sf_dir, "documents"))


def media_clips(spark, sf_dir):
    """The timed clips of the films of op6, a row each."""
    return media.clips(media.films(_table(spark, sf_dir, "documents")))


def op7_bpe(spark, sf_dir):
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_lm(spark, sf_dir):
    return lm.document_scores(_table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.shuffled_documents(_table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_topk(spark, sf_dir):
    return topk_search.top_scores(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repaired(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark, sf_dir):
    label = F.col("label").cast("long")
    return hard.hard_negatives(_table(spark, sf_dir, "embeddings"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label), F.col("vec_id") % 100 == 0)


_ALL = (
    op1_ngram_join, op2_pii, op3_quality_rules, op4_url_filter, op5_secret_scan, op6_media, media_clips, op7_bpe, op8_lm, op9_sharding, op10_packing,
    op11_topk, op12_conversation_repair, op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in _ALL}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
SQL = {
    "op4_url_filter": f"""
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title
  from pages),
c as (select *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') as canon from p),
g as (select regexp_replace(host, '^(www|m)\\.', '') as site, canon, max(case when regexp_matches(title, '{LISTED_TITLE}') then 1 else 0 end) as mark from c where host <> '' group by 1, 2),
l as (select distinct canon from (select canon, sum(mark) over (partition by site) - mark as others from g) where others > 0),
r as (
  select c.*, case when host = '' then false else l.canon is not null end as listed,
    case when (host = 'example.org' or suffix(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
         when (host = 'example.org' or suffix(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
         when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
         when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
         when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from c left join l on c.canon = l.canon)
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when listed then 'block' else 'allow' end as verdict, listed
from r""",
    "op11_topk": f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where {_FINITE} and vec_id is not null),
m as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from m qualify rank <= 5""",
    "op13_hard_negatives": f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where {_FINITE} and vec_id is not null and label is not null),
m as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.v, c.v) as bigint) as score from v a, v c where a.vec_id % 100 = 0 and c.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from m where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select m.anchor_id, positive_id, cast(row_number() over (partition by m.anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from p join m on m.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score qualify rank <= 10""",
}
