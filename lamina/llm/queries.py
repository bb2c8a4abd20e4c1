"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ads_search import search
from .bpe import encode_decode
from .brown_lm import lm_scores
from .common import table
from .exact_dedup import exact_groups
from .kd_shards import kd_shards
from .license_scan import license_scan
from .mixing import mixing_rates
from .quality import quality_scores
from .simhash import near_groups
from .suffix_dedup import remove_repeats

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Shares of the mix by what the labelled table says of a document.
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")


def op1_ads_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", domain().alias("domain"))
    return mixing_rates(table(spark, sf_dir, "documents"), labelled, TARGETS)


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=40)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=3, radius=2)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ads_search, op2_bpe, op3_quality, op4_exact_dedup, op5_mixing, op6_brown_lm, op7_license_scan, op8_kd_shards, op9_simhash, op10_suffix_dedup)}

ORACLE_SQL = {
    "op4_exact_dedup": """
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents)
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
        from n""",
    "op10_suffix_dedup": """
        with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
        w as (select r, unnest(range(0, len(x) // 2 - 399)) as s, x from d),
        v as (select r, s, md5(substring(x, 2 * s + 1, 800)) as h from w),
        hit as (select r, s from (select r, s, count(*) over (partition by h) as n from v) where n > 1),
        edge as (select r, s, s > lag(s + 400, 1, -1) over (partition by r order by s) as opens from hit),
        run as (select r, s, sum(opens::int) over (partition by r order by s) as k from edge),
        span as (select r, k, min(s) as a, max(s) + 400 as b from run group by all),
        gap as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) as before from span),
        kept as (select r, string_agg(substring(d.x, 2 * before + 1, 2 * (a - before)), '' order by a) as x, max(b) as last, sum(b - a) as gone, count(*) as n from gap join d using (r) group by r)
        select doc_id, len(d.x) // 2 as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0) as n_spans,
               sha256(unhex(case when k.r is null then d.x else k.x || substring(d.x, 2 * last + 1) end)) as kept_sha256,
               (len(d.x) // 2 - coalesce(gone, 0))::bigint as n_kept, coalesce(gone, 0) > 0 as has_repeat
        from d left join kept k using (r)""",
}
