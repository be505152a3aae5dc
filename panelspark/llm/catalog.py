"""The registered queries of this subpackage, over the whole given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm.frames import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Settings for a run; tells the Python workers of this application where the package lies."""
    prepare(spark)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (paths, _ROOT) if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return add


@query("op1_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.secrets import scan_secrets
    return scan_secrets(table(spark, sf_dir, "documents"))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP7_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0) x),
sizes as (select distinct n from bw),
dw as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n) x),
hit as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.s = bw.s),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) x group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct r, cast(item_id as varchar) as item_id from hit where item_id is not null) x group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(words.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(items.n_items, 0) as bigint) as n_items, sha256(coalesce(items.ids, '')) as items_sha256,
  coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words on d.r = words.r left join items on d.r = items.r"""


@query("op7_benchmark_decontamination", OP7_SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.decontaminate import find_contamination
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@query("op8_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.quality import score_quality
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.licenses import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents")).drop("expressions")


@query("op10_mixing_sources")
def mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.mixing import mix_sources
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op4_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.jaccard import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


@query("op3_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.fingerprints import fingerprint_edits
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op6_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.urls import filter_urls
    return filter_urls(table(spark, sf_dir, "pages"))


@query("op2_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.html import extract_text
    return extract_text(table(spark, sf_dir, "pages"))


@query("op5_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.suffixes import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.spelling import spelling_variants as variants
    return variants(table(spark, sf_dir, "documents"))


@query("op11_conversation_prefix_trie")
def conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.prefixes import grafted_trie
    return grafted_trie(table(spark, sf_dir, "conversations"))


@query("op12_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.lm import score_held_out
    return score_held_out(table(spark, sf_dir, "documents"))
