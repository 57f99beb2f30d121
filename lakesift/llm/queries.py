"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm import decontaminate, imatch, jaccard, licenses, linedup, mixing, quality, substrings, toxicity, warc
from lakesift.llm.common import table


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("capture_id", "page_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op7_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.classes(table(spark, sf_dir, "documents")).withColumnRenamed("first_id", "first_doc_id")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op9_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_imatch_fingerprints": op1_imatch_fingerprints,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_quality_trees": op5_quality_trees,
    "op6_benchmark_windows": op6_benchmark_windows,
    "op7_line_edit_join": op7_line_edit_join,
    "op8_mix_sources": op8_mix_sources,
    "op9_toxic_spans": op9_toxic_spans,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_imatch_fingerprints": imatch.fingerprints_sql(),
    "op2_warc_transactions": """
with p as (
    select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as hex,
           min(page_id) over (partition by coalesce(html, '')) as head
    from pages
)
select page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, cast(5 * (i // 4) + 1 as bigint), 5))::int >> cast(15 - 5 * (i % 4) as int)) & 31), 1)), 'string_agg', '') as payload_digest,
       case when page_id is not distinct from head then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from head then head end as refers_to
from p""",
    "op4_license_scan": licenses.scan_sql(),
}
