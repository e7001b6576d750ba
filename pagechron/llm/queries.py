"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read, scratch
from .decontaminate import contaminations
from .embed_dedup import near_vectors, near_vectors_sql
from .encoding import vocabulary
from .hard_negatives import mine_negatives, negatives_sql
from .license_scan import scan_licenses, scan_sql
from .main_text import extract_main_text
from .packing import pack_documents
from .quality import score_quality
from .sharding import shard_by_bytes
from .simhash import near_duplicates
from .source_audit import audit_sources, audit_sql
from .token_ids import read_token_ids, write_token_ids
from .toxicity import score_documents
from .warc import capture_history, write_warc

N_SHARDS = 24
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    return capture_history(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < kept THEN kept END AS refers_to
FROM m"""


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read(spark, sf_dir, "documents"), N_SHARDS)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    write_token_ids(read(spark, sf_dir, "documents"), path, vocabulary(WORD_VOCABULARY), end_id=2)
    return read_token_ids(spark, path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), end_id=1)


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op10_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(read(spark, sf_dir, "embeddings"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict:
    steps = (
        op1_toxicity, op2_main_text, op3_decontaminate, op4_warc, op5_shard, op6_token_ids, op7_packing, op8_license, op9_simhash, op10_embed_dedup,
        op11_hard_negatives, op12_source_audit, op13_quality,
    )
    return {f.__name__: f for f in steps}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the tests hold the others against brute force."""
    return {"op4_warc": WARC_SQL, "op8_license": scan_sql(), "op10_embed_dedup": near_vectors_sql(), "op11_hard_negatives": negatives_sql(), "op12_source_audit": audit_sql()}
