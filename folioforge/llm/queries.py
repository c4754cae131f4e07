"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, line_dedup, packing, quality, repeats, simhash, token_counts, token_shards, toxicity

from .common import shared_folder

OP9_SQL = r"""
WITH words AS (
  SELECT k, id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)
  WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT k, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM words WHERE len(w) >= 5
), items AS (
  SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS q FROM shingles WHERE k = 'b'
)
SELECT d.id AS doc_id, item_id, CAST(q AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared,
       round(count(*) / q, 6) AS containment
FROM shingles d JOIN items USING (s) WHERE d.k = 'd'
GROUP BY d.id, item_id, q HAVING count(*) >= 0.8 * q - 1e-9
"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return token_shards.write_training_order(docs, public_tokenizers.path("word_bpe_49k.json"))[1]


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), with_spans=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", *quality.BASE, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), with_passages=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_read(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", F.round("containment", 6).alias("containment"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache lasts and belongs to the folder of the input: a second run over it encodes nothing."""
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    cache = f"{shared_folder(spark)}/folioforge/token-counts-{name}"
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_simhash, op2_token_shards, op3_line_dedup, op4_toxicity, op5_quality, op6_repeats, op7_packing, op8_html_text, op9_decontamination, op10_token_counts,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": OP9_SQL}
