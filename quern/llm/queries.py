"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import documents
from quern.llm.exact import exact_duplicates
from quern.llm.licences import licences
from quern.llm.mixing import MIX_SQL, mix
from quern.llm.packing import pack
from quern.llm.secrets import secrets
from quern.llm.sharding import shard
from quern.llm.simhash import near_duplicates
from quern.llm.sketches import edited_fingerprints
from quern.llm.substrings import repeats
from quern.llm.toxicity import toxicity


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def op8_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: op9: ``known`` is the digest's presence below the middle of the range of doc_ids.
EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
w AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS place,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    min(doc_id) OVER (PARTITION BY text_sha256) AS lowest FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256,
  coalesce(lowest::DOUBLE < (SELECT (min(doc_id)::DOUBLE + max(doc_id)::DOUBLE) / 2 FROM documents), false) AS known FROM w
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secrets, op2_simhash, op3_mixing, op4_packing, op5_substrings, op6_toxicity, op7_sharding, op8_sketches, op9_exact, op10_licences,
        pipeline
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": MIX_SQL, "op9_exact": EXACT_SQL}
