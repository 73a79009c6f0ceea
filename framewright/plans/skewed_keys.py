"""p2: results per source and per identity where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.keys import letters_and_digits
from framewright.operators.chunking import heavy_keys, key_profile
from framewright.session import load

HEAVY_SHARE = 0.025


def _items(spark: SparkSession, root: str) -> DataFrame:
    bare = F.lower(F.trim("source_id"))
    return load(spark, root, "corpus_items").select(
        F.when(~bare.isin("", "unknown"), F.col("source_id")).alias("key_value"), "ingested_at"
    )


def _motions(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "latent_motion_training_rows").select(
        letters_and_digits(F.col("identity_id")).alias("key_value"), "ingested_at", F.lower(F.trim("verb")).alias("verb")
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Keys with at least 2.5 % of all rows of their table, repeats included."""
    items = heavy_keys(spark, _items(spark, root), "key_value", "ingested_at", HEAVY_SHARE)
    motions = heavy_keys(spark, _motions(spark, root), "key_value", "ingested_at", HEAVY_SHARE)
    return (
        items.select(F.lit("corpus_items").alias("table_name"), F.col("key").alias("key_value"))
        .unionByName(
            motions.select(F.lit("latent_motion_training_rows").alias("table_name"), F.col("key").alias("key_value"))
        )
    )


def _profiles(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    names = ["table_name", F.col("key").alias("key_value"), *columns]
    items = key_profile(spark, _items(spark, root), "key_value", "ingested_at").withColumn("table_name", F.lit("corpus_items"))
    motions = key_profile(spark, _motions(spark, root), "key_value", "ingested_at", "verb").withColumn(
        "table_name", F.lit("latent_motion_training_rows")
    )
    return items.select(*names).unionByName(motions.select(*names))


def p2_key_results(spark: SparkSession, root: str) -> DataFrame:
    """Rows, first and last arrival and distinct actions per source and per identity."""
    return _profiles(spark, root, "n_rows", "first_arrival", "last_arrival", "distinct_labels")


def p2_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks, rows of the largest chunk, and rows stored after a later arrival, per source and per identity."""
    return _profiles(spark, root, "n_rows", "n_chunks", "largest_chunk", "late_rows")


QUERIES = {"p2_found": p2_found, "p2_key_results": p2_key_results, "p2_chunks": p2_chunks}

_IDENTITY = r"""regexp_replace(lower(translate(identity_id,
    (SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)),
    (SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)))),
    '[^\p{L}\p{N}]+', '', 'g')"""

ORACLES = {
    "p2_key_results": rf"""
        SELECT 'corpus_items' AS table_name, source_id AS key_value, count(*) AS n_rows, min(ingested_at) AS first_arrival,
            max(ingested_at) AS last_arrival, CAST(NULL AS BIGINT) AS distinct_labels
        FROM corpus_items WHERE lower(trim(source_id)) NOT IN ('', 'unknown') GROUP BY source_id
        UNION ALL
        SELECT 'latent_motion_training_rows', k, count(*), min(ingested_at), max(ingested_at), count(DISTINCT lower(trim(verb, ' ')))
        FROM (SELECT {_IDENTITY} AS k, * FROM latent_motion_training_rows)
        WHERE k NOT IN ('', 'unknown') GROUP BY k
    """,
    "p2_found": r"""
        SELECT 'corpus_items' AS table_name, source_id AS key_value FROM corpus_items
        WHERE lower(trim(source_id)) NOT IN ('', 'unknown')
        GROUP BY source_id HAVING count(*) >= 0.025 * (SELECT count(*) FROM corpus_items)
        UNION ALL
        SELECT 'latent_motion_training_rows', k FROM (
            SELECT regexp_replace(lower(translate(identity_id,
                (SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)),
                (SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)))),
                '[^\p{L}\p{N}]+', '', 'g') AS k FROM latent_motion_training_rows)
        WHERE k NOT IN ('', 'unknown')
        GROUP BY k HAVING count(*) >= 0.025 * (SELECT count(*) FROM latent_motion_training_rows)
    """,
}
