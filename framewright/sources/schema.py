"""Declared schemas of the provenance index, their keys and their row rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.selection import admitted

# Table, columns, key. Timestamps are ISO-8601 strings, JSON documents stay text.
TABLES: dict[str, tuple[str, list[str]]] = {
    "schema_migrations": ("version int, applied_at string", ["version"]),
    "sources": ("id string, kind string, source_name string, root_url string, adapter_version string, config_json string, created_at string", ["id"]),
    "crawl_runs": ("id string, source_id string, status string, parameters_json string, started_at string, finished_at string, free_bytes_start bigint, free_bytes_end bigint, error string", ["id"]),
    "items": ("id string, source_id string, external_id string, canonical_url string, title string, description string, creator_name string, creator_url string, published_at string, metadata_json string, first_seen_at string, last_seen_at string, tombstoned_at string", ["source_id", "external_id"]),
    "blobs": ("sha256 string, size_bytes bigint, mime_type string, storage_path string, created_at string", ["sha256"]),
    "retrievals": ("id string, crawl_run_id string, item_id string, requested_url string, status_code int, etag string, blob_sha256 string, error string", ["id"]),
    "item_blobs": ("id string, item_id string, blob_sha256 string, role string, archive_member string", ["id"]),
    "rights_observations": ("id string, item_id string, license_raw string, license_expression string, terms_blob_sha256 string, robots_blob_sha256 string, observed_at string", ["id"]),
    "derivations": ("id string, child_sha256 string, parent_sha256 string, operation string, parameters_json string", ["id"]),
    "sequences": ("id string, item_id string, source_blob_sha256 string, extraction_method string, width int, height int, frame_count int, loop_mode string, action string, direction string, quality_tier string, metadata_json string, extraction_confidence double", ["id"]),
    "frames": ("sequence_id string, ordinal int, blob_sha256 string, duration_ms int, bbox_json string, metadata_json string", ["sequence_id", "ordinal"]),
    "captions": ("id string, sequence_id string, text string, structured_json string, method string, prompt_hash string, confidence double", ["id"]),
    "dataset_snapshots": ("id string, name string, manifest_sha256 string, created_at string", ["id"]),
    "dataset_members": ("snapshot_id string, sequence_id string, split string, sample_weight double, decision string, reason string", ["snapshot_id", "sequence_id"]),
    "events": ("id bigint, event_type string, entity_type string, entity_id string, payload_json string, created_at string", ["id"]),
    "entities": ("id string, source_id string, external_identity_key string, display_name string, entity_class string, entity_subclass string, species_or_type string, taxonomy_version string", ["source_id", "external_identity_key"]),
    "sequence_subjects": ("sequence_id string, entity_id string, role string, metadata_json string", ["sequence_id", "entity_id", "role"]),
    "motion_annotations": ("sequence_id string, vocabulary_version string, source_action string, normalized_action string, action_family string, view string, direction string, loopable int, cycle_frames int, phase_zero_frame int, confidence double, annotation_method string, conditioning_json string", ["sequence_id"]),
    "archive_inventories": ("archive_blob_sha256 string, member_count int, file_count int, total_bytes bigint, compressed_bytes bigint, inventory_sha256 string", ["archive_blob_sha256"]),
    "archive_members": ("archive_blob_sha256 string, ordinal int, normalized_path string, size_bytes bigint, compressed_bytes bigint, crc32 bigint, compression_method int, inspection_status string, extracted_blob_sha256 string", ["archive_blob_sha256", "ordinal"]),
    "media_observations": ("blob_sha256 string, inspector_version string, inspected_at string, format string, width int, height int, has_alpha int, is_animated int, frame_count int, total_duration_ms double, palette_sha256 string, pixel_sha256 string", ["blob_sha256", "inspector_version"]),
    "duplicate_edges": ("id string, left_blob_sha256 string, right_blob_sha256 string, method string, distance double, parameters_json string", ["left_blob_sha256", "right_blob_sha256", "method"]),
    "sequence_occurrences": ("sequence_id string, archive_blob_sha256 string, archive_member_ordinal int, occurrence_role string", ["sequence_id", "archive_blob_sha256", "archive_member_ordinal", "occurrence_role"]),
    "sequence_frames": ("sequence_id string, ordinal int, source_blob_sha256 string, source_frame_index int, duration_ms double, phase double, direction string, view string, metadata_json string", ["sequence_id", "ordinal"]),
    "sequence_source_keys": ("source_id string, external_sequence_key string, sequence_id string", ["source_id", "external_sequence_key"]),
}

_HEX = "^[0-9a-f]{64}$"


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table][0])


def exists(spark: SparkSession, root: str, table: str) -> bool:
    """Whether an optional table is there: a missing one is read as empty, not as an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table by its declared schema; an absent one is empty."""
    if not exists(spark, root, table):
        return empty(spark, table)
    return spark.read.schema(TABLES[table][0]).parquet(f"{root}/{table}.parquet")


def checked(df: DataFrame, table: str) -> DataFrame:
    """Rows with their rule breaks: null keys, malformed digests, negative sizes, durations and indices, phases outside [0, 1], flags that aren't 0 or 1."""
    _, keys = TABLES[table]
    tests = [(F.col(k).isNull(), f"null_{k}") for k in keys]
    for name, kind in df.dtypes:
        c = F.col(name)
        if name.endswith("sha256"):
            tests.append((c.isNotNull() & ~c.rlike(_HEX), f"bad_{name}"))
        elif kind in ("int", "bigint", "double") and name.endswith(("_bytes", "_count", "duration_ms", "ordinal", "_index", "_frames")):
            tests.append((c < 0, f"negative_{name}"))
        elif name in ("phase", "confidence", "extraction_confidence"):
            tests.append(((c < 0) | (c > 1) | F.isnan(c), f"range_{name}"))
        elif name in ("loopable", "has_alpha", "is_animated"):
            tests.append((~c.isin(0, 1), f"flag_{name}"))
    return admitted(df, tests)


def related(child: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Child rows of a key set."""
    return child.join(keys.select(key).distinct(), key, "left_semi")
