"""Audited records fanned out to index tables, guarded keyed writes, and the inventory of an index."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.selection import admitted
from framewright.operators.skew import union_all


def planned(audit: DataFrame, key: str, tests: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(records, exclusions) of audited tracks: every track is one or the other, an exclusion names its reasons.

    A key that stands for more than one track is excluded as ``repeated_key``,
    a null key as ``missing_key``.
    """
    counts = audit.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    marked = audit.join(counts, key, "left")
    found = admitted(marked, [(F.col(key).isNull(), "missing_key"), (F.col("_n") > 1, "repeated_key"), *tests]).drop("_n")
    return found.where("admitted").drop("admitted", "exclusion_reasons"), found.where("not admitted").drop("admitted")


def pinned(df: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``df``, refused unless each named condition holds for exactly the pinned number of rows."""
    seen = df.agg(*[F.count_if(F.expr(test)).alias(f"c{i}") for i, test in enumerate(counts)]).first()
    wrong = {test: seen[i] for i, test in enumerate(counts) if seen[i] != counts[test]}
    if wrong:
        raise ValueError(f"the plan differs from its pins: {wrong}")
    return df


def projected(tables: Mapping[str, tuple[DataFrame, DataFrame, list[str], list[str]]]) -> DataFrame:
    """(table_name, state, n_rows) of writing rows to index tables: created, reused or conflict.

    Each table is (current rows, new rows, keys, facts). A new row whose key
    the table has is reused where all facts are equal, else it is a conflict;
    repeated new rows of a key count once if equal, else as a conflict.
    """
    found = []
    for name, (current, rows, keys, facts) in tables.items():
        told = F.struct(*[F.col(c) for c in facts]) if facts else F.lit(True)
        fresh = rows.groupBy(*keys).agg(F.count_distinct(F.to_json(F.struct(told.alias("v")), {"ignoreNullFields": "false"})).alias("_n"), F.first(told).alias("_new"))
        held = current.groupBy(*keys).agg(F.first(told).alias("_old"), F.lit(True).alias("_here"))
        joined = fresh.join(held, [fresh[k].eqNullSafe(held[k]) for k in keys], "left")
        state = F.when(F.col("_n") > 1, "conflict").when(F.col("_here").isNull(), "created").when(F.col("_new").eqNullSafe(F.col("_old")), "reused").otherwise("conflict")
        found.append(joined.groupBy(state.alias("state")).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "state", "n_rows"))
    return union_all(found)


def appended(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with those of ``rows`` whose key it lacks, one per key: a second run adds nothing."""
    one = rows.dropDuplicates(keys)
    held = current.select(*keys).distinct()
    return current.unionByName(one.join(held, [one[k].eqNullSafe(held[k]) for k in keys], "left_anti").select(*current.columns))


def required_members(required: DataFrame, members: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """Per required member of an archive: ready, missing, or mismatched with the facts that differ."""
    r, m = required.alias("r"), members.withColumn("_here", F.lit(True)).alias("m")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"r.{f}").eqNullSafe(F.col(f"m.{f}")), F.lit(f)) for f in facts]))
    return r.join(m, [F.col(f"r.{k}") == F.col(f"m.{k}") for k in keys], "left").select(
        *[F.col(f"r.{k}").alias(k) for k in keys],
        F.when(F.col("m._here").isNull(), "missing").when(F.size(differ) > 0, "mismatched").otherwise("ready").alias("state"),
        F.when(F.col("m._here").isNotNull(), F.array_join(differ, "|")).otherwise("").alias("differing"),
    )


def extraction_faults(extracted: DataFrame, members: DataFrame, archive: str, ordinal: str) -> DataFrame:
    """(archive, ordinal, fault): what forbids registering extractions, a repeated ordinal or one the archive lacks."""
    per = extracted.groupBy(archive, ordinal).agg(F.count("*").alias("_n"))
    repeated = per.where("_n > 1").select(archive, ordinal, F.lit("repeated_ordinal").alias("fault"))
    return repeated.unionByName(per.join(members.select(archive, ordinal).distinct(), [archive, ordinal], "left_anti").select(archive, ordinal, F.lit("missing_member").alias("fault")))


def registered_extractions(extracted: DataFrame, members: DataFrame, blobs: DataFrame, archive: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(members, blobs) after extractions are registered; archives with a fault keep all their members as they are.

    A blob already known keeps its type and takes the new one only where it has none.
    """
    faulty = extraction_faults(extracted, members, archive, ordinal).select(archive).distinct()
    good = extracted.join(faulty, archive, "left_anti")
    told = good.groupBy(archive, ordinal).agg(F.first("sha256").alias("_sha"))
    after = members.join(told, [archive, ordinal], "left").select(
        *[F.when(F.col("_sha").isNotNull(), F.col("_sha")).otherwise(F.col(c)).alias(c) if c == "extracted_blob_sha256"
          else F.when(F.col("_sha").isNotNull(), F.lit("extracted")).otherwise(F.col(c)).alias(c) if c == "inspection_status" else F.col(c)
          for c in members.columns])
    fresh = good.groupBy("sha256").agg(F.first("size_bytes", ignorenulls=True).alias("_size"), F.first("mime_type", ignorenulls=True).alias("_mime"))
    merged = blobs.join(fresh, "sha256", "full_outer").select(
        "sha256", F.coalesce("size_bytes", "_size").alias("size_bytes"), F.coalesce("mime_type", "_mime").alias("mime_type"))
    return after, merged


def keyed_update(current: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): ``columns`` set where a key matches exactly one row and is asked for once; other updates are faults and change nothing."""
    asked = updates.groupBy(*keys).agg(F.count("*").alias("_asked"), *[F.first(c).alias(f"_{c}") for c in columns])
    held = current.groupBy(*keys).agg(F.count("*").alias("_held"))
    state = asked.join(held, keys, "left").withColumn("n_matches", F.coalesce("_held", F.lit(0).cast("bigint")))
    fits = (F.col("_asked") == 1) & (F.col("n_matches") == 1)
    good = state.where(fits).select(*keys, *[f"_{c}" for c in columns], F.lit(True).alias("_set"))
    after = current.join(good, keys, "left").select(
        *[F.when(F.col("_set"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])
    return after, state.where(~fits).select(*keys, F.col("_asked").alias("n_updates"), "n_matches")


def logged(event_type: str, entity_type: str, rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Event rows (event_type, entity_type, entity_id, payload_json) of what happened to some rows, to be appended to a log."""
    return rows.select(
        F.lit(event_type).alias("event_type"), F.lit(entity_type).alias("entity_type"), F.col(key).cast("string").alias("entity_id"),
        F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload_json"))


#: Record types of an inventory in their order.
INVENTORY = ("item", "archive_inventory", "archive_member", "media_observation", "blob_occurrence", "retrieval", "rights_observation")


def inventory(t: Mapping[str, DataFrame]) -> DataFrame:
    """(type_rank, record_type, sort_1, sort_2, sort_3, body): all records of an index in one shape, ordered by rank and sort keys.

    ``body`` is the JSON of the record with the facts of the rows it refers to.
    Items need their source, media their blob, occurrences all of theirs;
    members, retrievals and rights keep what they lack as null. Sorting is left
    to the sink, which orders by the key columns.
    """
    source = t["sources"].select(F.col("id").alias("source_id"), F.col("kind").alias("source_kind"), F.col("source_name"), F.col("root_url").alias("source_root_url"))
    items = t["items"].select("id", "source_id", "external_id", "canonical_url", "title", "creator_name")
    blob = t["blobs"].select("sha256", "size_bytes", "mime_type", "storage_path")
    short = items.select(F.col("id").alias("item_id"), "source_id", "external_id")
    named = lambda prefix: blob.select(F.col("sha256").alias(f"{prefix}_blob_sha256"), F.col("storage_path").alias(f"{prefix}_storage_path"))

    def shaped(kind: str, df: DataFrame, keys: list[str]) -> DataFrame:
        sort = [*[F.col(k).cast("string") for k in keys], *[F.lit("")] * (3 - len(keys))]
        return df.select(
            F.lit(INVENTORY.index(kind)).alias("type_rank"), F.lit(kind).alias("record_type"), *[s.alias(f"sort_{i + 1}") for i, s in enumerate(sort)],
            F.to_json(F.struct(*df.columns)).alias("body"))

    members = t["archive_members"].join(blob.select(F.col("sha256").alias("extracted_blob_sha256"), "storage_path", "mime_type"), "extracted_blob_sha256", "left")
    return union_all([
        shaped("item", items.join(source, "source_id"), ["source_id", "external_id", "id"]),
        shaped("archive_inventory", t["archive_inventories"], ["archive_blob_sha256"]),
        shaped("archive_member", members.withColumn("_o", F.lpad(F.col("ordinal").cast("string"), 12, "0")), ["archive_blob_sha256", "_o"]),
        shaped("media_observation", t["media_observations"].join(blob.select(F.col("sha256").alias("blob_sha256"), "storage_path", "size_bytes", "mime_type"), "blob_sha256"), ["blob_sha256", "inspector_version"]),
        shaped("blob_occurrence", t["item_blobs"].join(short, "item_id").join(source, "source_id").join(blob.select(F.col("sha256").alias("blob_sha256"), "size_bytes", "storage_path"), "blob_sha256"), ["source_id", "item_id", "id"]),
        shaped("retrieval", t["retrievals"].join(short, "item_id", "left").join(source, "source_id", "left"), ["requested_url", "id"]),
        shaped("rights_observation", t["rights_observations"].join(short, "item_id").join(source, "source_id")
               .join(named("terms"), "terms_blob_sha256", "left").join(named("robots"), "robots_blob_sha256", "left"), ["source_id", "item_id", "id"]),
    ])


def source_totals(t: Mapping[str, DataFrame]) -> DataFrame:
    """Every source with the eleven totals of its items, retrievals, rights, blobs, entities and sequences; 0 where it has none.

    Each child is reduced to one row per source before it is joined. Linked
    blobs count, and their bytes add up, once per source.
    """
    of_item = t["items"].where("source_id is not null").select(F.col("id").alias("item_id"), "source_id")
    keys = t["sequence_source_keys"].where("source_id is not null").select("source_id", "sequence_id")
    linked = t["item_blobs"].join(of_item, "item_id")
    once = linked.select("source_id", "blob_sha256").distinct().join(t["blobs"].select(F.col("sha256").alias("blob_sha256"), "size_bytes"), "blob_sha256", "left")
    n, per_key = F.count("*"), lambda name: keys.join(t[name].select("sequence_id"), "sequence_id")
    parts = {
        "item_count": (of_item, n), "retrieval_count": (t["retrievals"].join(of_item, "item_id"), n),
        "rights_observation_count": (t["rights_observations"].join(of_item, "item_id"), n), "item_blob_occurrence_count": (linked, n),
        "distinct_linked_blob_count": (once, n), "distinct_linked_blob_bytes": (once, F.sum("size_bytes")), "entity_count": (t["entities"], n),
        "sequence_count": (keys, n), "sequence_frame_count": (per_key("sequence_frames"), n),
        "sequence_occurrence_count": (per_key("sequence_occurrences"), n), "sequence_subject_count": (per_key("sequence_subjects"), n),
    }
    out = t["sources"].select(F.col("id").alias("source_id"), "kind", "source_name")
    for name, (df, agg) in parts.items():
        out = out.join(df.groupBy("source_id").agg(agg.alias(name)), "source_id", "left")
    return out.select("source_id", "kind", "source_name", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in parts])


#: Tables that a summary counts, in order.
SUMMARY = (
    "sources", "crawl_runs", "items", "blobs", "retrievals", "item_blobs", "rights_observations", "derivations", "entities", "sequences",
    "sequence_frames", "sequence_occurrences", "sequence_subjects", "sequence_source_keys", "frames", "captions", "dataset_snapshots",
    "dataset_members", "motion_annotations", "archive_inventories", "archive_members", "media_observations", "duplicate_edges",
)


def index_summary(t: Mapping[str, DataFrame]) -> DataFrame:
    """(measure, value): rows of each table, bytes of all blobs, and rights observations by label."""
    counts = [t[name].agg(F.count("*").alias("value")).select(F.lit(f"rows:{name}").alias("measure"), "value") for name in SUMMARY]
    size = t["blobs"].agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("value")).select(F.lit("blob_bytes").alias("measure"), "value")
    label = F.coalesce(F.when(F.trim("license_expression") != "", F.trim("license_expression")), F.when(F.trim("license_raw") != "", F.trim("license_raw")))
    labels = t["rights_observations"].groupBy(F.concat(F.lit("license:"), F.coalesce(label, F.lit("(unknown)"))).alias("measure")).agg(F.count("*").alias("value"))
    return union_all([*counts, size, labels])
