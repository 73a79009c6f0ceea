"""Queries of the whole index, its projection and its guarded writes, over the test tables seen as an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.keys import letters_and_digits
from framewright.operators import projection as P
from framewright.operators.skew import union_all
from framewright.plans.snapshot import driver_index
from framewright.session import load
from framewright.sources import schema


def provenance_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """``driver_index`` with sources, blobs, occurrences, retrievals and rights: a document is a retrieved text of its item."""
    t = driver_index(spark, root)

    def shaped(df: DataFrame, name: str) -> DataFrame:
        held = dict(df.dtypes)
        return df.select(*[(F.col(c) if c in held else F.lit(None)).cast(k).alias(c) for c, k in t[name].dtypes])

    docs = load(spark, root, "documents").withColumn("sha256", F.sha2("text", 256))
    name = F.col("doc_id").cast("string")
    t["sources"] = shaped(load(spark, root, "sources"), "sources")
    t["blobs"] = shaped(docs.where("text is not null").groupBy("sha256").agg(
        F.first(F.octet_length("text")).alias("size_bytes"), F.lit("text/plain").alias("mime_type"), F.first(F.concat(F.lit("cas/"), "sha256")).alias("storage_path")), "blobs")
    linked = docs.where("item_id is not null")
    t["item_blobs"] = shaped(linked.where("text is not null").select(name.alias("id"), "item_id", F.col("sha256").alias("blob_sha256"), F.lit("text").alias("role")), "item_blobs")
    t["retrievals"] = shaped(docs.select(name.alias("id"), "item_id", F.concat(F.lit("https://texts.invalid/"), name).alias("requested_url"), F.lit(200).alias("status_code"), F.col("sha256").alias("blob_sha256")), "retrievals")
    mark = F.regexp_extract("text", r"CC-X-[0-9]", 0)
    t["rights_observations"] = shaped(linked.select(name.alias("id"), "item_id", F.when(mark != "", mark).alias("license_raw"), F.col("sha256").alias("terms_blob_sha256")), "rights_observations")
    rows = load(spark, root, "raw_properties").groupBy("script_path", "line_number").agg(F.min("property_id").alias("n"))
    t["archive_members"] = shaped(rows.select(F.sha2("script_path", 256).alias("archive_blob_sha256"), F.col("line_number").alias("ordinal"),
                                              F.concat_ws("#", "script_path", "line_number").alias("normalized_path"), F.lit("listed").alias("inspection_status")), "archive_members")
    t["archive_inventories"] = shaped(rows.groupBy("script_path").agg(F.count("*").alias("member_count")).select(
        F.sha2("script_path", 256).alias("archive_blob_sha256"), "member_count", F.col("member_count").alias("file_count")), "archive_inventories")
    t["media_observations"] = shaped(t["blobs"].select(F.col("sha256").alias("blob_sha256"), F.lit("1").alias("inspector_version"), F.lit("text").alias("format")), "media_observations")
    return t


def source_totals(spark: SparkSession, root: str) -> DataFrame:
    return P.source_totals(provenance_index(spark, root))


def index_summary(spark: SparkSession, root: str) -> DataFrame:
    return P.index_summary(provenance_index(spark, root))


def inventory_records(spark: SparkSession, root: str) -> DataFrame:
    """The whole inventory in one shape, without its JSON bodies but with a fact of each."""
    fact = F.coalesce(F.get_json_object("body", "$.source_kind"), F.get_json_object("body", "$.storage_path"), F.get_json_object("body", "$.terms_storage_path"), F.lit(""))
    return P.inventory(provenance_index(spark, root)).select("type_rank", "record_type", "sort_1", "sort_2", "sort_3", fact.alias("fact"))


def occurrence_members(spark: SparkSession, root: str) -> DataFrame:
    """Occurrences of properties in scripts that meet their archive member, on archive and ordinal."""
    t = provenance_index(spark, root)
    seen = load(spark, root, "raw_properties").select("property_id", F.sha2("script_path", 256).alias("archive_blob_sha256"), F.col("line_number").alias("ordinal"))
    return seen.join(t["archive_members"], ["archive_blob_sha256", "ordinal"]).select("property_id", "normalized_path").distinct()


def _tracks(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "latent_motion_training_rows").groupBy("sequence_id").agg(
        F.min(letters_and_digits(F.col("identity_id"))).alias("identity"), F.min("source_id").alias("source_id"), F.min("verb").alias("verb"), F.min("loop_mode").alias("loop_mode"),
        F.max(F.aggregate("duration_ms", F.lit(True), lambda ok, d: ok & F.coalesce(d > 0, F.lit(False)))).alias("timed"))


def _planned(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    tests = [(F.col("identity").isNull(), "identity_absent"), (F.col("verb").isNull(), "verb_absent"), (~F.coalesce("timed", F.lit(False)), "timing_incomplete"),
             (~F.col("loop_mode").isin("loop", "one_shot", "ping_pong") | F.col("loop_mode").isNull(), "loop_mode_unknown")]
    return P.planned(_tracks(spark, root), "sequence_id", tests)


def projection_plan(spark: SparkSession, root: str) -> DataFrame:
    """Tracks as records or exclusions with their reasons; together they are all tracks."""
    records, exclusions = _planned(spark, root)
    return records.select("sequence_id", F.lit("").alias("reasons")).unionByName(exclusions.select("sequence_id", F.array_join("exclusion_reasons", "|").alias("reasons")))


def _fan_out(spark: SparkSession, root: str) -> dict[str, tuple[DataFrame, DataFrame, list[str], list[str]]]:
    """Rows that the planned records write: sequences, entities, subjects and source keys, beside what the index of frames holds."""
    records, _ = _planned(spark, root)
    t = driver_index(spark, root)
    entities = records.groupBy(F.col("identity").alias("id")).agg(F.lit("creature").alias("entity_class"))
    return {
        "sequences": (t["sequences"], records.select(F.col("sequence_id").alias("id"), "loop_mode"), ["id"], ["loop_mode"]),
        "entities": (t["entities"], entities, ["id"], ["entity_class"]),
        "sequence_subjects": (t["sequence_subjects"], records.select("sequence_id", F.col("identity").alias("entity_id"), F.lit("primary").alias("role")), ["sequence_id", "entity_id", "role"], []),
        "sequence_source_keys": (t["sequence_source_keys"], records.where("source_id is not null").select("source_id", F.col("sequence_id").alias("external_sequence_key"), "sequence_id"), ["source_id", "external_sequence_key"], ["sequence_id"]),
    }


def projection_first(spark: SparkSession, root: str) -> DataFrame:
    """What projecting the planned records creates, reuses or conflicts with."""
    return P.projected(_fan_out(spark, root))


def projection_again(spark: SparkSession, root: str) -> DataFrame:
    """The same projection a second time, over its own result: it reuses all and creates nothing."""
    again = {}
    for name, (current, rows, keys, facts) in _fan_out(spark, root).items():
        columns = [*keys, *[f for f in facts if f not in keys]]
        again[name] = (P.appended(current.select(*columns), rows.select(*columns), keys), rows, keys, facts)
    return P.projected(again)


def projection_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """The projection over an index in which every loop is known as a one-shot: those records conflict."""
    tables = _fan_out(spark, root)
    current, rows, keys, facts = tables["sequences"]
    other = rows.select("id", F.when(F.col("loop_mode") == "loop", "one_shot").otherwise(F.col("loop_mode")).alias("loop_mode"))
    return P.projected({"sequences": (other, rows, keys, facts)})


def preparation_readiness(spark: SparkSession, root: str) -> DataFrame:
    """Members that the action properties require against those the inventory lists, with their path."""
    t = provenance_index(spark, root)
    rows = load(spark, root, "raw_properties").where("property_name = 'action'")
    need = rows.select(F.sha2("script_path", 256).alias("archive_blob_sha256"), (F.col("line_number") + F.when(F.col("property_id") % 3 == 0, 100_000).otherwise(0)).alias("ordinal"),
                       F.concat(F.col("script_path"), F.lit("#"), F.col("line_number"), F.when(F.col("property_id") % 5 == 0, "x").otherwise("")).alias("normalized_path")).distinct()
    return P.required_members(need, t["archive_members"], ["archive_blob_sha256", "ordinal"], ["normalized_path"]).groupBy("state", "differing").agg(F.count("*").alias("n_members"))


def _extractions(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "raw_properties").where("property_name in ('volume', 'tint', 'depth_layer')")
    return rows.select(F.sha2("script_path", 256).alias("archive_blob_sha256"), (F.col("line_number") + F.when(F.col("property_id") % 97 == 0, 100_000).otherwise(0)).alias("ordinal"),
                       F.sha2(F.col("property_id").cast("string"), 256).alias("sha256"), F.col("property_id").alias("size_bytes"), F.lit("text/x-script").alias("mime_type"))


def extraction_faults(spark: SparkSession, root: str) -> DataFrame:
    return P.extraction_faults(_extractions(spark, root), provenance_index(spark, root)["archive_members"], "archive_blob_sha256", "ordinal")


def registered_extractions(spark: SparkSession, root: str) -> DataFrame:
    """Members by inspection status after all extractions of faultless archives are registered, and blobs by type."""
    t = provenance_index(spark, root)
    members, blobs = P.registered_extractions(_extractions(spark, root), t["archive_members"], t["blobs"].select("sha256", "size_bytes", "mime_type"), "archive_blob_sha256", "ordinal")
    return union_all([
        members.groupBy(F.concat(F.lit("member:"), "inspection_status").alias("measure")).agg(F.count("*").alias("n"), F.count("extracted_blob_sha256").alias("n_extracted")),
        blobs.groupBy(F.concat(F.lit("blob:"), "mime_type").alias("measure")).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("n_extracted")),
    ])


def guarded_updates(spark: SparkSession, root: str) -> DataFrame:
    """Status updates of orders: set where exactly one order matches, else a fault."""
    orders = load(spark, root, "orders").select("o_orderkey", "o_orderstatus")
    asked = load(spark, root, "lineitem").where("l_returnflag = 'A' or l_linenumber = 1").select((F.col("l_orderkey") + F.when(F.col("l_quantity") > 49, 10_000_000).otherwise(0)).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"))
    after, faults = P.keyed_update(orders, asked, ["o_orderkey"], ["o_orderstatus"])
    return after.groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.concat(F.lit("status:"), "o_orderstatus").alias("measure"), "n").unionByName(
        faults.groupBy(F.concat(F.lit("matches:"), F.col("n_matches").cast("string")).alias("measure")).agg(F.count("*").alias("n")))


def event_log(spark: SparkSession, root: str) -> DataFrame:
    """Events of registered sources appended to those of the retrievals without item."""
    t = provenance_index(spark, root)
    first = P.logged("source_registered", "source", t["sources"], "id", ["kind"])
    return first.unionByName(P.logged("retrieval_unbound", "retrieval", t["retrievals"].where("item_id is null"), "id", ["status_code", "item_id"]))


def synced_registry(spark: SparkSession, root: str) -> DataFrame:
    """A registry written into the sources: new ones are created, known ones keep their first date."""
    from framewright.operators.merge import upsert

    held = load(spark, root, "sources").select("id", "kind", "source_name", "adapter_version", "created_at")
    registry = held.where("kind <> 'forum'").select(F.when(F.length("source_name") % 4 == 0, F.concat("id", F.lit("_new"))).otherwise(F.col("id")).alias("id"), "kind",
                                                   F.upper("source_name").alias("source_name"), F.lit("registry-v1").alias("adapter_version"), F.lit("2030-01-01").alias("created_at"))
    return upsert(held, registry, ["id"], {"created_at": "keep"})


QUERIES = {f.__name__: f for f in (
    source_totals, index_summary, inventory_records, occurrence_members, projection_plan, projection_first, projection_again, projection_conflicts,
    preparation_readiness, extraction_faults, registered_extractions, guarded_updates, event_log, synced_registry,
)}

_ABSENT = "('', 'unknown')"
_PLAIN = r"""regexp_replace(lower(translate(identity_id,
    (SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)),
    (SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)))), '[^\p{L}\p{N}]+', '', 'g')"""
_HEX = "regexp_replace(regexp_replace(lower({c}), 'sha-?256', ''), '[^0-9a-z]+', '', 'g')"
_TRACKS = rf"""
    x AS (SELECT *, {_PLAIN} AS i, list_bool_and(list_transform(duration_ms, lambda d: coalesce(d > 0, false))) AS ok FROM latent_motion_training_rows),
    k AS (SELECT sequence_id, min(CASE WHEN i NOT IN {_ABSENT} THEN i END) AS identity, min(source_id) AS source_id, min(verb) AS verb, min(loop_mode) AS loop_mode,
        bool_or(CASE WHEN duration_ms IS NOT NULL THEN len(duration_ms) = 0 OR ok END) AS timed FROM x GROUP BY 1),
    plan AS (SELECT *, concat_ws('|', CASE WHEN sequence_id IS NULL THEN 'missing_key' END, CASE WHEN identity IS NULL THEN 'identity_absent' END, CASE WHEN verb IS NULL THEN 'verb_absent' END,
        CASE WHEN NOT coalesce(timed, false) THEN 'timing_incomplete' END, CASE WHEN loop_mode IS NULL OR loop_mode NOT IN ('loop', 'one_shot', 'ping_pong') THEN 'loop_mode_unknown' END) AS reasons FROM k),
    rec AS (SELECT * FROM plan WHERE reasons = ''),
    f AS (SELECT DISTINCT ON (sequence_id) *, {_PLAIN} AS i FROM prepared_broad_rows ORDER BY sequence_id)"""
_MEMBERS = "m AS (SELECT sha256(script_path) AS a, line_number AS o, script_path || '#' || line_number AS p FROM (SELECT DISTINCT script_path, line_number FROM raw_properties WHERE script_path IS NOT NULL))"
_EXTRACT = "x AS (SELECT sha256(script_path) AS a, line_number + CASE WHEN property_id % 97 = 0 THEN 100000 ELSE 0 END AS o, sha256(CAST(property_id AS VARCHAR)) AS s FROM raw_properties WHERE property_name IN ('volume', 'tint', 'depth_layer')), " \
    "per AS (SELECT a, o, count(*) AS n FROM x GROUP BY 1, 2), bad AS (SELECT a, o, 'repeated_ordinal' AS fault FROM per WHERE n > 1 UNION ALL SELECT a, o, 'missing_member' FROM per ANTI JOIN m USING (a, o))"
_DOCS = "d AS (SELECT *, sha256(text) AS h, nullif(regexp_extract(text, 'CC-X-[0-9]'), '') AS mark FROM documents), it AS (SELECT DISTINCT ON (id) * FROM corpus_items ORDER BY id, ingested_at)"
ORACLES = {
    "source_totals": f"""
        WITH {_DOCS}, f AS (SELECT DISTINCT ON (sequence_id) *, {_PLAIN} AS i, {_HEX.format(c='source_file_sha256')} AS file FROM prepared_broad_rows ORDER BY sequence_id),
        l AS (SELECT it.source_id, d.* FROM d JOIN it ON it.id = d.item_id WHERE it.source_id IS NOT NULL),
        b AS (SELECT DISTINCT source_id, h, octet_length(encode(text)) AS n FROM l WHERE text IS NOT NULL),
        e AS (SELECT i, min(source_id) AS source_id FROM f WHERE i NOT IN {_ABSENT} GROUP BY i)
        SELECT s.id AS source_id, s.kind, s.source_name, (SELECT count(*) FROM it WHERE it.source_id = s.id) AS item_count,
            (SELECT count(*) FROM l WHERE l.source_id = s.id) AS retrieval_count, (SELECT count(*) FROM l WHERE l.source_id = s.id) AS rights_observation_count,
            (SELECT count(*) FROM l WHERE l.source_id = s.id AND text IS NOT NULL) AS item_blob_occurrence_count,
            (SELECT count(*) FROM b WHERE b.source_id = s.id) AS distinct_linked_blob_count, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM b WHERE b.source_id = s.id) AS distinct_linked_blob_bytes,
            (SELECT count(*) FROM e WHERE e.source_id = s.id) AS entity_count, (SELECT count(*) FROM f WHERE f.source_id = s.id) AS sequence_count,
            (SELECT CAST(coalesce(sum(len(frame_phases)), 0) AS BIGINT) FROM f WHERE f.source_id = s.id) AS sequence_frame_count,
            (SELECT count(*) FROM f WHERE f.source_id = s.id AND regexp_full_match(file, '[0-9a-f]{{64}}') AND NOT regexp_full_match(file, '0+')) AS sequence_occurrence_count,
            (SELECT count(*) FROM f WHERE f.source_id = s.id AND i NOT IN {_ABSENT}) AS sequence_subject_count
        FROM sources s
    """,
    "inventory_records": f"""
        WITH {_DOCS}, {_MEMBERS}, b AS (SELECT DISTINCT h FROM d WHERE text IS NOT NULL),
        l AS (SELECT d.*, it.source_id AS src, s.kind FROM d JOIN it ON it.id = d.item_id JOIN sources s ON s.id = it.source_id)
        SELECT 0 AS type_rank, 'item' AS record_type, it.source_id AS sort_1, external_id AS sort_2, it.id AS sort_3, s.kind AS fact FROM it JOIN sources s ON s.id = it.source_id
        UNION ALL SELECT 1, 'archive_inventory', a, '', '', '' FROM (SELECT DISTINCT a FROM m)
        UNION ALL SELECT 2, 'archive_member', a, printf('%012d', o), '', '' FROM m
        UNION ALL SELECT 3, 'media_observation', h, '1', '', 'cas/' || h FROM b
        UNION ALL SELECT 4, 'blob_occurrence', src, item_id, CAST(doc_id AS VARCHAR), kind FROM l WHERE text IS NOT NULL
        UNION ALL SELECT 5, 'retrieval', 'https://texts.invalid/' || d.doc_id, CAST(d.doc_id AS VARCHAR), '', coalesce(s.kind, '') FROM d LEFT JOIN it ON it.id = d.item_id LEFT JOIN sources s ON s.id = it.source_id
        UNION ALL SELECT 6, 'rights_observation', src, item_id, CAST(doc_id AS VARCHAR), kind FROM l
    """,
    "occurrence_members": "SELECT DISTINCT property_id, script_path || '#' || line_number AS normalized_path FROM raw_properties WHERE script_path IS NOT NULL AND line_number IS NOT NULL",
    "projection_plan": f"WITH {_TRACKS} SELECT sequence_id, reasons FROM plan",
    "projection_first": f"""
        WITH {_TRACKS}
        SELECT 'sequences' AS table_name, CASE WHEN f.sequence_id IS NULL THEN 'created' WHEN loop_mode = 'loop' THEN 'reused' ELSE 'conflict' END AS state, count(*) AS n_rows FROM rec LEFT JOIN f USING (sequence_id) GROUP BY 1, 2
        UNION ALL SELECT 'entities', CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.i = e.identity) THEN 'reused' ELSE 'created' END, count(*) FROM (SELECT DISTINCT identity FROM rec) e GROUP BY 1, 2
        UNION ALL SELECT 'sequence_subjects', CASE WHEN f.sequence_id IS NULL THEN 'created' ELSE 'reused' END, count(*) FROM rec LEFT JOIN f ON f.sequence_id = rec.sequence_id AND f.i = rec.identity GROUP BY 1, 2
        UNION ALL SELECT 'sequence_source_keys', CASE WHEN f.sequence_id IS NULL THEN 'created' ELSE 'reused' END, count(*) FROM rec LEFT JOIN f ON f.sequence_id = rec.sequence_id AND f.source_id = rec.source_id WHERE rec.source_id IS NOT NULL GROUP BY 1, 2
    """,
    "projection_again": f"""
        WITH {_TRACKS}
        SELECT 'sequences' AS table_name, CASE WHEN f.sequence_id IS NULL OR loop_mode = 'loop' THEN 'reused' ELSE 'conflict' END AS state, count(*) AS n_rows FROM rec LEFT JOIN f USING (sequence_id) GROUP BY 1, 2
        UNION ALL SELECT 'entities', 'reused', count(DISTINCT identity) FROM rec
        UNION ALL SELECT 'sequence_subjects', 'reused', count(*) FROM rec UNION ALL SELECT 'sequence_source_keys', 'reused', count(*) FROM rec WHERE source_id IS NOT NULL
    """,
    "projection_conflicts": f"WITH {_TRACKS} SELECT 'sequences' AS table_name, CASE WHEN loop_mode = 'loop' THEN 'conflict' ELSE 'reused' END AS state, count(*) AS n_rows FROM rec GROUP BY 1, 2",
    "preparation_readiness": f"""
        WITH {_MEMBERS}, r AS (SELECT DISTINCT sha256(script_path) AS a, line_number + CASE WHEN property_id % 3 = 0 THEN 100000 ELSE 0 END AS o,
            script_path || '#' || line_number || CASE WHEN property_id % 5 = 0 THEN 'x' ELSE '' END AS p FROM raw_properties WHERE property_name = 'action')
        SELECT CASE WHEN m.a IS NULL THEN 'missing' WHEN m.p IS DISTINCT FROM r.p THEN 'mismatched' ELSE 'ready' END AS state,
            CASE WHEN m.a IS NOT NULL AND m.p IS DISTINCT FROM r.p THEN 'normalized_path' ELSE '' END AS differing, count(*) AS n_members FROM r LEFT JOIN m USING (a, o) GROUP BY 1, 2
    """,
    "extraction_faults": f"WITH {_MEMBERS}, {_EXTRACT} SELECT a AS archive_blob_sha256, o AS ordinal, fault FROM bad",
    "registered_extractions": f"""
        WITH {_MEMBERS}, {_EXTRACT}, {_DOCS}, good AS (SELECT x.* FROM x ANTI JOIN bad USING (a))
        SELECT 'member:' || CASE WHEN s IS NULL THEN 'listed' ELSE 'extracted' END AS measure, count(*) AS n, count(s) AS n_extracted FROM m LEFT JOIN good USING (a, o) GROUP BY 1
        UNION ALL SELECT 'blob:text/plain', count(DISTINCT h), 0 FROM d WHERE text IS NOT NULL UNION ALL SELECT 'blob:text/x-script', count(DISTINCT s), 0 FROM good HAVING count(*) > 0
    """,
    "guarded_updates": """
        WITH u AS (SELECT l_orderkey + CASE WHEN l_quantity > 49 THEN 10000000 ELSE 0 END AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' OR l_linenumber = 1 GROUP BY 1),
        s AS (SELECT k, n, (SELECT count(*) FROM orders o WHERE o.o_orderkey = u.k) AS m FROM u)
        SELECT 'status:' || CASE WHEN s.k IS NOT NULL THEN 'X' ELSE o_orderstatus END AS measure, count(*) AS n FROM orders LEFT JOIN s ON s.k = o_orderkey AND s.n = 1 AND s.m = 1 GROUP BY 1
        UNION ALL SELECT 'matches:' || m, count(*) FROM s WHERE NOT (n = 1 AND m = 1) GROUP BY 1
    """,
    "event_log": """
        SELECT 'source_registered' AS event_type, 'source' AS entity_type, id AS entity_id, '{"kind":"' || kind || '"}' AS payload_json FROM sources
        UNION ALL SELECT 'retrieval_unbound', 'retrieval', CAST(doc_id AS VARCHAR), '{"status_code":200,"item_id":null}' FROM documents WHERE item_id IS NULL
    """,
    "synced_registry": """
        WITH r AS (SELECT CASE WHEN length(source_name) % 4 = 0 THEN id || '_new' ELSE id END AS id, kind, upper(source_name) AS n FROM sources WHERE kind <> 'forum')
        SELECT coalesce(r.id, s.id) AS id, coalesce(r.kind, s.kind) AS kind, coalesce(r.n, s.source_name) AS source_name, CASE WHEN r.id IS NOT NULL THEN 'registry-v1' ELSE s.adapter_version END AS adapter_version,
            coalesce(s.created_at, '2030-01-01') AS created_at, CASE WHEN r.id IS NULL THEN 'kept' WHEN s.id IS NULL THEN 'created' ELSE 'updated' END AS merge_state FROM sources s FULL JOIN r ON r.id = s.id
    """,
}
_FILLED = {
    "sources": "(SELECT count(*) FROM sources)", "items": "(SELECT count(*) FROM it)", "blobs": "(SELECT count(DISTINCT h) FROM d WHERE text IS NOT NULL)", "retrievals": "(SELECT count(*) FROM d)",
    "item_blobs": "(SELECT count(*) FROM d WHERE item_id IS NOT NULL AND text IS NOT NULL)", "rights_observations": "(SELECT count(*) FROM d WHERE item_id IS NOT NULL)",
    "entities": f"(SELECT count(DISTINCT i) FROM f WHERE i NOT IN {_ABSENT})", "sequences": "(SELECT count(*) FROM f)", "sequence_frames": "(SELECT CAST(coalesce(sum(len(frame_phases)), 0) AS BIGINT) FROM f)",
    "sequence_occurrences": "(SELECT count(*) FROM f WHERE file IS NOT NULL)", "sequence_subjects": f"(SELECT count(*) FROM f WHERE i NOT IN {_ABSENT})", "sequence_source_keys": "(SELECT count(*) FROM f WHERE source_id IS NOT NULL)",
    "archive_inventories": "(SELECT count(DISTINCT a) FROM m)", "archive_members": "(SELECT count(*) FROM m)", "media_observations": "(SELECT count(DISTINCT h) FROM d WHERE text IS NOT NULL)",
    "duplicate_edges": "(SELECT count(*) FROM (SELECT DISTINCT arr, file FROM f WHERE file IS NOT NULL AND arr IN (SELECT arr FROM (SELECT DISTINCT arr, file FROM f WHERE arr IS NOT NULL AND file IS NOT NULL) GROUP BY arr HAVING count(*) > 1)))",
}
_CLEAN = "CASE WHEN regexp_full_match({h}, '[0-9a-f]{{64}}') AND NOT regexp_full_match({h}, '0+') THEN {h} END"
ORACLES["index_summary"] = f"""
    WITH {_DOCS}, {_MEMBERS}, f0 AS (SELECT DISTINCT ON (sequence_id) *, {_PLAIN} AS i, {_HEX.format(c='source_file_sha256')} AS fh, {_HEX.format(c='normalized_array_sha256')} AS ah FROM prepared_broad_rows ORDER BY sequence_id),
    f AS (SELECT *, {_CLEAN.format(h='fh')} AS file, {_CLEAN.format(h='ah')} AS arr FROM f0)
    """ + " UNION ALL ".join(f"SELECT 'rows:{n}' AS measure, CAST({_FILLED.get(n, '0')} AS BIGINT) AS value" for n in P.SUMMARY) + """
    UNION ALL SELECT 'blob_bytes', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT DISTINCT h, octet_length(encode(text)) AS n FROM d WHERE text IS NOT NULL)
    UNION ALL SELECT 'license:' || coalesce(mark, '(unknown)'), count(*) FROM d WHERE item_id IS NOT NULL GROUP BY 1
"""
