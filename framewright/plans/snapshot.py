"""The dataset snapshot: eligible samples of a provenance index, their leakage components, splits and coverage.

One plan per table: children are reduced to one row per sequence before they
meet the candidates, so no join multiplies rows. Components are found over
star edges of identities and tokens, and splits are drawn per component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.hashing import canonical_text, hash_split, member_hash
from framewright.operators.graph import components, star_edges
from framewright.operators.reports import coverage
from framewright.operators.sampling import balanced_splits
from framewright.operators.selection import Filters, by_sources, effective_action, negative_claims, phases_ready, timing_evidence
from framewright.operators.skew import hottest, lookup_join
from framewright.session import Scratch
from framewright.sources import schema

# Fields by which a document disclaims its timing.
TIMING_FIELDS = ["timing_known", "exact_engine_timing", "state_occurrence_order_preserved"]
#: Blobs in duplicate groups, about 150 bytes each, up to which they are broadcast.
FEW = 1 << 16


@dataclass(frozen=True)
class SplitPolicy:
    """Shares of the splits and how components are placed: "hash" scales, "balanced" collects component sizes."""

    seed: str = "snapshot"
    train: float = 0.8
    validation: float = 0.1
    test: float = 0.1
    strategy: str = "hash"

    def __post_init__(self):
        shares = (self.train, self.validation, self.test)
        if min(shares) < 0 or abs(sum(shares) - 1) > 1e-12:
            raise ValueError("shares must not be negative and must add up to 1")
        if self.strategy not in ("hash", "balanced"):
            raise ValueError(f"unknown strategy {self.strategy!r}")

    @property
    def ratios(self) -> dict[str, float]:
        return {"train": self.train, "validation": self.validation, "test": self.test}


def _filled(*cols: Column) -> Column:
    """The first text that is neither null nor empty, else unknown."""
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit("unknown"))


def _associations(t: Mapping[str, DataFrame]) -> DataFrame:
    """(id, source_id): a sequence's sources by its item, its registered keys and its subjects."""
    by_item = t["sequences"].select("id", "item_id").join(t["items"].select(F.col("id").alias("item_id"), "source_id"), "item_id").select("id", "source_id")
    by_key = t["sequence_source_keys"].select(F.col("sequence_id").alias("id"), "source_id")
    subjects = t["sequence_subjects"].join(t["entities"].select(F.col("id").alias("entity_id"), "source_id"), "entity_id")
    return by_item.unionByName(by_key).unionByName(subjects.select(F.col("sequence_id").alias("id"), "source_id")).where("source_id is not null").distinct()


def duplicate_groups(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(blob, duplicate_group): components of the duplicate edges, named by the hash of their members."""
    found = components(spark, edges, "left_blob_sha256", "right_blob_sha256")
    named = found.groupBy("component").agg(member_hash(F.collect_list("node"), "duplicate-component:").alias("duplicate_group"))
    return found.join(named, "component").select(F.col("node").alias("blob"), "duplicate_group")


def with_edges(samples: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Samples with all edges of their duplicate groups, members times edges of a group: only for those who read them."""
    of_group = edges.join(groups.withColumnRenamed("blob", "left_blob_sha256"), "left_blob_sha256").select("duplicate_group", F.col("id").alias("_edge"))
    held = samples.select("sequence_id", F.explode("duplicate_group_ids").alias("duplicate_group")).join(of_group, "duplicate_group")
    edge_ids = held.groupBy("sequence_id").agg(F.array_sort(F.collect_set("_edge")).alias("duplicate_edge_ids"))
    at = samples.columns.index("duplicate_group_ids") + 1
    return samples.join(edge_ids, "sequence_id", "left").select(
        *samples.columns[:at], F.coalesce("duplicate_edge_ids", F.array().cast("array<string>")).alias("duplicate_edge_ids"), *samples.columns[at:])


def load_samples(t: Mapping[str, DataFrame], filters: Filters, groups: DataFrame) -> DataFrame:
    """One row per eligible sequence with its identity, pack, labels, digests, leakage tokens and temporal evidence."""
    motion = t["motion_annotations"].select(
        F.col("sequence_id").alias("id"), "normalized_action", F.col("view").alias("motion_view"), F.col("direction").alias("motion_direction"), "conditioning_json", "action_family")
    base = t["sequences"].join(motion, "id", "left").withColumn("selected_action", effective_action(F.col("normalized_action"), F.col("action")))
    base = base.where(F.col("frame_count") >= filters.minimum_frames)
    if filters.actions:
        base = base.where(F.col("selected_action").isin(list(filters.actions)))
    sources = _associations(t)
    base = by_sources(base, "id", sources, filters)

    frames = t["sequence_frames"].withColumnRenamed("sequence_id", "id")
    legacy = t["frames"].withColumnRenamed("sequence_id", "id")
    timed = timing_evidence(frames, "id", "ordinal", "duration_ms").select("id", F.col("n_frames").alias("n_new"), F.col("complete_timing").alias("new_ok"))
    timed_legacy = timing_evidence(legacy, "id", "ordinal", "duration_ms").select("id", F.col("n_frames").alias("n_old"), F.col("complete_timing").alias("old_ok"))
    shape = frames.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "phase"))), lambda x: x["phase"]).alias("phases"),
        F.min_by(F.struct("view", "direction"), "ordinal").alias("first_frame"))
    digests = frames.select("id", F.col("source_blob_sha256").alias("d")).unionByName(legacy.select("id", F.col("blob_sha256").alias("d"))).unionByName(
        t["sequences"].select("id", F.col("source_blob_sha256").alias("d"))).where("d is not null")
    blobs = digests.groupBy("id").agg(F.array_sort(F.collect_set("d")).alias("source_blob_sha256"))
    # most blobs are in no group: where the groups are few, the blobs stay where they are
    few = groups.limit(FEW + 1).count() <= FEW
    dups = digests.join(F.broadcast(groups) if few else groups, digests["d"] == groups["blob"]).groupBy("id").agg(F.array_sort(F.collect_set("duplicate_group")).alias("_dup"))
    subjects = t["sequence_subjects"].join(t["entities"].select(F.col("id").alias("entity_id"), "entity_class"), "entity_id").groupBy(F.col("sequence_id").alias("id")).agg(
        F.min_by(F.struct("entity_id", "entity_class"), F.struct(F.col("role") != "primary", "role", "entity_id")).alias("subject"),
        F.array_sort(F.collect_set(F.concat(F.lit("entity:"), "entity_id"))).alias("_entities"))
    packs = t["sequence_occurrences"].groupBy(F.col("sequence_id").alias("id")).agg(F.min("archive_blob_sha256").alias("_archive"))
    named = sources.groupBy("id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    of_item = t["items"].select(F.col("id").alias("item_id"), F.col("source_id").alias("_item_source"))

    joined = base.drop("source_blob_sha256")
    for side in (timed, timed_legacy, shape, blobs, dups, subjects, packs, named):
        joined = joined.join(side, "id", "left")
    joined = joined.join(of_item, "item_id", "left")
    n = F.col("frame_count")
    duration_source = F.when(F.coalesce(F.col("new_ok") & (F.col("n_new") == n), F.lit(False)), "sequence_frames.duration_ms").when(
        F.coalesce(F.col("old_ok") & (F.col("n_old") == n), F.lit(False)), "frames.duration_ms")
    claims = F.array_sort(F.concat(*[
        F.transform(negative_claims(F.col(c), TIMING_FIELDS), lambda f, p=p: F.concat(F.lit(p), f, F.lit("=false")))
        for c, p in (("metadata_json", "sequence_metadata."), ("conditioning_json", "conditioning."))]))
    none = F.array().cast("array<string>")
    out = joined.withColumn("duration_source", duration_source).withColumn("negative_claims", claims).withColumn(
        "temporal_known", (n > 1) & F.col("duration_source").isNotNull() & (F.size("negative_claims") == 0))
    mode = F.coalesce(F.when(F.col("loop_mode") != "", F.col("loop_mode")), F.lit("unknown"))
    ready = F.col("temporal_known") & (F.col("duration_source") == "sequence_frames.duration_ms") & phases_ready(F.col("phases"), mode)
    gate = {"known": F.col("temporal_known"), "pose_only": ~F.col("temporal_known"), "all": F.lit(True), "model_ready": F.coalesce(ready, F.lit(False))}
    source_id = F.coalesce("_item_source", F.get("source_ids", F.lit(0)), F.lit("unresolved"))
    return out.where(gate[filters.temporal_mode]).select(
        F.col("id").alias("sequence_id"),
        F.coalesce("subject.entity_id", F.concat(F.lit("unassigned:"), "id")).alias("identity_id"),
        source_id.alias("source_id"),
        F.coalesce("item_id", F.concat(F.lit("archive:"), "_archive"), F.concat(F.lit("source:"), source_id)).alias("source_pack_id"),
        F.coalesce("subject.entity_class", F.lit("unknown")).alias("entity_class"),
        F.col("selected_action").alias("action"),
        _filled(F.col("motion_view"), F.col("first_frame.view")).alias("view"),
        _filled(F.col("motion_direction"), F.col("direction"), F.col("first_frame.direction")).alias("direction"),
        mode.alias("loop_mode"), "frame_count",
        F.coalesce("source_blob_sha256", none).alias("source_blob_sha256"),
        F.array_sort(F.concat(F.coalesce("_entities", none), F.coalesce("_dup", none))).alias("duplicate_group_ids"),
        F.coalesce("source_ids", none).alias("source_ids"),
        "quality_tier", "temporal_known", "duration_source", "negative_claims",
    )


def assignments(spark: SparkSession, samples: DataFrame, policy: SplitPolicy) -> DataFrame:
    """(sequence_id, component_id, split): samples tied by identity, pack, blob or duplicate group share one split."""
    # sequences of one identity are one node; tokens are only compared, so 128 bits of each stand for it
    tokens = samples.select("identity_id", F.explode(F.array_distinct(F.concat(
        F.array(F.concat(F.lit("pack:"), "source_pack_id")),
        F.transform("source_blob_sha256", lambda d: F.concat(F.lit("blob:"), d)),
        F.transform("duplicate_group_ids", lambda d: F.concat(F.lit("group:"), d))))).alias("token")).select("identity_id", F.unhex(F.md5("token")).alias("token"))
    scratch = Scratch(spark, "assignments")
    edges = scratch.write(star_edges(tokens, "identity_id", "token").where("src <> dst").distinct(), "edges")
    found = components(spark, edges)
    per = samples.groupBy("identity_id").agg(F.min("sequence_id").alias("first"), F.count("*").alias("n"))
    tied = scratch.write(per.join(found.withColumnRenamed("node", "identity_id"), "identity_id", "left").withColumn("component", F.coalesce("component", "identity_id")), "tied")
    # named after its first member, so a component of any size is named without gathering it, and keeps its split as it grows
    whole = tied.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    named = tied.select("identity_id", "component").join(whole, "component").select("identity_id", F.concat(F.lit("component:"), F.sha2("first", 256)).alias("component_id"), "n")
    total = tied.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = lookup_join(samples.select("sequence_id", "identity_id"), named, "identity_id", hot=hottest(tied, "identity_id", total)).select("sequence_id", "component_id", "n")
    if policy.strategy == "hash":
        return placed.select("sequence_id", "component_id", hash_split(policy.seed, F.col("component_id"), policy.ratios).alias("split"))
    sizes = sorted((r["component_id"], r["n"]) for r in placed.select("component_id", "n").distinct().collect())
    splits = spark.createDataFrame(sorted(balanced_splits(sizes, policy.ratios, policy.seed).items()) or [("", "")], "component_id string, split string")
    return placed.drop("n").join(splits, "component_id").select("sequence_id", "component_id", "split")


@dataclass
class Snapshot:
    """``members`` are the samples without the edges of their duplicate groups, which may outgrow all else."""

    samples: DataFrame
    members: DataFrame
    assignments: DataFrame
    coverage: DataFrame
    timing: dict[str, int]
    filters: Filters
    policy: SplitPolicy

    def leaks(self) -> int:
        """Components in more than one split, and samples without a split: both must be none."""
        torn = self.assignments.groupBy("component_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
        return torn + self.members.join(self.assignments, "sequence_id", "left_anti").count()

    def chunks(self):
        """The canonical artifact, streamed in key order: equal indexes give equal bytes."""
        def rows(df: DataFrame, *order: str):
            for i, r in enumerate(df.orderBy(*order).toLocalIterator()):
                yield ("," if i else "") + canonical_text(r.asDict(recursive=True))

        yield b'{"assignments":['
        yield from (x.encode() for x in rows(self.assignments, "sequence_id"))
        yield b'],"coverage":['
        yield from (x.encode() for x in rows(self.coverage, "split", "dimension", "value"))
        yield f'],"filters":{canonical_text(asdict(self.filters))},"policy":{canonical_text(asdict(self.policy))},"samples":['.encode()
        yield from (x.encode() for x in rows(self.samples, "sequence_id"))
        yield f'],"timing_counts":{canonical_text(self.timing)}}}'.encode()

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for chunk in self.chunks():
            digest.update(chunk)
        return digest.hexdigest()


def build_snapshot(spark: SparkSession, root: str, filters: Filters = Filters(), policy: SplitPolicy = SplitPolicy()) -> Snapshot:
    """The snapshot of the index under ``root``; absent tables count as empty."""
    tables = {name: schema.read(spark, root, name) for name in schema.TABLES}
    return snapshot_of(spark, tables, filters, policy)


def snapshot_of(spark: SparkSession, tables: Mapping[str, DataFrame], filters: Filters, policy: SplitPolicy) -> Snapshot:
    scratch = Scratch(spark, "snapshot")
    edges = tables["duplicate_edges"]
    groups = scratch.write(duplicate_groups(spark, edges), "groups")
    members = scratch.write(load_samples(tables, filters, groups), "samples")
    placed = scratch.write(assignments(spark, members, policy), "assignments")
    covered = coverage(members.join(placed, "sequence_id"), "split", ["entity_class", "action", "loop_mode", "view"])
    known = members.agg(F.count_if("temporal_known").alias("known"), F.count_if(~F.col("temporal_known")).alias("pose_only")).first()
    return Snapshot(with_edges(members, edges, groups), members, placed, covered, known.asDict(), filters, policy)


def driver_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The test tables seen as a provenance index.

    Entities are identities by their letters and digits. A sequence carries the
    digest of its decoded array; equal arrays of differing files give star
    edges from the array to each of the files.
    """
    from framewright.functions.keys import digest, letters_and_digits
    from framewright.session import load

    tables = {name: schema.empty(spark, name) for name in schema.TABLES}
    # one row per sequence, made once: every table below reads it
    held = load(spark, root, "prepared_broad_rows").select("sequence_id", "identity_id", "action", "source_id", "source_file_sha256", "normalized_array_sha256", "frame_phases")
    rows = Scratch(spark, "index").write(held.dropDuplicates(["sequence_id"]).select(
        "sequence_id", letters_and_digits(F.col("identity_id")).alias("identity_id"), "action", "source_id", "frame_phases",
        digest(F.col("source_file_sha256")).alias("file"), digest(F.col("normalized_array_sha256")).alias("array")), "rows")
    blob, array = F.col("file"), F.col("array")

    def shaped(df: DataFrame, name: str) -> DataFrame:
        held = dict(df.dtypes)
        return df.select(*[(F.col(c) if c in held else F.lit(None)).cast(k).alias(c) for c, k in tables[name].dtypes])

    tables["items"] = shaped(load(spark, root, "corpus_items").dropDuplicates(["id"]), "items")
    tables["sequences"] = shaped(rows.select(
        F.col("sequence_id").alias("id"), F.coalesce(array, blob).alias("source_blob_sha256"), F.greatest(F.size("frame_phases"), F.lit(0)).alias("frame_count"),
        F.lit("loop").alias("loop_mode"), "action", F.lit("F0").alias("quality_tier")), "sequences")
    tables["sequence_source_keys"] = shaped(rows.where("source_id is not null").select("source_id", F.col("sequence_id").alias("external_sequence_key"), "sequence_id"), "sequence_source_keys")
    tables["entities"] = shaped(rows.where("identity_id is not null").groupBy(F.col("identity_id").alias("id")).agg(F.min("source_id").alias("source_id"), F.lit("creature").alias("entity_class")), "entities")
    tables["sequence_subjects"] = shaped(rows.where("identity_id is not null").select("sequence_id", F.col("identity_id").alias("entity_id"), F.lit("primary").alias("role")), "sequence_subjects")
    tables["sequence_occurrences"] = shaped(rows.where(blob.isNotNull()).select("sequence_id", blob.alias("archive_blob_sha256"), F.lit(0).alias("archive_member_ordinal"), F.lit("member").alias("occurrence_role")), "sequence_occurrences")
    tables["sequence_frames"] = shaped(rows.select("sequence_id", blob.alias("source_blob_sha256"), F.posexplode("frame_phases").alias("ordinal", "phase"), F.lit(100.0).alias("duration_ms")), "sequence_frames")
    held = rows.select(array.alias("left_blob_sha256"), blob.alias("right_blob_sha256")).where("left_blob_sha256 is not null and right_blob_sha256 is not null").distinct()
    shared = held.groupBy("left_blob_sha256").agg(F.count("*").alias("_n")).where("_n > 1").select("left_blob_sha256")
    tables["duplicate_edges"] = shaped(held.join(shared, "left_blob_sha256").withColumn("id", F.concat_ws(":", F.lit("exact"), "left_blob_sha256", "right_blob_sha256")), "duplicate_edges")
    return tables


def dataset_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Samples of the test tables with component and split, tied by identity, equal arrays, source file and pack."""
    shot = snapshot_of(spark, driver_index(spark, root), Filters(minimum_frames=2, temporal_mode="known"), SplitPolicy())
    return shot.members.join(shot.assignments, "sequence_id").select("sequence_id", "identity_id", "source_pack_id", "action", "frame_count", "component_id", "split")


QUERIES = {"dataset_snapshot": dataset_snapshot}
_PLAIN = r"""regexp_replace(lower(translate(identity_id,
    (SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)),
    (SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)))), '[^\p{L}\p{N}]+', '', 'g')"""
_HEX = "regexp_replace(regexp_replace(lower({c}), 'sha-?256', ''), '[^0-9a-z]+', '', 'g')"
ORACLES = {
    "dataset_snapshot": """
        WITH RECURSIVE p AS (SELECT *, {file} AS f, {array} AS a, {plain} AS i
            FROM (SELECT DISTINCT ON (sequence_id) * FROM prepared_broad_rows ORDER BY sequence_id)),
        q AS (SELECT sequence_id, source_id, action, frame_phases, CASE WHEN i NOT IN ('', 'unknown') THEN i END AS identity_id,
            CASE WHEN regexp_full_match(f, '[0-9a-f]{{64}}') AND NOT regexp_full_match(f, '0+') THEN f END AS file,
            CASE WHEN regexp_full_match(a, '[0-9a-f]{{64}}') AND NOT regexp_full_match(a, '0+') THEN a END AS arr FROM p),
        u AS (SELECT *, least(source_id, min(source_id) OVER (PARTITION BY identity_id)) AS src FROM q),
        s AS (SELECT sequence_id, coalesce(identity_id, 'unassigned:' || sequence_id) AS identity_id,
            coalesce('archive:' || file, 'source:' || coalesce(CASE WHEN identity_id IS NULL THEN source_id ELSE src END, 'unresolved')) AS source_pack_id,
            lower(coalesce(nullif(trim(action), ''), 'unknown')) AS action, CAST(len(frame_phases) AS INTEGER) AS frame_count, file, arr FROM u WHERE len(frame_phases) >= 2),
        many AS (SELECT arr FROM (SELECT DISTINCT arr, file FROM q WHERE arr IS NOT NULL AND file IS NOT NULL) GROUP BY arr HAVING count(*) > 1),
        linked AS (SELECT DISTINCT arr, file FROM q WHERE arr IN (FROM many) AND file IS NOT NULL),
        t AS (SELECT sequence_id, 'i' || identity_id AS token FROM s UNION ALL SELECT sequence_id, 'p' || source_pack_id FROM s
            UNION ALL SELECT sequence_id, 'b' || file FROM s WHERE file IS NOT NULL UNION ALL SELECT sequence_id, 'b' || arr FROM s WHERE arr IS NOT NULL
            UNION ALL SELECT s.sequence_id, 'b' || l.arr FROM s JOIN linked l ON s.file = l.file),
        c AS (SELECT token, min(sequence_id) AS centre FROM t GROUP BY 1), e AS (SELECT DISTINCT sequence_id AS a, centre AS b FROM t JOIN c USING (token)),
        w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM w UNION SELECT r.node, w.b FROM r JOIN w ON r.seen = w.a),
        g AS (SELECT node AS sequence_id, 'component:' || sha256(min(seen)) AS component_id FROM r GROUP BY 1),
        h AS (SELECT *, ('0x' || substr(sha256('snapshot' || chr(0) || component_id), 1, 16))::UBIGINT AS x FROM g)
        SELECT s.sequence_id, identity_id, source_pack_id, action, frame_count, component_id,
            CASE WHEN x < {train}::UBIGINT THEN 'train' WHEN x < {validation}::UBIGINT THEN 'validation' ELSE 'test' END AS split FROM s JOIN h USING (sequence_id)
    """.format(
        file=_HEX.format(c="source_file_sha256"), array=_HEX.format(c="normalized_array_sha256"), plain=_PLAIN,
        train=int(0.8 * 2**64), validation=int((0.8 + 0.1) * 2**64),
    ),
}
