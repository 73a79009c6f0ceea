"""Queries of training plans, audits and picks with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.hashing import hash_split
from framewright.functions.keys import digest, letters_and_digits, split_name
from framewright.operators import planning as P
from framewright.operators.skew import union_all
from framewright.plans.reporting import SPLIT
from framewright.session import load

# Role rules of file and property words, in order of priority.
ROLES = [("sound", ["sound", "volume", "snd"]), ("timing", ["spawn", "rate", "next"]), ("look", ["tint", "depth", "layer"]), ("action", ["action", "play", "hit"])]
RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}
VERBS = ["idle", "parry", "crouch", "lunge thrust", "double jump"]


def _clips(spark: SparkSession, root: str) -> DataFrame:
    """One row per sequence of the motion table."""
    timed = F.forall("duration_ms", lambda d: F.coalesce(d > 0, F.lit(False))) & (F.size("duration_ms") > 0)
    return load(spark, root, "latent_motion_training_rows").groupBy("sequence_id").agg(
        F.min(letters_and_digits(F.col("identity_id"))).alias("identity"), F.min(F.lower(F.trim("verb"))).alias("verb"), F.min(split_name(F.col("split"))).alias("split"),
        F.min("loop_mode").alias("loop_mode"), F.min("source_id").alias("source_id"), F.max("action_index").alias("action_index"),
        F.min(F.when(timed, "all_pass").otherwise("partial")).alias("gate"), F.max("duration_ms").alias("durations"))


def _frames(spark: SparkSession, root: str) -> DataFrame:
    """One row per sequence of the frame table."""
    return load(spark, root, "prepared_broad_rows").groupBy("sequence_id").agg(
        F.min(letters_and_digits(F.col("identity_id"))).alias("identity"), F.min(F.lower(F.trim("action"))).alias("action"), F.min(split_name(F.col("split"))).alias("split"),
        F.min(digest(F.col("normalized_array_sha256"))).alias("array"), F.min(digest(F.col("source_file_sha256"))).alias("file"),
        F.max(F.coalesce(F.size("frame_phases"), F.lit(0))).alias("n_frames"), F.min("source_id").alias("source_id"))


def gated_motions(spark: SparkSession, root: str) -> DataFrame:
    """Clips of the wanted verbs with whole timing, and the others by reason."""
    chosen, excluded = P.gated(_clips(spark, root), VERBS, "verb", "gate", "all_pass")
    return excluded.unionByName(chosen.agg(F.count("*").alias("n_rows")).select(F.lit("chosen").alias("reason"), "n_rows"))


def crossing_identities(spark: SparkSession, root: str) -> DataFrame:
    """Identities whose frames stand in more than one split."""
    return P.crossing(_frames(spark, root), "identity", "split")


def subject_decisions(spark: SparkSession, root: str) -> DataFrame:
    """Clips per verb that keep their subject, by decisions drawn from their fields."""
    n = F.coalesce(F.col("action_index"), F.lit(0))
    decision = {
        "presence": F.when(F.col("gate") == "all_pass", "all_frames").otherwise("some_frames"), "relation": F.when(n % 5 != 0, "same_primary_subject"),
        "match": F.when(n % 3 == 0, "clear").when(n % 3 == 1, "plausible").otherwise("no"), "role": F.when(n % 2 == 0, "primary_subject_motion").otherwise("primary_subject_with_effects"),
        "secondary": F.when(n % 7 == 0, F.array(F.lit("assist_subject"))).when(n % 7 == 1, F.array(F.lit("none")))}
    return _clips(spark, root).groupBy(F.coalesce("verb", F.lit("none")).alias("verb")).agg(F.count_if(P.same_subject(decision)).alias("n_kept"), F.count("*").alias("n_clips"))


def taxonomy_counters(spark: SparkSession, root: str) -> DataFrame:
    """Counts of every value of verb, split, loop mode and number, null as unresolved, and identities with two verbs or more."""
    clips = _clips(spark, root)
    counts = P.field_counters(clips, ["verb", "split", "loop_mode", "action_index"])
    per = clips.where("identity is not null").groupBy("identity").agg(F.count_distinct("verb").alias("n"))
    more = per.agg(F.count("*").alias("identity_count"), F.count_if(F.col("n") >= 2).alias("multi_verb_identity_count"))
    return counts.unionByName(more.select(F.explode(F.array(*[F.struct(F.lit("identities").alias("field"), F.lit(c).alias("value"), F.col(c).alias("n_rows")) for c in more.columns])).alias("x")).select("x.*"))


def evidence_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Property references per role with their distinct scripts, and the role's basis."""
    rows = load(spark, root, "raw_properties")
    role, _ = P.role_of(F.split(F.lower(F.trim("property_name")), "_"), ROLES, "other")
    return P.evidence_inventory(rows.where("property_name is not null"), role, F.col("script_path"))


def property_roles(spark: SparkSession, root: str) -> DataFrame:
    """Distinct property names with role and the word it rests on."""
    names = load(spark, root, "raw_properties").where("property_name is not null").select("property_name").distinct()
    role, basis = P.role_of(F.split(F.lower(F.trim("property_name")), "_"), ROLES, "other")
    return names.select("property_name", role.alias("role"), F.coalesce(basis, F.lit("")).alias("basis"))


def retiered_frames(spark: SparkSession, root: str) -> DataFrame:
    """Frames by tier from stored metrics alone: eligible ones, and each reason of the others."""
    frames = _frames(spark, root)
    from framewright.operators.selection import reasons

    why = reasons((F.col("n_frames") < 4, "too_few_frames"), (F.col("array").isNull(), "array_absent"), (F.col("file").isNull(), "file_absent"), (F.col("split").isNull(), "split_absent"))
    marked = frames.select(F.when(F.size(why) == 0, F.array(F.lit("eligible"))).otherwise(why).alias("why"))
    return marked.select(F.explode("why").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))


def representative_quality(spark: SparkSession, root: str) -> DataFrame:
    """Least duration of a clip and the greatest distance of its durations from their first."""
    d = F.col("durations")
    ratio = F.transform(d, lambda x: F.when(F.get(d, F.lit(0)) > 0, x / F.get(d, F.lit(0))))
    return _clips(spark, root).select("sequence_id", *P.worst_metrics({"duration": d}, ratio)).select(
        "sequence_id", F.round(F.coalesce("minimum_duration", F.lit(-1.0)), 6).alias("minimum_duration"), F.round(F.coalesce("maximum_occupancy_deviation", F.lit(-1.0)), 6).alias("maximum_occupancy_deviation"))


def roster_counts(spark: SparkSession, root: str) -> DataFrame:
    """Per source: items, those with an address, distinct addresses, tagged as characters, most frames claimed."""
    items = load(spark, root, "corpus_items").where("source_id is not null")
    frames = F.try_variant_get(F.try_parse_json("metadata_json"), "$.frames", "int")
    return items.groupBy("source_id").agg(
        F.count("*").alias("n_items"), F.count_if(F.col("canonical_url").isNotNull()).alias("n_linked"), F.count_distinct("canonical_url").alias("n_urls"),
        F.count_if(F.coalesce(F.contains("metadata_json", F.lit('"npc"')), F.lit(False))).alias("n_npc"), F.coalesce(F.max(frames), F.lit(0)).alias("most_frames"))


def caption_counters(spark: SparkSession, root: str) -> DataFrame:
    """Captions per source: empty fields, most and mean words, and those that give their title away."""
    items = load(spark, root, "corpus_items").where("source_id is not null").groupBy("source_id", "id").agg(
        F.min("title").alias("title"), F.min("description").alias("description"), F.min("creator_name").alias("creator"))
    words = F.size(F.filter(F.split(F.trim(F.coalesce("description", F.lit(""))), r"\s+"), lambda w: w != ""))
    bare = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    leak = (F.length(bare) >= 4) & F.contains(F.lower("description"), bare)
    empty = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    return items.groupBy("source_id").agg(
        F.count("*").alias("n_captions"), empty("title").alias("n_empty_title"), empty("description").alias("n_empty_description"), empty("creator").alias("n_empty_creator"),
        F.max(words).alias("most_words"), F.round(F.avg(words), 6).alias("mean_words"), F.count_if(F.coalesce(leak, F.lit(False))).alias("n_leaks"))


def validation_frames(spark: SparkSession, root: str) -> DataFrame:
    """The 64 frames of least hash over all sequences."""
    frames = _frames(spark, root)
    return P.frame_plan(frames, "sequence_id", [F.coalesce("identity", F.lit("")), F.coalesce("action", F.lit(""))], F.col("n_frames"), 64)


def distinct_arrays(spark: SparkSession, root: str) -> DataFrame:
    """Per identity and in the order of actions the first two sequences whose arrays differ."""
    rows = _frames(spark, root).where("identity is not null and array is not null").withColumn("action", F.coalesce("action", F.lit("")))
    return P.first_distinct(rows, "identity", ["action", "sequence_id"], "array", 2).select("identity", "action", "sequence_id", "place")


def frame_choices(spark: SparkSession, root: str) -> DataFrame:
    """Per identity and action the sequence to use, split train first, then by key, and how many others there are."""
    rows = _frames(spark, root).where("identity is not null and action is not null")
    return P.chosen_with_alternates(rows, ["identity", "action"], [F.coalesce(F.col("split") != "train", F.lit(True)), F.col("sequence_id")], "sequence_id")


def action_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Of the first 500 identities the first pair of actions whose arrays differ."""
    return P.matched_pairs(_frames(spark, root).where("identity is not null and action is not null and array is not null"), "identity", "action", "array", 500)


def reference_plan(spark: SparkSession, root: str) -> DataFrame:
    """Clips with the reference frame of their identity and the agreed splits: same source or another, or why there is none."""
    clips = _clips(spark, root).where("identity is not null")
    frames = _frames(spark, root).where("identity is not null").groupBy("identity").agg(F.min(F.struct("sequence_id", "source_id", "split")).alias("r")).select(
        "identity", F.col("r.sequence_id").alias("reference"), F.col("r.source_id").alias("reference_source"), F.col("r.split").alias("reference_split"))
    told = clips.join(frames, "identity", "left")
    state = (
        F.when(F.col("reference").isNull(), "no_reference").when(~F.col("split").eqNullSafe(F.col("reference_split")), "split_differs")
        .when(F.col("source_id").eqNullSafe(F.col("reference_source")), "same_source").otherwise("cross_source"))
    return told.groupBy(state.alias("relation")).agg(F.count("*").alias("n_clips"), F.count_distinct("identity").alias("n_identities"))


def still_plan(spark: SparkSession, root: str) -> DataFrame:
    """Items joined with what their documents say of them, where both name the same source: rows, and the faults of the rest."""
    items = load(spark, root, "corpus_items").groupBy("id").agg(F.min("source_id").alias("source_id"), F.min("title").alias("title"))
    docs = load(spark, root, "documents").where("item_id is not null").groupBy(F.col("item_id").alias("id")).agg(F.min(F.concat(F.lit("source_"), letters_and_digits(F.col("source")))).alias("source_id"), F.count("*").alias("n_docs"))
    rows, faults = P.agreed_join(items, docs, "id", ["source_id"])
    return faults.unionByName(rows.agg(F.count("*").alias("n_keys")).select(F.lit("agreed").alias("fault"), "n_keys"))


def identity_agreement(spark: SparkSession, root: str) -> DataFrame:
    """Fields of clips by the identities in which they differ."""
    return P.group_agreement(_clips(spark, root).where("identity is not null"), "identity", ["split", "source_id", "loop_mode"])


def dense_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Frames of the dense tier, split as the groups of the whole table are: sequences, identities and actions per split."""
    frames = _frames(spark, root)
    whole = frames.where("identity is not null").select("identity", F.concat(F.lit("component:"), "identity").alias("component")).distinct().withColumn(
        "dense_split", hash_split("dense", F.col("component"), RATIOS))
    dense = frames.where("n_frames >= 4 and array is not null and identity is not null")
    placed = P.inherited_splits(dense.select("sequence_id", "identity", "action"), whole, "identity", "component", "dense_split")
    return placed.groupBy("dense_split").agg(F.count("*").alias("n_sequences"), F.count_distinct("component").alias("n_components"), F.count_distinct("action").alias("n_actions"))


def unified_layouts(spark: SparkSession, root: str) -> DataFrame:
    """Clips and frames as one view of sequences, whatever table holds them."""
    clips = _clips(spark, root).select("sequence_id", "identity", F.col("verb").alias("action"), "split", F.size("durations").alias("n_frames"), F.lit("clip").alias("layout"))
    frames = _frames(spark, root).select("sequence_id", "identity", "action", "split", "n_frames", F.lit("frame").alias("layout"))
    both = clips.unionByName(frames)
    return both.groupBy("layout", F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n_sequences"), F.count_distinct("identity").alias("n_identities"), F.sum(F.greatest("n_frames", F.lit(0))).cast("bigint").alias("n_frames"))


def unique_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Identities per split, and those that have a verb more than once."""
    per = _clips(spark, root).where("identity is not null and verb is not null and split is not null").groupBy("split", "identity", "verb").agg(F.count("*").alias("n"))
    return per.groupBy("split").agg(F.count_distinct("identity").alias("n_identities"), F.count_distinct(F.when(F.col("n") > 1, F.col("identity"))).alias("n_repeating"))


def journal_states(spark: SparkSession, root: str) -> DataFrame:
    """Sequences to be cached against a journal of the train ones: pending, done or changed."""
    work = _frames(spark, root).select("sequence_id", "array")
    journal = _frames(spark, root).where("split = 'train'").select("sequence_id", F.when(F.col("n_frames") % 4 == 0, "old").otherwise(F.col("array")).alias("array"))
    return P.pending(work, journal, "sequence_id", ["array"]).groupBy("state").agg(F.count("*").alias("n_sequences"))


def prompt_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Distinct prompts with their row in a table sorted by prompt, and how many descriptions ask for each."""
    from framewright.operators.ranks import distributed_rank

    found = P.prompt_table(load(spark, root, "semantic_embedding_rows"), "description")
    return distributed_rank(spark, found.withColumn("_all", F.lit(0)), ["_all"], ["prompt"]).select("prompt", "n_rows", (F.col("rank") - 1).alias("table_row"))


def scoped_parents(spark: SparkSession, root: str) -> DataFrame:
    """Class names made of verbs and sources, with parents named without their scope."""
    rows = load(spark, root, "latent_motion_training_rows").where("source_id is not null and action_index is not null").select("source_id", "action_index", "loop_mode").distinct()
    name = F.concat_ws(".", F.lit("game"), "source_id", F.when(F.col("action_index") % 2 == 0, F.coalesce("loop_mode", F.lit("none"))), F.concat(F.lit("A"), "action_index"))
    parent = F.when(F.col("action_index") > 3, F.concat(F.lit("A"), F.col("action_index") - 2)).when(F.col("action_index") == 3, F.lit("source_mossgate"))
    return P.scoped_parents(rows.select(name.alias("name"), parent.alias("parent")).distinct(), "name", "parent").select("name", "parent", F.coalesce("resolved", F.lit("")).alias("resolved"), "method")


def role_loops(spark: SparkSession, root: str) -> DataFrame:
    """Loop mode of every script by the properties that name it."""
    per = load(spark, root, "raw_properties").groupBy("script_path").agg(F.array_sort(F.collect_set(F.lower(F.trim("property_name")))).alias("roles"))  # a handful of names
    return per.select(F.coalesce("script_path", F.lit("")).alias("script_path"), P.loop_of_roles(F.col("roles"), ["action", "play_action"], ["on_hit_action"]).alias("loop_mode"))


def webp_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Sound files among property values whose script is listed, by extension pattern."""
    values = load(spark, root, "raw_properties").select("property_id", F.explode("property_values").alias("path"))
    listed = load(spark, root, "raw_properties").where("lower(trim(property_name)) = 'tint'").select("property_id").unionByName(
        load(spark, root, "raw_properties").where("lower(trim(property_name)) = 'sound_file'").select("property_id")).distinct()
    return values.where(F.lower("path").like("%.ogg")).join(listed, "property_id").select("property_id", "path").distinct()


def index_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Items' metadata read by a schema: how many are objects, what they hold, and what of the rest is broken."""
    held = F.from_json("metadata_json", "struct<frames:int,tags:array<string>>", {"mode": "PERMISSIVE"})
    items = load(spark, root, "corpus_items").select(held.alias("m"), "metadata_json")
    kind = F.when(F.col("metadata_json").isNull(), "absent").when(F.try_parse_json("metadata_json").isNull(), "broken").when(F.col("m.tags").isNull(), "untagged").otherwise(F.element_at("m.tags", -1))
    return items.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_items"), F.coalesce(F.sum(F.when(~kind.isin("absent", "broken"), F.col("m.frames"))), F.lit(0)).alias("n_frames"))


def pair_separation(spark: SparkSession, root: str) -> DataFrame:
    """Per order the ratio of two distances, undefined where the target's is 0, and how often it exceeds one."""
    lines = load(spark, root, "lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") - F.min("l_quantity")).alias("target"), (F.max("l_discount") - F.min("l_discount")).alias("generated"))
    ratio = F.try_divide(F.col("generated") * 100, F.col("target"))
    return lines.agg(F.count("*").alias("n_pairs"), F.count(ratio).alias("n_defined"), F.count_if(ratio > 1).alias("n_wider"), F.round(F.avg(ratio), 6).alias("mean_ratio"))


def exported_split(spark: SparkSession, root: str) -> DataFrame:
    """The test split as lines of an image folder: file name and prompt per sequence."""
    frames = _frames(spark, root).where("split = 'test' and action is not null")
    return frames.select(F.concat("sequence_id", F.lit(".png")).alias("file_name"), F.concat(F.lit("a sprite, "), "action").alias("text"))


QUERIES = {f.__name__: f for f in (
    gated_motions, crossing_identities, subject_decisions, taxonomy_counters, evidence_inventory, property_roles, retiered_frames, representative_quality,
    roster_counts, caption_counters, validation_frames, distinct_arrays, frame_choices, action_pairs, reference_plan, still_plan, identity_agreement,
    dense_manifest, unified_layouts, unique_bundles, journal_states, prompt_vectors, scoped_parents, role_loops, webp_candidates, index_metadata,
    pair_separation, exported_split,
)}

_PLAIN = r"""regexp_replace(lower(translate(identity_id,
    (SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)),
    (SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)))), '[^\p{L}\p{N}]+', '', 'g')"""
_HEX = "regexp_replace(regexp_replace(lower({c}), 'sha-?256', ''), '[^0-9a-z]+', '', 'g')"
_OK = "CASE WHEN regexp_full_match({h}, '[0-9a-f]{{64}}') AND NOT regexp_full_match({h}, '0+') THEN {h} END"
_C = rf"""
    c0 AS (SELECT *, {_PLAIN} AS i, {SPLIT} AS sp, coalesce(len(duration_ms) > 0 AND list_bool_and(list_transform(duration_ms, lambda d: coalesce(d > 0, false))), false) AS ok FROM latent_motion_training_rows),
    c AS (SELECT sequence_id, min(CASE WHEN i NOT IN ('', 'unknown') THEN i END) AS identity, min(lower(trim(verb, ' '))) AS verb, min(sp) AS split, min(loop_mode) AS loop_mode, min(source_id) AS source_id,
        max(action_index) AS action_index, min(CASE WHEN ok THEN 'all_pass' ELSE 'partial' END) AS gate, max(duration_ms) AS durations FROM c0 GROUP BY 1)"""
_F = rf"""
    f0 AS (SELECT *, {_PLAIN} AS i, {SPLIT} AS sp, {_HEX.format(c='normalized_array_sha256')} AS ah, {_HEX.format(c='source_file_sha256')} AS fh FROM prepared_broad_rows),
    f AS (SELECT sequence_id, min(CASE WHEN i NOT IN ('', 'unknown') THEN i END) AS identity, min(lower(trim(action, ' '))) AS action, min(sp) AS split, min({_OK.format(h='ah')}) AS arr, min({_OK.format(h='fh')}) AS file,
        CAST(max(coalesce(len(frame_phases), 0)) AS INTEGER) AS n_frames, min(source_id) AS source_id FROM f0 GROUP BY 1)"""
_ROLE = "string_split(lower(trim(property_name, ' ')), '_')"
_ROLES = "CASE " + " ".join(f"WHEN list_has_any({_ROLE}, {ws}) THEN '{n}'" for n, ws in ROLES) + " ELSE 'other' END"
_BASIS = "CASE " + " ".join(f"WHEN list_has_any({_ROLE}, {ws}) THEN list_filter({_ROLE}, lambda x: list_contains({ws}, x))[1]" for _, ws in ROLES) + " ELSE '' END"
_VERBS = "(" + ", ".join(f"'{v}'" for v in VERBS) + ")"
ORACLES = {
    "gated_motions": f"""
        WITH {_C}, r AS (SELECT CASE WHEN coalesce(verb NOT IN {_VERBS}, true) THEN 'verb:' || coalesce(verb, 'none') WHEN gate <> 'all_pass' THEN 'pixel_gate:' || gate ELSE 'chosen' END AS reason FROM c)
        SELECT reason, count(*) AS n_rows FROM r GROUP BY 1
    """,
    "crossing_identities": f"WITH {_F} SELECT identity, count(DISTINCT split) AS n_splits FROM f WHERE identity IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "subject_decisions": f"""
        WITH {_C}, d AS (SELECT coalesce(verb, 'none') AS verb, gate, coalesce(action_index, 0) AS n FROM c)
        SELECT verb, count(*) FILTER (gate = 'all_pass' AND n % 5 <> 0 AND n % 3 IN (0, 1) AND n % 7 <> 0) AS n_kept, count(*) AS n_clips FROM d GROUP BY 1
    """,
    "taxonomy_counters": f"""
        WITH {_C}, p AS (SELECT identity, count(DISTINCT verb) AS n FROM c WHERE identity IS NOT NULL GROUP BY 1)
        SELECT 'verb' AS field, coalesce(verb, 'unresolved') AS value, count(*) AS n_rows FROM c GROUP BY 2 UNION ALL SELECT 'split', coalesce(split, 'unresolved'), count(*) FROM c GROUP BY 2
        UNION ALL SELECT 'loop_mode', coalesce(loop_mode, 'unresolved'), count(*) FROM c GROUP BY 2 UNION ALL SELECT 'action_index', coalesce(CAST(action_index AS VARCHAR), 'unresolved'), count(*) FROM c GROUP BY 2
        UNION ALL SELECT 'identities', 'identity_count', count(*) FROM p UNION ALL SELECT 'identities', 'multi_verb_identity_count', count(*) FILTER (n >= 2) FROM p
    """,
    "evidence_inventory": f"SELECT {_ROLES} AS role, count(*) AS n_references, count(DISTINCT script_path) AS n_paths FROM raw_properties WHERE property_name IS NOT NULL GROUP BY 1",
    "property_roles": f"SELECT DISTINCT property_name, {_ROLES} AS role, {_BASIS} AS basis FROM raw_properties WHERE property_name IS NOT NULL",
    "retiered_frames": f"""
        WITH {_F}, w AS (SELECT list_filter([CASE WHEN n_frames < 4 THEN 'too_few_frames' END, CASE WHEN arr IS NULL THEN 'array_absent' END, CASE WHEN file IS NULL THEN 'file_absent' END,
            CASE WHEN split IS NULL THEN 'split_absent' END], lambda x: x IS NOT NULL) AS w FROM f)
        SELECT reason, count(*) AS n_rows FROM (SELECT unnest(CASE WHEN len(w) = 0 THEN ['eligible'] ELSE w END) AS reason FROM w) GROUP BY 1
    """,
    "representative_quality": f"""
        WITH {_C}, d AS (SELECT sequence_id, durations AS d, coalesce(len(durations) > 0 AND len(list_filter(durations, lambda x: x IS NULL)) = 0, false) AS whole FROM c)
        SELECT sequence_id, CASE WHEN whole THEN round(list_min(d), 6) ELSE -1.0 END AS minimum_duration,
            CASE WHEN whole AND d[1] > 0 THEN round(list_max(list_transform(d, lambda x: abs(x / d[1] - 1.0))), 6) ELSE -1.0 END AS maximum_occupancy_deviation FROM d
    """,
    "roster_counts": """
        SELECT source_id, count(*) AS n_items, count(canonical_url) AS n_linked, count(DISTINCT canonical_url) AS n_urls, count(*) FILTER (contains(metadata_json, '"npc"')) AS n_npc,
            coalesce(max(CASE WHEN json_valid(metadata_json) THEN CAST(json_extract_string(metadata_json, '$.frames') AS INTEGER) END), 0) AS most_frames FROM corpus_items WHERE source_id IS NOT NULL GROUP BY 1
    """,
    "caption_counters": r"""
        WITH i AS (SELECT source_id, id, min(title) AS title, min(description) AS d, min(creator_name) AS c FROM corpus_items WHERE source_id IS NOT NULL GROUP BY 1, 2),
        w AS (SELECT *, len(list_filter(string_split(regexp_replace(trim(coalesce(d, '')), '\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS n, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS bare FROM i)
        SELECT source_id, count(*) AS n_captions, count(*) FILTER (trim(coalesce(title, '')) = '') AS n_empty_title, count(*) FILTER (trim(coalesce(d, '')) = '') AS n_empty_description,
            count(*) FILTER (trim(coalesce(c, '')) = '') AS n_empty_creator, CAST(max(n) AS INTEGER) AS most_words, round(avg(n), 6) AS mean_words, count(*) FILTER (length(bare) >= 4 AND contains(lower(d), bare)) AS n_leaks FROM w GROUP BY 1
    """,
    "validation_frames": f"""
        WITH {_F}, e AS (SELECT sequence_id, unnest(range(n_frames)) AS frame, coalesce(identity, '') AS i, coalesce(action, '') AS a FROM f WHERE n_frames > 0),
        h AS (SELECT sequence_id, frame, sha256(i || chr(0) || a || chr(0) || sequence_id || chr(0) || frame) AS h FROM e ORDER BY h LIMIT 64)
        SELECT sequence_id, CAST(frame AS INTEGER) AS frame, CAST(row_number() OVER (ORDER BY h) AS INTEGER) AS place FROM h
    """,
    "distinct_arrays": f"""
        WITH {_F}, g AS (SELECT identity, arr, min((coalesce(action, ''), sequence_id)) AS o FROM f WHERE identity IS NOT NULL AND arr IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT identity, o[1] AS action, o[2] AS sequence_id, CAST(row_number() OVER (PARTITION BY identity ORDER BY o) AS INTEGER) AS place FROM g)
        SELECT * FROM r WHERE place <= 2
    """,
    "frame_choices": f"""
        WITH {_F} SELECT identity, action, first(sequence_id ORDER BY coalesce(split <> 'train', true), sequence_id) AS sequence_id, count(*) - 1 AS n_alternates
        FROM f WHERE identity IS NOT NULL AND action IS NOT NULL GROUP BY 1, 2
    """,
    "action_pairs": f"""
        WITH {_F}, o AS (SELECT identity, action, min(arr) AS d FROM f WHERE identity IS NOT NULL AND action IS NOT NULL AND arr IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT a.identity, min((a.action, b.action)) AS p FROM o a JOIN o b ON a.identity = b.identity AND a.action < b.action AND a.d <> b.d GROUP BY 1)
        SELECT identity, p[1] AS first_action, p[2] AS second_action FROM p ORDER BY identity LIMIT 500
    """,
    "reference_plan": f"""
        WITH {_C}, {_F}, r AS (SELECT identity, first(sequence_id ORDER BY sequence_id) AS ref, first(source_id ORDER BY sequence_id) AS src, first(split ORDER BY sequence_id) AS sp FROM f WHERE identity IS NOT NULL GROUP BY 1),
        s AS (SELECT c.identity, CASE WHEN ref IS NULL THEN 'no_reference' WHEN c.split IS DISTINCT FROM r.sp THEN 'split_differs' WHEN c.source_id IS NOT DISTINCT FROM r.src THEN 'same_source' ELSE 'cross_source' END AS relation
            FROM c LEFT JOIN r USING (identity) WHERE c.identity IS NOT NULL)
        SELECT relation, count(*) AS n_clips, count(DISTINCT identity) AS n_identities FROM s GROUP BY 1
    """,
    "still_plan": r"""
        WITH i AS (SELECT id, min(source_id) AS s FROM corpus_items GROUP BY 1),
        k AS (SELECT item_id AS id, regexp_replace(lower(source), '[^\p{L}\p{N}]+', '', 'g') AS k FROM documents WHERE item_id IS NOT NULL),
        d AS (SELECT id, min(CASE WHEN k NOT IN ('', 'unknown') THEN 'source_' || k END) AS s FROM k GROUP BY 1),
        b AS (SELECT CASE WHEN d.id IS NULL THEN 'left_only' WHEN i.id IS NULL THEN 'right_only' WHEN i.s IS DISTINCT FROM d.s THEN 'differs:source_id' ELSE 'agreed' END AS fault FROM i FULL JOIN d ON i.id = d.id)
        SELECT fault, count(*) AS n_keys FROM b GROUP BY 1 UNION ALL SELECT 'agreed', 0 WHERE NOT EXISTS (SELECT 1 FROM b WHERE fault = 'agreed')
    """,
    "identity_agreement": f"""
        WITH {_C}, p AS (SELECT identity, count(DISTINCT coalesce(split, chr(0))) AS a, count(DISTINCT coalesce(source_id, chr(0))) AS b, count(DISTINCT coalesce(loop_mode, chr(0))) AS c FROM c WHERE identity IS NOT NULL GROUP BY 1)
        SELECT 'split' AS field, count(*) FILTER (a > 1) AS n_groups FROM p UNION ALL SELECT 'source_id', count(*) FILTER (b > 1) FROM p UNION ALL SELECT 'loop_mode', count(*) FILTER (c > 1) FROM p
    """,
    "dense_manifest": f"""
        WITH {_F}, d AS (SELECT *, ('0x' || substr(sha256('dense' || chr(0) || 'component:' || identity), 1, 16))::UBIGINT AS x FROM f WHERE n_frames >= 4 AND arr IS NOT NULL AND identity IS NOT NULL)
        SELECT CASE WHEN x < {int(0.8 * 2**64)}::UBIGINT THEN 'train' WHEN x < {int((0.8 + 0.1) * 2**64)}::UBIGINT THEN 'validation' ELSE 'test' END AS dense_split, count(*) AS n_sequences,
            count(DISTINCT identity) AS n_components, count(DISTINCT action) AS n_actions FROM d GROUP BY 1
    """,
    "unified_layouts": f"""
        WITH {_C}, {_F} SELECT 'clip' AS layout, coalesce(split, 'none') AS split, count(*) AS n_sequences, count(DISTINCT identity) AS n_identities, CAST(sum(coalesce(len(durations), 0)) AS BIGINT) AS n_frames FROM c GROUP BY 2
        UNION ALL SELECT 'frame', coalesce(split, 'none'), count(*), count(DISTINCT identity), CAST(sum(n_frames) AS BIGINT) FROM f GROUP BY 2
    """,
    "unique_bundles": f"""
        WITH {_C}, p AS (SELECT split, identity, verb, count(*) AS n FROM c WHERE identity IS NOT NULL AND verb IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2, 3)
        SELECT split, count(DISTINCT identity) AS n_identities, count(DISTINCT identity) FILTER (n > 1) AS n_repeating FROM p GROUP BY 1
    """,
    "journal_states": f"""
        WITH {_F}, j AS (SELECT sequence_id, CASE WHEN n_frames % 4 = 0 THEN 'old' ELSE arr END AS a FROM f WHERE split = 'train')
        SELECT CASE WHEN j.sequence_id IS NULL THEN 'pending' WHEN j.a IS NOT DISTINCT FROM f.arr THEN 'done' ELSE 'changed' END AS state, count(*) AS n_sequences FROM f LEFT JOIN j USING (sequence_id) GROUP BY 1
    """,
    "prompt_vectors": """
        WITH p AS (SELECT trim(description, ' ') AS prompt, count(*) AS n_rows FROM semantic_embedding_rows WHERE trim(description, ' ') <> '' GROUP BY 1)
        SELECT prompt, n_rows, row_number() OVER (ORDER BY prompt) - 1 AS table_row FROM p
    """,
    "scoped_parents": """
        WITH r AS (SELECT DISTINCT concat_ws('.', 'game', source_id, CASE WHEN action_index % 2 = 0 THEN coalesce(loop_mode, 'none') END, 'A' || action_index) AS name,
            CASE WHEN action_index > 3 THEN 'A' || (action_index - 2) WHEN action_index = 3 THEN 'source_mossgate' END AS parent FROM latent_motion_training_rows WHERE source_id IS NOT NULL AND action_index IS NOT NULL),
        a AS (SELECT DISTINCT name, parent FROM r WHERE parent IS NOT NULL), k AS (SELECT DISTINCT name AS f FROM r),
        s AS (SELECT name, parent, unnest(range(len(string_split(name, '.')))) AS n FROM a),
        t AS (SELECT name, parent, n, CASE WHEN n = 0 THEN parent ELSE array_to_string(string_split(name, '.')[1:n], '.') || '.' || parent END AS f FROM s),
        i AS (SELECT name, parent, arg_max(f, n) AS f FROM t JOIN k USING (f) WHERE f <> name GROUP BY 1, 2),
        u AS (SELECT string_split(f, '.')[-1] AS parent, min(f) AS f FROM k GROUP BY 1 HAVING count(*) = 1)
        SELECT a.name, a.parent, coalesce(i.f, u.f, '') AS resolved, CASE WHEN i.f IS NOT NULL THEN 'scope' WHEN u.f IS NOT NULL THEN 'unique_name' ELSE 'unresolved' END AS method
        FROM a LEFT JOIN i USING (name, parent) LEFT JOIN u ON u.parent = a.parent
    """,
    "role_loops": """
        WITH p AS (SELECT coalesce(script_path, '') AS script_path, bool_or(coalesce(lower(trim(property_name, ' ')) IN ('action', 'play_action'), false)) AS l, bool_or(coalesce(lower(trim(property_name, ' ')) = 'on_hit_action', false)) AS o FROM raw_properties GROUP BY 1)
        SELECT script_path, CASE WHEN l AND o THEN 'role_dependent' WHEN l THEN 'loop' WHEN o THEN 'one_shot' ELSE 'unknown' END AS loop_mode FROM p
    """,
    "webp_candidates": "SELECT DISTINCT property_id, path FROM (SELECT property_id, property_name, unnest(property_values) AS path FROM raw_properties) v WHERE lower(path) LIKE '%.ogg' AND property_id IN (SELECT property_id FROM raw_properties WHERE lower(trim(property_name, ' ')) IN ('tint', 'sound_file'))",
    "index_metadata": """
        WITH k AS (SELECT CASE WHEN metadata_json IS NULL THEN 'absent' WHEN NOT json_valid(metadata_json) THEN 'broken' ELSE coalesce(json_extract_string(metadata_json, '$.tags[#-1]'), 'untagged') END AS kind,
            CASE WHEN json_valid(metadata_json) THEN CAST(json_extract_string(metadata_json, '$.frames') AS INTEGER) END AS n FROM corpus_items)
        SELECT kind, count(*) AS n_items, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_frames FROM k GROUP BY 1
    """,
    "pair_separation": """
        WITH l AS (SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS t, max(l_discount) - min(l_discount) AS g FROM lineitem GROUP BY 1), r AS (SELECT CASE WHEN t <> 0 THEN g * 100 / t END AS r FROM l)
        SELECT count(*) AS n_pairs, count(r) AS n_defined, count(*) FILTER (r > 1) AS n_wider, round(avg(r), 6) AS mean_ratio FROM r
    """,
    "exported_split": f"WITH {_F} SELECT sequence_id || '.png' AS file_name, 'a sprite, ' || action AS text FROM f WHERE split = 'test' AND action IS NOT NULL",
}
