import pytest
from pyspark.sql import functions as F

from framewright.operators.selection import Filters
from framewright.plans import snapshot as N
from framewright.sources import schema

A, B, C, D, E, G = (letter * 64 for letter in "abcdef")
POLICY = N.SplitPolicy(seed="fixture")


def index(spark, **rows):
    out = {}
    for name in schema.TABLES:
        columns = [c.split()[0] for c in schema.TABLES[name][0].split(", ")]
        out[name] = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows.get(name, [])], schema.TABLES[name][0])
    return out


def fixture(spark, **more):
    frame = lambda s, k, blob, ms, phase: {"sequence_id": s, "ordinal": k, "source_blob_sha256": blob, "duration_ms": ms, "phase": phase, "view": "side"}
    sequence = lambda i, item, blob, n, action, mode="loop", meta=None: {
        "id": i, "item_id": item, "source_blob_sha256": blob, "frame_count": n, "loop_mode": mode, "action": action, "direction": "right", "quality_tier": "F0", "metadata_json": meta}
    rows = {
        "items": [{"id": "wolf-pack", "source_id": "s1"}, {"id": "knight-pack", "source_id": "s1"}],
        "entities": [{"id": "wolf", "source_id": "s1", "entity_class": "animal"}, {"id": "knight", "source_id": "s2", "entity_class": "humanoid"}],
        "sequences": [
            sequence("pose-run", "wolf-pack", B, 2, "Run", meta='{"exact_engine_timing": false}'), sequence("single", "wolf-pack", D, 1, "idle"),
            sequence("timed-attack", "knight-pack", C, 2, "", "one_shot"), sequence("timed-idle", "wolf-pack", A, 2, "idle"),
        ],
        "sequence_subjects": [{"sequence_id": s, "entity_id": e, "role": "primary"} for s, e in (("pose-run", "wolf"), ("single", "wolf"), ("timed-attack", "knight"), ("timed-idle", "wolf"))],
        "motion_annotations": [{"sequence_id": "timed-attack", "normalized_action": "ATTACK", "view": "front", "conditioning_json": '{"timing_known": true}'}],
        "sequence_frames": [
            frame("timed-idle", 1, E, 100.0, 0.5), frame("timed-idle", 0, A, 100.0, 0.0), frame("timed-attack", 0, C, 50.0, 0.0), frame("timed-attack", 1, C, 50.0, 1.0),
            frame("pose-run", 0, B, 80.0, 0.0), frame("pose-run", 1, B, 80.0, 0.5), frame("single", 0, D, 80.0, 0.0)],
        "duplicate_edges": [{"id": "e1", "left_blob_sha256": A, "right_blob_sha256": E}, {"id": "e2", "left_blob_sha256": E, "right_blob_sha256": C}],
    }
    return index(spark, **(rows | more))


def samples(shot):
    return {r["sequence_id"]: r for r in shot.samples.collect()}


def test_known_sequences_share_a_split_through_a_chain_of_copies(spark):
    shot = N.snapshot_of(spark, fixture(spark), Filters(minimum_frames=2, temporal_mode="known"), POLICY)
    got = samples(shot)
    assert set(got) == {"timed-idle", "timed-attack"}
    assert got["timed-attack"]["action"] == "attack" and got["timed-attack"]["view"] == "front" and got["timed-idle"]["view"] == "side"
    assert got["timed-idle"]["duplicate_edge_ids"] == ["e1", "e2"] and got["timed-idle"]["source_blob_sha256"] == [A, E]
    placed = shot.assignments.collect()
    assert len({r["component_id"] for r in placed}) == 1 and len({r["split"] for r in placed}) == 1
    assert shot.timing == {"known": 2, "pose_only": 0} and shot.leaks() == 0
    assert shot.sha256() == N.snapshot_of(spark, {k: v.repartition(3) for k, v in fixture(spark).items()}, Filters(minimum_frames=2, temporal_mode="known"), POLICY).sha256()


def test_modes_and_sources(spark):
    t = fixture(spark)
    run = lambda **f: set(samples(N.snapshot_of(spark, t, Filters(**f), POLICY)))
    assert run() == {"pose-run", "single", "timed-attack", "timed-idle"}
    assert run(temporal_mode="pose_only") == {"pose-run", "single"}
    assert run(temporal_mode="model_ready") == {"timed-idle", "timed-attack"}
    assert run(include_sources=("s2",)) == {"timed-attack"}
    assert run(exclude_sources=("s2",)) == {"pose-run", "single", "timed-idle"}
    assert run(actions=("RUN",)) == {"pose-run"}


def test_fallbacks_and_empty_index(spark):
    lone = [{"id": "x", "frame_count": 1, "loop_mode": None, "action": None, "quality_tier": "F0", "metadata_json": "{broken"}]
    got = samples(N.snapshot_of(spark, index(spark, sequences=lone), Filters(), POLICY))["x"]
    assert (got["identity_id"], got["source_id"], got["source_pack_id"], got["action"], got["view"], got["loop_mode"]) == (
        "unassigned:x", "unresolved", "source:unresolved", "unknown", "unknown", "unknown")
    empty = N.snapshot_of(spark, index(spark), Filters(), N.SplitPolicy(strategy="balanced"))
    assert empty.samples.count() == 0 and empty.timing == {"known": 0, "pose_only": 0} and empty.leaks() == 0


def test_policy_and_balanced(spark):
    with pytest.raises(ValueError):
        N.SplitPolicy(train=0.5)
    rows = [{"id": f"q{i:02d}", "item_id": f"p{i}", "frame_count": 1, "quality_tier": "F0"} for i in range(30)]
    subjects = [{"sequence_id": f"q{i:02d}", "entity_id": f"e{i}", "role": "primary"} for i in range(30)]
    entities = [{"id": f"e{i}", "source_id": "s"} for i in range(30)]
    shot = N.snapshot_of(spark, index(spark, sequences=rows, sequence_subjects=subjects, entities=entities), Filters(), N.SplitPolicy(strategy="balanced"))
    assert {r["split"]: r["n"] for r in shot.assignments.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 24, "validation": 3, "test": 3}


def test_driver_tables_tie_equal_arrays_and_spellings_of_an_identity(spark, tmp_path):
    # array A lies in two files, B in a file and in none; two spellings of one identity; strangers named unknown
    rows = [("q1", "Wolf", A, D), ("q2", "bear", A.upper(), E), ("q3", "WOLF!", None, None), ("q4", "Unknown", B, G), ("q5", "unknown", C, None), ("q6", "elk", B, None), ("q7", "owl", C[:-1] + "d", "0" * 64)]
    table = [(s, i, "run", f"s{k}", array, file, [0.0, 0.5]) for k, (s, i, array, file) in enumerate(rows)]
    columns = "sequence_id string, identity_id string, action string, source_id string, normalized_array_sha256 string, source_file_sha256 string, frame_phases array<double>"
    spark.createDataFrame([*table, table[0]], columns).write.parquet(str(tmp_path / "prepared_broad_rows.parquet"))
    spark.createDataFrame([("i", "s")], "id string, source_id string").write.parquet(str(tmp_path / "corpus_items.parquet"))
    edges = N.driver_index(spark, str(tmp_path))["duplicate_edges"].collect()
    assert {(r["left_blob_sha256"], r["right_blob_sha256"]) for r in edges} == {(A, D), (A, E)}
    got = {r["sequence_id"]: r for r in N.dataset_snapshot(spark, str(tmp_path)).collect()}
    groups = {}
    for s, r in got.items():
        groups.setdefault(r["component_id"], set()).add(s)
    assert sorted(map(sorted, groups.values())) == [["q1", "q2", "q3"], ["q4", "q6"], ["q5"], ["q7"]]
    assert all(len({got[s]["split"] for s in g}) == 1 for g in groups.values())


def test_a_large_duplicate_group_lays_no_edge_lists_beside_its_blobs(spark):
    # a star of 300 copies: every sample has all 300 edges, but what is stored and placed carries the group's name only
    ids = [f"{k:064x}" for k in range(1, 301)]
    t = index(
        spark, sequences=[{"id": f"q{k:03d}", "source_blob_sha256": b, "frame_count": 1, "quality_tier": "F0"} for k, b in enumerate(ids)],
        duplicate_edges=[{"id": f"e{k:03d}", "left_blob_sha256": A, "right_blob_sha256": b} for k, b in enumerate(ids)])
    shot = N.snapshot_of(spark, t, Filters(), POLICY)
    assert "duplicate_edge_ids" not in shot.members.columns and shot.members.count() == 300
    got = samples(shot)
    assert all(r["duplicate_edge_ids"] == [f"e{k:03d}" for k in range(300)] for r in got.values()) and len(got) == 300
    assert len({r["component_id"] for r in shot.assignments.collect()}) == 1 and shot.leaks() == 0
