"""Plans over corpora: reference joins, overlays, inheritance, includes, families, credits, calibrations and captions."""

from __future__ import annotations

import re
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators.skew import hottest, lookup_join
from framewright.session import Scratch


def densified(df: DataFrame, group: str, index: str, lane: str, lanes: int, order: str, value: str) -> DataFrame:
    """A full (index, lane) grid per group from sparse declarations.

    The last declaration of a cell stands; a missing cell takes that of lane 0
    and says so ("own", "fallback" or "missing"). Indices run from 0 to the
    greatest declared.
    """
    last = df.groupBy(group, index, lane).agg(F.max_by(value, order).alias("_v"))
    # the grid is generated per group, not by joining everything with everything
    grid = (
        df.groupBy(group).agg(F.max(index).alias("_top"))
        .select(group, F.explode(F.sequence(F.lit(0), F.col("_top"))).alias(index))
        .select(group, index, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias(lane))
    )
    front = last.where(F.col(lane) == 0).select(group, index, F.col("_v").alias("_front"))
    joined = grid.join(last, [group, index, lane], "left").join(front, [group, index], "left")
    state = F.when(F.col("_v").isNotNull(), "own").when(F.col("_front").isNotNull(), "fallback").otherwise("missing")
    return joined.select(group, index, lane, F.coalesce("_v", "_front").alias(value), state.alias("cell_state"))


def overlaid(df: DataFrame, path: str, rank: str, append: Column) -> DataFrame:
    """Layers of one path that are in force: from the last layer that replaces on, in order of rank."""
    base = F.max(F.when(~append, F.col(rank))).over(Window.partitionBy(path))
    return df.withColumn("_base", base).where(F.col("_base").isNull() | (F.col(rank) >= F.col("_base"))).drop("_base")


def inherited(nodes: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """(node, value, depth): the value of the node or of its nearest ancestor that has one.

    Pointers are doubled each round, so a tree of depth d takes log2(d)
    rounds, however deep; a node whose way up runs in a cycle without a value,
    seen once more levels were followed than there are nodes, is unresolved (null).
    """
    scratch = Scratch(nodes.sparkSession, "inherit")
    state = nodes.select(node, F.col(parent).alias("up"), F.col(value).alias("v"), F.lit(0).alias("depth"), F.when(F.col(parent).isNotNull(), 1).otherwise(0).alias("jump"))
    state = scratch.write(state, "0")
    for k in range(1, state.count().bit_length() + 2):
        of = state.select(F.col(node).alias("up"), F.col("up").alias("up2"), F.col("v").alias("v2"), F.col("depth").alias("d2"), F.col("jump").alias("j2"))
        need = F.col("v").isNull()
        after = state.join(of, "up", "left").select(
            node,
            F.when(need & F.col("v2").isNull(), F.col("up2")).alias("up"),
            F.when(need, F.col("v2")).otherwise(F.col("v")).alias("v"),
            F.when(need & F.col("v2").isNotNull(), F.col("jump") + F.col("d2")).otherwise(F.col("depth")).alias("depth"),
            F.when(need, F.col("jump") + F.coalesce("j2", F.lit(0))).otherwise(F.lit(0)).alias("jump"),
        )
        state = scratch.write(after, str(k))
        scratch.drop(str(k - 1))
        if state.where("v is null and up is not null").limit(1).count() == 0:
            break
    return state.select(node, F.col("v").alias(value), F.when(F.col("v").isNotNull(), F.col("depth")).alias("depth"))


def included(spark: SparkSession, edges: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """(root, document, path): every document a root includes, directly or not, once, at its first place in reading order.

    A document met again on the same path (a cycle) is skipped, so the rounds
    end by themselves at the longest way. ``path`` is the array of positions
    that leads to it, which sorts in reading order.
    """
    scratch = Scratch(spark, "include")
    step = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to"), F.col(order).cast("int").alias("_at"))
    front = scratch.write(edges.select(
        F.col(source).alias("root"), F.col(target).alias("document"), F.array(F.col(order).cast("int")).alias("path"), F.array(source, target).alias("_seen")
    ).where(F.col(source) != F.col(target)), "d0")
    found = [front]
    for k in itertools.count(1):
        nxt = front.join(step, front["document"] == step["_from"]).where(~F.array_contains("_seen", F.col("_to"))).select(
            "root", F.col("_to").alias("document"), F.concat("path", F.array("_at")).alias("path"), F.concat("_seen", F.array("_to")).alias("_seen")
        )
        # of several ways to one document at one depth the first in order is kept, so rows stay at most roots times documents
        front = scratch.write(nxt.groupBy("root", "document").agg(F.min(F.struct("path", "_seen")).alias("m")).select("root", "document", "m.path", "m._seen"), f"d{k}")
        if front.limit(1).count() == 0:
            break
        found.append(front)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("root", "document").agg(F.min("path").alias("path"))


def effective(includes: DataFrame, facts: DataFrame, document: str, key: str, value: str, order: str, first: bool) -> DataFrame:
    """(root, key, value): facts of all included documents in reading order; the first or the last declaration wins."""
    at = F.struct(F.col("path"), F.col(order))
    pick = F.min_by if first else F.max_by
    return includes.join(facts.withColumnRenamed(document, "document"), "document").groupBy("root", key).agg(pick(value, at).alias(value))


def unique_match(df: DataFrame, key: str, path: str, index: DataFrame, index_path: str) -> DataFrame:
    """Case-blind path join that needs exactly one match: matched path, and state matched, ambiguous or missing."""
    names = index.groupBy(F.lower(index_path).alias("_k")).agg(F.count("*").alias("_n"), F.min(index_path).alias("_p"))
    joined = df.withColumn("_k", F.lower(path)).join(names, "_k", "left")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("matched")
    return joined.select(*df.columns, F.when(F.col("_n") == 1, F.col("_p")).alias("matched_path"), state.alias("match_state"))


def idle_references(sequences: DataFrame, identity: str, action: str, key: str, target: str, reference_action: str = "idle") -> DataFrame:
    """Every sequence with its identity's reference row, the relation between the two, and the reason if it can't be used."""
    refs = sequences.where(F.col(action) == reference_action).groupBy(identity).agg(
        F.count_distinct(key).alias("_n"), F.min_by(F.struct(F.col(key).alias("k"), F.col(target).alias("t")), key).alias("_r"))
    joined = lookup_join(sequences, refs, identity, "left")
    reason = F.when(F.col("_n").isNull(), "no_reference").when(F.col("_n") > 1, "several_references").otherwise("")
    relation = F.when(F.col("_r.k") == F.col(key), "same_sequence").when(F.col("_r.t").eqNullSafe(F.col(target)), "same_target").otherwise("cross_sequence")
    return joined.select(key, identity, action, F.when(reason == "", F.col("_r.k")).alias("reference"), F.when(reason == "", relation).alias("relation"), reason.alias("reason"))


def rotation_families(df: DataFrame, family: str, frame: str, rotation: str, mirrored: str, wanted: int = 8) -> DataFrame:
    """Per family and frame: direct and mirrored rotations, those missing, and the kind all_views, directional, mixed or incomplete."""
    per = df.groupBy(family, frame).agg(
        F.array_sort(F.collect_set(rotation)).alias("_have"), F.count_if(~F.col(mirrored)).alias("n_direct"), F.count_if(F.col(mirrored)).alias("n_mirrored"))
    every = F.sequence(F.lit(1), F.lit(wanted))
    missing = F.array_except(every, F.col("_have"))
    has_all = F.array_contains("_have", F.lit(0))
    sided = F.size(F.array_intersect("_have", every))
    kind = (
        F.when(has_all & (sided > 0), "mixed").when(has_all, "all_views").when(F.size(missing) == 0, "directional").otherwise("incomplete"))
    return per.select(family, frame, "n_direct", "n_mirrored", F.array_join(F.transform(F.when(has_all & (sided == 0), F.array().cast("array<int>")).otherwise(missing), lambda x: x.cast("string")), "|").alias("missing"), kind.alias("kind"))


def calibrated(df: DataFrame, parameter: str, ranking: list[Column], *metrics: str) -> DataFrame:
    """(parameter, mean metrics, chosen): unweighted means per parameter value; the least by the ranking of means is chosen."""
    means = df.groupBy(parameter).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_samples"))
    best = means.agg(F.min_by(parameter, F.struct(*ranking, F.col(parameter))).alias("_best"))
    return means.join(best, means[parameter].eqNullSafe(best["_best"]), "left").select(parameter, *metrics, "n_samples", F.col("_best").isNotNull().alias("chosen"))


def reused(pending: DataFrame, done: DataFrame, digest: str, key: str, result: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reused, still open, conflicting donors): results copied to pending rows from finished rows of equal input."""
    donors = done.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count_distinct(result).alias("_n"), F.min_by(F.struct(F.col(key).alias("donor"), F.col(result).alias("r")), key).alias("_d"))
    good = donors.where("_n = 1")
    hit = pending.join(good, digest).select(key, digest, F.col("_d.donor").alias("donor"), F.col("_d.r").alias(result))
    return hit, pending.join(good.select(digest), digest, "left_anti"), donors.where("_n > 1").select(digest, F.col("_n").alias("n_results"))


def eligible_frames(df: DataFrame, status: str, passed: str, confirmed: str, ambiguous: str) -> DataFrame:
    """Frames of a clip that may be used: all, none, or where it is mixed those that pass and are confirmed and not ambiguous."""
    n = F.sequence(F.lit(0), F.lit(7))
    none = F.array().cast("array<int>")
    mixed = F.array_sort(F.array_except(F.array_intersect(passed, confirmed), F.coalesce(ambiguous, none)))
    return df.withColumn("eligible", F.when(F.col(status) == "all_pass", n).when(F.col(status) == "all_fail", none).otherwise(F.coalesce(mixed, none)))


def world_view(extents: DataFrame, group: str, target: int) -> DataFrame:
    """Per group the union of the extents and the whole scale at which it fits a target side; 0 where it can't."""
    box = extents.groupBy(group).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    side = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    return box.withColumn("scale", F.when(side > 0, F.floor(F.lit(target) / side)).otherwise(0))


def smallest_bucket(width: Column, height: Column, buckets: list[tuple[int, int]]) -> Column:
    """The smallest bucket that holds a frame without shrinking it, as "WxH"; null if none does."""
    out = F.lit(None).cast("string")
    for w, h in sorted(buckets, key=lambda b: (-b[0] * b[1], b)):
        out = F.when((width <= w) & (height <= h), F.lit(f"{w}x{h}")).otherwise(out)
    return out


def aligned_reports(reports: list[DataFrame], position: str, same: list[str], metric: str) -> DataFrame:
    """k reports side by side by position; rows whose ``same`` columns differ are flagged, not compared."""
    out = None
    for i, r in enumerate(reports):
        part = r.select(position, F.struct(*same).alias(f"_s{i}"), F.col(metric).alias(f"{metric}_{i}"))
        out = part if out is None else out.join(part, position, "full_outer")
    agree = F.lit(True)
    for i in range(1, len(reports)):
        agree = agree & F.col("_s0").eqNullSafe(F.col(f"_s{i}"))
    return out.select(position, *[f"{metric}_{i}" for i in range(len(reports))], agree.alias("comparable"))


def anchored_palette(df: DataFrame, group: str, rgb: tuple[str, str, str], weight: str, anchors: dict[str, tuple[int, int, int]]) -> DataFrame:
    """(group, colour, n, share, rank): pixels by their nearest named colour, most frequent first."""
    away = lambda a: sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(rgb, a)), F.lit(0))
    nearest = F.array_min(F.array(*[F.struct(away(a).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, a) in enumerate(anchors.items())]))["n"]
    counts = df.groupBy(group, nearest.alias("colour")).agg(F.sum(weight).alias("n"))
    w = Window.partitionBy(group)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "colour")))


CAPTION = "struct<identity:string,appearance:array<string>,palette:array<string>,equipment:array<string>,uncertain:array<string>>"
# Words a captioner writes for nothing.
EMPTY_PHRASES = ("none", "unknown", "n/a", "not visible", "null")


def parsed_caption(text: Column) -> Column:
    """A structured caption from JSON text, code fence stripped; phrases trimmed, deduplicated, empty ones dropped; null if malformed."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    c = F.from_json(bare, CAPTION, {"mode": "PERMISSIVE"})
    tidy = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: ~x.isin("", *EMPTY_PHRASES)))
    good = F.try_parse_json(bare).isNotNull() & c["identity"].isNotNull()
    return F.when(good, F.struct(F.trim(c["identity"]).alias("identity"), *[tidy(c[k]).alias(k) for k in ("appearance", "palette", "equipment", "uncertain")]))


def motion_ticks(df: DataFrame, key: str, ordinal: str, ticks: str) -> DataFrame:
    """Per animation: elements, ticks in all, whether it holds its last element for ever (-1), and its weight (each at least one tick)."""
    return df.groupBy(key).agg(
        F.count("*").alias("n_elements"), F.sum(F.when(F.col(ticks) > 0, F.col(ticks)).otherwise(0)).alias("total_ticks"),
        (F.max_by(ticks, ordinal) == -1).alias("holds"), F.sum(F.greatest(F.col(ticks), F.lit(1))).alias("weight"))


_ANIMATION = "file string, action int, ordinal int, kind string, image_group int, image int, x int, y int, ticks int, flip string, loop_start boolean, note string"


def _parse_animation(text: str) -> list[tuple]:
    rows, action, k, loop = [], None, 0, False
    for number, raw in enumerate((text or "").splitlines(), 1):
        line = raw.split(";", 1)[0].strip()
        low = line.lower()
        if not line:
            continue
        if m := re.match(r"\[begin action\s+(\d+)\s*\]", low):
            action, k, loop = int(m[1]), 0, False
        elif low == "loopstart":
            loop = True
        elif action is not None and line[0] in "-0123456789":
            parts = [p.strip() for p in line.split(",")]
            try:
                g, i, x, y, t = (int(p) for p in parts[:5])
                rows.append((action, k, "element", g, i, x, y, t, parts[5] if len(parts) > 5 else "", loop, ""))
                k, loop = k + 1, False
            except ValueError:
                rows.append((action, k, "excluded", 0, 0, 0, 0, 0, "", False, f"line {number}"))
    return rows


def animation_rows(df: DataFrame, file: str, text: str) -> DataFrame:
    """Elements of line-oriented animation files; malformed lines become rows of kind "excluded", not failures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ANIMATION.split(", ")]
        for b in batches:
            yield pd.DataFrame([(f, *r) for f, t in zip(b["file"], b["text"]) for r in _parse_animation(t)], columns=names)

    return df.select(F.col(file).alias("file"), F.col(text).alias("text")).mapInPandas(run, _ANIMATION)


def first_of_slots(df: DataFrame, group: str, number: str, slots: dict[str, list[int]]) -> DataFrame:
    """(group, slot, number): per slot the first number of its preference list that the group has."""
    wanted = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(n).alias("n"), F.lit(r).alias("r")) for s, ns in slots.items() for r, n in enumerate(ns)]))
    offers = df.select(group, number).distinct().withColumn("w", wanted).where(F.col("w.n") == F.col(number)).select(group, F.col("w.slot").alias("slot"), F.col("w.r").alias("r"), number)
    return offers.groupBy(group, "slot").agg(F.min_by(number, "r").alias(number))


def alias_groups(df: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, first_member, n_members) of the keys that share a value (an array counts as a value) with another key.

    One row per key, so a group of any size is gathered nowhere.
    """
    rows = df.select(F.col(key), F.xxhash64(value).alias("_h"), value.alias("_v")).distinct()
    groups = rows.groupBy("_h", "_v").agg(F.min(key).alias("first_member"), F.count("*").alias("n_members")).where("n_members > 1")
    counts = groups.groupBy("_h").agg(F.sum("n_members").alias("n"))
    hot = hottest(counts, "_h", counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    # equal hashes of different values are kept apart by the value itself
    packed = groups.groupBy("_h").agg(F.collect_list(F.struct("_v", "first_member", "n_members")).alias("_g"))
    met = lookup_join(rows, packed, "_h", hot=hot).select(key, "_v", F.explode("_g").alias("_g")).where(F.col("_v").eqNullSafe(F.col("_g._v")))
    return met.select(key, F.col("_g.first_member").alias("first_member"), F.col("_g.n_members").alias("n_members"))
