"""Snapshot selection: candidates, source filters, temporal evidence, nested samples, priority joins and admission."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPORAL_MODES = ("known", "model_ready", "pose_only", "all")


@dataclass(frozen=True)
class Filters:
    """Validated selection options; names are trimmed, lower-cased, deduplicated and sorted."""

    minimum_frames: int = 1
    actions: tuple[str, ...] = ()
    temporal_mode: str = "all"
    include_sources: tuple[str, ...] = ()
    exclude_sources: tuple[str, ...] = ()
    seed: str = field(default="snapshot")

    def __post_init__(self):
        if self.minimum_frames < 1:
            raise ValueError("minimum_frames must be positive")
        if self.temporal_mode not in TEMPORAL_MODES:
            raise ValueError(f"unknown temporal mode {self.temporal_mode!r}")
        object.__setattr__(self, "actions", tuple(sorted({a.strip().casefold() for a in self.actions if a.strip()})))
        for name in ("include_sources", "exclude_sources"):
            object.__setattr__(self, name, tuple(sorted({s.strip() for s in getattr(self, name) if s.strip()})))
        if set(self.include_sources) & set(self.exclude_sources):
            raise ValueError("a source is both included and excluded")


def effective_action(*choices: Column) -> Column:
    """The first non-blank action, lower case, else unknown."""
    return F.lower(F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in choices], F.lit("unknown")))


def by_sources(df: DataFrame, key: str, associations: DataFrame, filters: Filters) -> DataFrame:
    """Keep rows associated with an included source and with no excluded one; exclusion wins.

    ``associations`` holds (key, source_id), several per key. With only
    exclusions a row without any source stays, with inclusions it goes.
    """
    if filters.include_sources:
        df = df.join(associations.where(F.col("source_id").isin(list(filters.include_sources))).select(key).distinct(), key, "left_semi")
    if filters.exclude_sources:
        df = df.join(associations.where(F.col("source_id").isin(list(filters.exclude_sources))).select(key).distinct(), key, "left_anti")
    return df


def timing_evidence(frames: DataFrame, key: str, ordinal: str, duration: str) -> DataFrame:
    """Per sequence: frame count, total duration, and whether ordinals are exactly 0..n-1 with every duration positive."""
    n = F.count("*")
    complete = (
        (F.min(ordinal) == 0) & (F.max(ordinal) == n - 1) & (F.count_distinct(ordinal) == n)
        & F.coalesce(F.bool_and(F.coalesce(F.col(duration) > 0, F.lit(False))), F.lit(False))
    )
    return frames.groupBy(key).agg(n.alias("n_frames"), F.sum(duration).alias("total_duration"), complete.alias("complete_timing"))


def negative_claims(document: Column, fields: list[str]) -> Column:
    """Names of the fields that a JSON document says are false, and only literally false; broken documents claim nothing."""
    parsed = F.try_parse_json(document)
    return F.array_compact(F.array(*[
        F.when(F.expr("false").eqNullSafe(F.try_variant_get(parsed, f"$.{f}", "boolean")), F.lit(f)) for f in fields
    ]))


def phases_ready(phases: Column, loop_mode: Column) -> Column:
    """Whether phases fit their loop mode: strictly increasing, loop in [0, 1), one-shot and ping-pong in [0, 1]; null, empty or unknown mode don't.

    An intro that turns into a loop has no phases in the intro, at least one
    frame long; from the first phase on, which is 0, they are those of a loop.
    """
    intro = loop_mode == "intro_then_loop"
    first = F.array_position(F.transform(phases, lambda p: p.isNotNull()), F.lit(True))
    tail = F.when(intro, F.slice(phases, F.greatest(first, F.lit(1)).cast("int"), F.size(phases))).otherwise(phases)
    rising = F.forall(
        F.zip_with(F.slice(tail, F.lit(1), F.size(tail) - 1), F.slice(tail, F.lit(2), F.greatest(F.size(tail) - 1, F.lit(0))), lambda a, b: a < b),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    inside = F.forall(tail, lambda p: F.coalesce((p >= 0) & F.when(loop_mode.isin("loop", "intro_then_loop"), p < 1).otherwise(p <= 1), F.lit(False)))
    known = loop_mode.isin("loop", "one_shot", "ping_pong") | (intro & (first > 1) & (F.get(tail, F.lit(0)) == 0.0))
    return F.coalesce(known & (F.size(phases) > 0) & rising & inside, F.lit(False))


def nested(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Parents with one sorted array of structs per child table, empty where a parent has none.

    Children are gathered by key first; joining them row by row would multiply
    one child with the next.
    """
    for name, (child, columns) in children.items():
        grouped = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        parents = parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return parents


def primary(df: DataFrame, key: str, rank: list[Column | str]) -> DataFrame:
    """The row of least rank of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def priority_join(df: DataFrame, key: str, candidates: list[tuple[Column, float, str]], lookup: DataFrame, name: str) -> DataFrame:
    """Join with fallbacks: the first candidate name, in order, that the lookup knows.

    ``candidates`` are (name, confidence, method) from best to worst; ``lookup``
    holds one row per ``name``. Rows no candidate resolves get method
    "unresolved" and confidence 0.
    """
    offers = df.select(key, F.posexplode(F.array(*[
        F.struct(c.alias("c"), F.lit(conf).alias("confidence"), F.lit(m).alias("method")) for c, conf, m in candidates
    ])).alias("_rank", "_o")).select(key, "_rank", F.col("_o.c").alias(name), "_o.confidence", "_o.method").where(F.col(name).isNotNull())
    best = primary(offers.join(lookup, name), key, ["_rank"]).drop("_rank")
    return df.join(best, key, "left").withColumns({
        "confidence": F.coalesce("confidence", F.lit(0.0)), "method": F.coalesce("method", F.lit("unresolved")),
    })


def longest_prefix(df: DataFrame, key: str, path: str, prefixes: DataFrame, name: str) -> DataFrame:
    """Join each path with its longest ancestor directory found among ``prefixes``."""
    parts = F.split(F.col(path), "/")
    ancestors = df.select(key, F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix")),
    )).alias("a")).select(key, "a.depth", F.col("a.prefix").alias(name))
    best = ancestors.join(prefixes.select(name).distinct(), name).groupBy(key).agg(F.max_by(name, "depth").alias(name))
    return df.join(best, key, "left")


def reasons(*tests: tuple[Column, str]) -> Column:
    """Ordered distinct names of the tests that hold; a test on nulls doesn't hold."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests])))


def admitted(df: DataFrame, tests: list[tuple[Column, str]], inherited: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with its exclusion reasons and whether it is admitted: every row is one or the other.

    ``inherited`` = (column of parent reasons, prefix) adds the parent's
    reasons with a prefix.
    """
    own = reasons(*tests)
    if inherited:
        column, prefix = inherited
        more = F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda r: F.concat(F.lit(prefix), r))
        own = F.array_distinct(F.concat(own, more))
    return df.withColumn("exclusion_reasons", own).withColumn("admitted", F.size("exclusion_reasons") == 0)
