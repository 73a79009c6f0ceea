"""p5: samples whose categories have target shares, with unmet quota passed through the category tree."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions.keys import letters_and_digits
from framewright.llm.canonical import canonical_verbs
from framewright.operators.ranks import distributed_rank
from framewright.session import Scratch, load

#: The driver allocates over the rows of the target list; a list beyond this bound is refused.
MOST_TARGETS = 100_000


def supply_rows(spark: SparkSession, motions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(canonical, identity, sequence_id): one row per canonical verb and present identity.

    Of the rows of one identity and verb the smallest ``sequence_id`` stands.
    """
    named = canonical_verbs(
        spark,
        motions.select("sequence_id", letters_and_digits(F.col("identity_id")).alias("identity"), "verb").where("identity is not null"),
        "verb",
        vocabulary,
    )
    return (
        named.where(F.col("canonical").isNotNull())
        .groupBy("canonical", "identity")
        .agg(F.min("sequence_id").alias("sequence_id"))
    )


def quota_report(supply: DataFrame, targets: DataFrame) -> DataFrame:
    """Per config and verb: supply, sample size, wanted rows and whether the target can't be met."""
    counts = supply.groupBy("canonical").agg(F.count("*").alias("supply"))
    joined = targets.join(counts, targets["verb"] == counts["canonical"], "left").withColumn(
        "supply", F.coalesce("supply", F.lit(0).cast("bigint"))
    )
    over = Window.partitionBy("config_name")  # one row per verb of a config
    return (
        joined.withColumn("sample_size", F.floor(F.col("sample_share") * F.sum("supply").over(over)))
        .withColumn("wanted", F.col("target_share") * F.col("sample_size"))
        .withColumn("unmet", (F.col("supply") < F.col("wanted")) | (F.col("supply") < F.col("minimum_rows")))
        .select("config_name", "verb", "target_share", "minimum_rows", "supply", "sample_size", "wanted", "unmet")
    )


def whole_parts(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in proportion to the weights that add up to total, by largest remainder, ties by name."""
    mass = sum(weights.values())
    if total <= 0 or mass <= 0:
        return {k: 0 for k in weights}
    exact = {k: total * w / mass for k, w in weights.items()}
    parts = {k: math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (parts[k] - exact[k], k))[: total - sum(parts.values())]:
        parts[k] += 1
    return parts


def allocate(rows: list[dict]) -> dict[str, int]:
    """Quota per verb of one config, top down over family and verb.

    Each verb asks for its share of the sample size, at least its minimum, and
    gets at most its supply. What it can't give is passed to its siblings (the
    verbs of its family), what the family can't give to its cousins (all other
    verbs), each time in proportion to what they can still give.
    """
    size = rows[0]["sample_size"]
    supply = {r["verb"]: r["supply"] for r in rows}
    family = {r["verb"]: r["family"] for r in rows}
    asked = whole_parts(size, {r["verb"]: r["target_share"] for r in rows})
    quota = {r["verb"]: min(supply[r["verb"]], max(asked[r["verb"]], r["minimum_rows"])) for r in rows}
    open_by_family: dict[str, int] = {}
    for verb, want in asked.items():
        open_by_family[family[verb]] = open_by_family.get(family[verb], 0) + max(0, want - quota[verb])
    left = 0
    for name, missing in sorted(open_by_family.items()):
        room = {v: supply[v] - quota[v] for v in quota if family[v] == name}
        given = whole_parts(min(missing, sum(room.values())), {v: float(x) for v, x in room.items()})
        for v, x in given.items():
            quota[v] += min(x, room[v])
        left += missing - sum(min(x, room[v]) for v, x in given.items())
    excess = max(0, sum(quota.values()) + left - size)  # minima may have used more than the sample size
    left = max(0, left - excess)
    room = {v: supply[v] - quota[v] for v in quota}
    given = whole_parts(min(left, sum(room.values())), {v: float(x) for v, x in room.items()})
    for v, x in given.items():
        quota[v] += min(x, room[v])
    return quota


def _report(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    supply = Scratch(spark, "balanced").write(
        supply_rows(spark, load(spark, root, "latent_motion_training_rows"), load(spark, root, "action_vocabulary")), "supply"
    )
    return supply, quota_report(supply, load(spark, root, "balanced_corpus_targets"))


def balanced_sample(spark: SparkSession, supply: DataFrame, report: DataFrame, vocabulary: DataFrame, seed: str = "sample") -> tuple[DataFrame, DataFrame]:
    """(sample, quotas): the drawn rows per config, and per config and verb what was wanted and drawn.

    Identities stand in a hashed order per verb (a permuted dense rank); the
    first ones up to the quota are drawn, so a larger quota only adds rows.
    """
    families = vocabulary.select(F.col("canonical_action").alias("verb"), F.col("action_family").alias("family"))
    held = report.join(families, "verb", "left").limit(MOST_TARGETS + 1).collect()
    if len(held) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target rows")
    by_config: dict[str, list[dict]] = {}
    for r in held:
        by_config.setdefault(r["config_name"], []).append(r.asDict() | {"family": r["family"] or ""})
    rows = [
        (name, r["verb"], int(quota[r["verb"]]), r["supply"], r["sample_size"], float(r["wanted"]), r["unmet"])
        for name, group in sorted(by_config.items())
        for quota in [allocate(sorted(group, key=lambda r: r["verb"]))]
        for r in group
    ]
    quotas = spark.createDataFrame(
        rows, "config_name string, verb string, quota bigint, supply bigint, sample_size bigint, wanted double, unmet boolean"
    )
    ranked = distributed_rank(
        spark, supply.withColumn("_permuted", F.xxhash64(F.lit(seed), "canonical", "identity")), ["canonical"], ["_permuted", "identity"]
    )
    most = quotas.groupBy("verb").agg(F.collect_list(F.struct("config_name", "quota")).alias("asked"))
    drawn = ranked.join(F.broadcast(most), ranked["canonical"] == most["verb"])  # at most MOST_TARGETS rows
    sample = drawn.select(F.explode("asked").alias("a"), "verb", "identity", "sequence_id", "rank").where("rank <= a.quota")
    return sample.select(F.col("a.config_name").alias("config_name"), "verb", "identity", "sequence_id"), quotas


def _drawn(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    supply, report = _report(spark, root)
    return balanced_sample(spark, supply, report, load(spark, root, "action_vocabulary"))


def p5_sample(spark: SparkSession, root: str) -> DataFrame:
    """The sampled rows of every config: one per identity and verb."""
    return _drawn(spark, root)[0]


def p5_shares(spark: SparkSession, root: str) -> DataFrame:
    """Per config and verb: wanted rows, quota, rows really drawn, supply, and whether the target can't be met."""
    sample, quotas = _drawn(spark, root)
    counts = sample.groupBy("config_name", "verb").agg(F.count("*").alias("drawn"))
    return quotas.join(counts, ["config_name", "verb"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint")))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Verbs of a config whose target share or minimum the draw can't meet."""
    return p5_shares(spark, root).where("unmet").select("config_name", "verb")


QUERIES = {"p5_found": p5_found, "p5_shares": p5_shares, "p5_sample": p5_sample}
ORACLES: dict[str, str] = {}
