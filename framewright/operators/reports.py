"""Counts, distributions, rights states and coverage over a provenance index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ranks import running_sum
from framewright.operators.skew import hottest, lookup_join, union_all


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), one line per table, empty tables included."""
    return union_all([df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()])


def distribution(df: DataFrame, key: Column, name: str, missing: str = "none") -> DataFrame:
    """(dimension, value, n_rows) of one key; null is its own value."""
    return df.groupBy(F.coalesce(key.cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("dimension"), "value", "n_rows"
    )


def child_totals(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Parents with one total per child table, 0 where a parent has none.

    Each child is aggregated by the key before it is joined, so several
    children never multiply each other's rows.
    """
    sums = [df.groupBy(key).agg(agg.alias(name)) for name, (df, agg) in children.items()]
    joined = reduce(lambda a, b: a.join(b, key, "left"), sums, parents)
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in children})


def rights_states(items: DataFrame, observations: DataFrame, key: str, label: str) -> DataFrame:
    """Per item: observations, distinct known labels and the state they add up to.

    none (nothing observed), unknown (only unknown labels), conflicting (more
    than one label), partial (one label beside unknown ones), known.
    """
    per = observations.groupBy(key).agg(
        F.count("*").alias("n_observations"),
        F.array_sort(F.collect_set(label)).alias("_labels"),  # null labels aren't collected
        F.count_if(F.col(label).isNull()).alias("n_unknown"),
    )
    joined = items.select(key).distinct().join(per, key, "left")
    n = F.coalesce(F.size("_labels"), F.lit(0))
    state = (
        F.when(F.col("n_observations").isNull(), "none")
        .when(n == 0, "unknown")
        .when(n > 1, "conflicting")
        .when(F.col("n_unknown") > 0, "partial")
        .otherwise("known")
    )
    return joined.select(
        key,
        F.coalesce("n_observations", F.lit(0)).alias("n_observations"),
        F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
        F.coalesce(F.array_join("_labels", "|"), F.lit("")).alias("labels"),
        state.alias("rights_state"),
    )


def coverage(df: DataFrame, split: str, dimensions: list[str]) -> DataFrame:
    """(split, dimension, value, n_rows): counts per value, per split and overall ("all"), in one grouping."""
    stacked = df.select(
        F.coalesce(F.col(split), F.lit("none")).alias("split"),
        F.explode(F.array(*[
            F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("none")).alias("value")) for d in dimensions
        ])).alias("d"),
    ).select("split", "d.dimension", "d.value")
    return stacked.groupingSets(
        [[F.col("dimension"), F.col("value")], [F.col("split"), F.col("dimension"), F.col("value")]], "split", "dimension", "value"
    ).agg(F.count("*").alias("n_rows"), F.grouping("split").alias("_g")).select(
        F.when(F.col("_g") == 1, "all").otherwise(F.col("split")).alias("split"), "dimension", "value", "n_rows"
    )


def ratio_rollup(df: DataFrame, keys: list[str], numerator: Column, denominator: Column) -> DataFrame:
    """Ratio of sums for every combination of the keys ("*" stands for all values); 0 where nothing is to be divided."""
    cube = df.cube(*keys).agg(
        F.sum(numerator).alias("numerator"), F.sum(denominator).alias("denominator"),
        *[F.grouping(k).alias(f"_{k}") for k in keys],
    )
    return cube.select(
        *[F.when(F.col(f"_{k}") == 1, "*").otherwise(F.coalesce(F.col(k).cast("string"), F.lit("none"))).alias(k) for k in keys],
        "numerator", "denominator",
        F.when(F.col("denominator") == 0, 0.0).otherwise(F.col("numerator") / F.col("denominator")).alias("ratio"),
    )


def split_overlaps(df: DataFrame, value: str, split: str) -> DataFrame:
    """(value, splits, n_rows): values that occur in more than one split, splits sorted and joined."""
    return (
        df.where(F.col(value).isNotNull() & F.col(split).isNotNull())
        .groupBy(value)
        .agg(F.array_sort(F.collect_set(split)).alias("_s"), F.count("*").alias("n_rows"))
        .where(F.size("_s") > 1)
        .select(value, F.array_join("_s", "|").alias("splits"), "n_rows")
    )


def duplicate_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: groups of equal values with more than one row, their rows, and the rows beyond the first."""
    groups = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    repeated = F.col("n") > 1
    return groups.agg(
        F.count("*").alias("n_values"),
        F.count_if(repeated).alias("n_duplicate_groups"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("n_duplicate_rows"),
        F.coalesce(F.sum(F.when(repeated, F.col("n") - 1)), F.lit(0)).alias("n_excess_rows"),
    )


def nearest_rank(df: DataFrame, group: str, value: str, fractions: dict[str, tuple[int, int]]) -> DataFrame:
    """Per group: least and greatest value and lower nearest-rank quantiles, the entry at floor((n - 1) * a / b).

    Equal values are counted first, and their running counts are summed over
    ranges, so a few groups of any size are spread over all tasks.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    placed = running_sum(spark, counts, [group], [value], "_c", "_end")
    sizes = counts.groupBy(group).agg(F.sum("_c").alias("_n"))
    ranked = placed.join(sizes, placed[group].eqNullSafe(sizes[group])).select(placed[group], placed[value], "_c", "_end", "_n")
    at = lambda a, b: F.expr(f"((_n - 1) * {a}) div {b}")
    return ranked.groupBy(group).agg(
        F.max("_n").alias("n_rows"), F.min(value).alias("least"),
        *[
            F.max(F.when((F.col("_end") > at(a, b)) & (F.col("_end") - F.col("_c") <= at(a, b)), F.col(value))).alias(name)
            for name, (a, b) in fractions.items()
        ],
        F.max(value).alias("greatest"),
    )


def multi_label_groups(df: DataFrame, group: str, label: str, member: str, least: int) -> DataFrame:
    """(group, label, member, n_labels): the distinct members of groups with at least ``least`` distinct labels, one row each."""
    rows = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).select(group, label, member).distinct()
    labels = rows.groupBy(group, label).agg(F.count("*").alias("_c")).groupBy(group).agg(F.count("*").alias("n_labels"), F.sum("_c").alias("n")).where(F.col("n_labels") >= least)
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return lookup_join(rows, labels.select(group, "n_labels"), group, hot=hottest(labels, group, total))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n_rows, share_of_actual) of two label columns."""
    return (
        df.groupBy(actual, predicted)
        .agg(F.count("*").alias("n_rows"))
        .withColumn("share_of_actual", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(actual)))
    )
