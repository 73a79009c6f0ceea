"""Aliased actions, coordinate evidence in documents, shape checks, paired distances, pixel audits and version pointers."""

from __future__ import annotations

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.session import Scratch

# Keys of a document that hold the place of a frame in a sheet, and sets of keys that together do.
PLACE_KEYS = frozenset(
    "bbox bbox_json cell_bbox cell_rect crop crop_box frame_rect sheet_coordinates sheet_rect source_bbox source_rect uv_rect "
    "cell cells cell_coordinates coordinates frame_cell frame_cells".split()
)
PLACE_ENDINGS, PLACE_QUESTIONS = ("_bbox", "_crop", "_rect"), ("has_", "is_", "within_")
PLACE_SETS = ({"x", "y", "width", "height"}, {"x", "y", "w", "h"}, {"left", "top", "right", "bottom"})


def _is_place(key: str) -> bool:
    return key in PLACE_KEYS or "uv_rect" in key or (key.endswith(PLACE_ENDINGS) and not key.startswith(PLACE_QUESTIONS))


def place_in(value: object, path: str = "$") -> str | None:
    """Path of the first sheet coordinates in a nested value: keys in order at each level, then the entries one by one."""
    stack = [(value, path)]
    while stack:
        here, at = stack.pop()
        if isinstance(here, dict):
            names = {str(k).casefold(): k for k in here}
            named = [names[n] for n in sorted(names) if _is_place(n) and here[names[n]] is not None]
            if named:
                return f"{at}.{named[0]}"
            if any(s <= names.keys() for s in PLACE_SETS):
                return at
            stack += [(v, f"{at}.{k}") for k, v in reversed(here.items())]
        elif isinstance(here, list):
            stack += [(v, f"{at}[{i}]") for i, v in reversed(list(enumerate(here)))]
    return None


@F.pandas_udf(T.StringType())
def sheet_place(documents: pd.Series) -> pd.Series:
    """Path of the first sheet coordinates in a JSON document; null where it has none, is null or broken."""

    def of(text: str | None) -> str | None:
        try:
            return place_in(json.loads(text)) if text else None
        except (ValueError, RecursionError):
            return None

    return documents.map(of)


def aliased_actions(df: DataFrame, manifest: str, order: str, name: str, target: str, flips: str, frames: str) -> DataFrame:
    """Declared actions with what they show: their own frames, or those of the action they alias, mirrored as often as the way there says.

    An alias means the last declaration of its target before it in the same
    manifest; a target not declared before quarantines it and all that alias
    it. Ways are followed by doubling pointers, so a chain of any length takes
    the logarithm of its length in rounds; as every step goes back in order
    there are no cycles. Orders are unique in a manifest.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "aliases")
    along = Window.partitionBy(manifest, "_name").orderBy(order, F.desc("_asks"))
    told = df.select(manifest, order, F.col(name).alias("_name"), F.lit(False).alias("_asks"), F.col(order).alias("_declared"))
    asks = df.where(F.col(target).isNotNull()).select(manifest, order, F.col(target).alias("_name"), F.lit(True).alias("_asks"), F.lit(None).cast(df.schema[order].dataType).alias("_declared"))
    # the declaration of the target that stands last before the alias; a line asks before it declares its own name
    before = told.unionByName(asks).withColumn("_up", F.last("_declared", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    found = before.where("_asks").select(manifest, order, "_up")
    state = df.select(manifest, order, name, target, flips, frames).join(found, [manifest, order], "left").select(
        manifest, order, name, "_up", F.when(F.col(target).isNotNull() & F.col("_up").isNull(), "target_not_declared").otherwise("").alias("fault"),
        F.when(F.col(target).isNotNull(), F.coalesce(flips, F.lit(0))).otherwise(0).alias("flips"), F.when(F.col(target).isNull(), F.col(frames)).alias("shown"))
    state = scratch.write(state, "0")
    for k in range(1, 64):
        of = state.select(manifest, F.col(order).alias("_up"), F.col("_up").alias("_up2"), F.col("flips").alias("_f2"), F.col("shown").alias("_s2"), F.col("fault").alias("_fault2"))
        after = state.join(of, [manifest, "_up"], "left").select(
            manifest, order, name, F.col("_up2").alias("_up"),
            F.when((F.col("fault") == "") & (F.coalesce("_fault2", F.lit("")) != ""), "target_quarantined").otherwise(F.col("fault")).alias("fault"),
            (F.col("flips") + F.coalesce("_f2", F.lit(0))).alias("flips"), F.coalesce("shown", "_s2").alias("shown"))
        state = scratch.write(after, str(k))
        scratch.drop(str(k - 1))
        if state.where("_up is not null").isEmpty():
            break
    good = F.col("fault") == ""
    return state.select(manifest, order, name, F.when(good, F.col("shown")).alias("shown"), F.when(good, F.col("flips") % 2 == 1).otherwise(False).alias("mirrored"), "fault")


def shape_checks(df: DataFrame, group: str, shape: Column) -> DataFrame:
    """(group, n_rows, n_shapes, can_stack): rows of a group can be stacked when they all have one known shape."""
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), F.count_distinct(shape).alias("n_shapes"), F.count_if(shape.isNull()).alias("_none")).select(
        group, "n_rows", "n_shapes", ((F.col("n_shapes") == 1) & (F.col("_none") == 0)).alias("can_stack"))


def paired_metrics(predicted: tuple[Column, Column], swapped: tuple[Column, Column], target: tuple[Column, Column]) -> dict[str, Column]:
    """Of two actions: how far apart they are against their targets, how often each is nearer its own target, whether swapping moves it to the other, and by what margin."""

    def away(a: Column, b: Column) -> Column:
        gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
        return F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x), F.size(gaps))

    wanted, made = away(target[0], target[1]), away(predicted[0], predicted[1])
    right = [away(predicted[i], target[i]) for i in (0, 1)]
    wrong = [away(predicted[i], target[1 - i]) for i in (0, 1)]
    moved = [away(swapped[i], target[1 - i]) for i in (0, 1)]
    mean = lambda a, b: (a.cast("double") + b.cast("double")) / 2
    return {
        "target_distance": wanted, "generated_distance": made, "separation_ratio": made / F.greatest(wanted, F.lit(1e-8)),
        "preference_rate": mean(right[0] < wrong[0], right[1] < wrong[1]), "swap_rate": mean(moved[0] < wrong[0], moved[1] < wrong[1]),
        "margin": mean(wrong[0] - right[0], wrong[1] - right[1]),
    }


def pixel_quality(statistics: DataFrame, owner: DataFrame, key: str, group: str) -> DataFrame:
    """(group, reason, n_frames): frames by what is wrong with their pixels, or sound; a frame may have several reasons."""
    from framewright.operators.selection import reasons

    why = reasons((F.col("n_visible") == 0, "blank"), (F.col("n_border") >= 20, "touches_border"), (F.col("n_sentinel") > 0, "sentinel_colour"), (F.col("n_colours") > 16, "many_colours"))
    marked = statistics.join(owner.select(F.col(key).alias("frame_id"), group), "frame_id").select(group, F.when(F.size(why) == 0, F.array(F.lit("sound"))).otherwise(why).alias("why"))
    return marked.select(group, F.explode("why").alias("reason")).groupBy(group, "reason").agg(F.count("*").alias("n_frames"))


def write_together(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Write several tables as one version, then point to it: readers see all of them or none.

    The pointer is one small file of a mounted folder, replaced whole; a version
    that exists is refused, and one whose tables weren't all written is never
    pointed to.
    """
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}.parquet")
    os.makedirs(root, exist_ok=True)
    descriptor, path = tempfile.mkstemp(dir=root, prefix=".current-")
    with os.fdopen(descriptor, "w") as f:
        json.dump({"version": version, "tables": sorted(tables)}, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path, f"{root}/current.json")
    return f"{root}/{version}"


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the version that the pointer names: one consistent state, whatever is being written beside it."""
    with open(f"{root}/current.json") as f:
        held = json.load(f)
    if table not in held["tables"]:
        raise KeyError(table)
    return spark.read.parquet(f"{root}/{held['version']}/{table}.parquet")
