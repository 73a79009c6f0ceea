"""Timelines of frames: phases, nearest-phase selection, retiming, folding and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_phases(n: Column, loop_mode: Column) -> Column:
    """Even phases of n frames: i/n for loops, i/(n-1) otherwise; one frame stands at 0, none gives an empty array."""
    steps = F.when(loop_mode == "loop", n).otherwise(F.greatest(n - 1, F.lit(1)))
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / steps)
    return F.when(n > 0, even).otherwise(F.array().cast("array<double>"))


def nearest_frames(phases: Column, targets: Column, loop_mode: Column) -> Column:
    """For every target phase the index of the nearest authored frame, ties to the lower index.

    Distance runs around the circle for loops; ping-pong targets are folded
    back from the second half. Nothing is interpolated.
    """
    goal = lambda t: F.when(loop_mode == "ping_pong", 1 - F.abs(1 - 2 * t)).otherwise(t)

    def away(p: Column, t: Column) -> Column:
        d = F.abs(p - goal(t))
        return F.round(F.when(loop_mode == "loop", F.least(d, 1 - d)).otherwise(d), 9)

    return F.transform(
        targets,
        lambda t: F.array_min(F.transform(phases, lambda p, i: F.struct(away(p, t).alias("away"), i.alias("at"))))["at"],
    )


def gathered(values: Column, ordinals: Column) -> Column:
    return F.transform(ordinals, lambda i: F.get(values, i))


def retimed(durations: Column, total: Column) -> Column:
    """Durations scaled to a total; the last takes what rounding leaves."""
    have = F.aggregate(durations, F.lit(0.0), lambda s, d: s + d)
    scaled = F.transform(durations, lambda d: F.round(d * total / have, 3))
    head = F.slice(scaled, F.lit(1), F.size(scaled) - 1)
    rest = F.round(total - F.aggregate(head, F.lit(0.0), lambda s, d: s + d), 3)
    return F.when((F.size(durations) > 0) & (have > 0), F.concat(head, F.array(rest)))


def tail_loop(phases: Column) -> Column:
    """Phases of the loop after its intro: the part from the first known phase on, null unless it starts at 0 and has no gap."""
    known = F.filter(F.transform(phases, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"].isNotNull())
    start = F.array_min(F.transform(known, lambda x: x["i"]))
    tail = F.slice(phases, start + 1, F.size(phases) - start)
    return F.when((F.get(tail, F.lit(0)) == 0) & F.forall(tail, lambda p: p.isNotNull()), tail)


def cumulative_phase(df: DataFrame, key: str, order: list[str], duration: str, loop: Column) -> DataFrame:
    """``df`` with the phase at which each frame starts: elapsed time over the total, or over the last start for one-shots."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = Window.partitionBy(key)
    timed = df.withColumn("_at", F.coalesce(F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    end = F.when(loop, F.sum(duration).over(whole)).otherwise(F.max("_at").over(whole))
    return timed.withColumn("phase", F.when(end > 0, F.col("_at") / end).otherwise(0.0)).drop("_at")


def folded(df: DataFrame, group: str, lane: str, order: list[str], duration: str) -> DataFrame:
    """Several lanes of timed frames brought to one timeline.

    Per group the distinct moments at which any lane changes; for every span
    between two of them the frame each lane shows (the last one stays on). An
    as-of join: moments and frame starts of a lane are merged in one sorted
    pass, no pair of a moment with every frame is formed.
    Durations are whole milliseconds. Columns: group, start_ms, span_ms, lane, frame_index.
    """
    w = Window.partitionBy(group, lane).orderBy(*order)
    starts = df.select(
        group, lane,
        (F.row_number().over(w) - 1).alias("frame_index"),
        F.coalesce(F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("start_ms"),
        F.sum(duration).over(w).cast("bigint").alias("end_ms"),
    )
    ends = starts.groupBy(group).agg(F.max("end_ms").alias("_end"))
    moments = starts.select(group, "start_ms").distinct()
    after = F.lead("start_ms").over(Window.partitionBy(group).orderBy("start_ms"))
    spans = moments.join(ends, group).select(group, "start_ms", (F.coalesce(after, F.col("_end")) - F.col("start_ms")).alias("span_ms")).where("span_ms > 0")
    lanes = starts.select(group, lane).distinct()
    grid = spans.join(lanes, group)
    marked = grid.join(starts.select(group, lane, "start_ms", "frame_index").groupBy(group, lane, "start_ms").agg(F.max("frame_index").alias("frame_index")), [group, lane, "start_ms"], "left")
    upto = Window.partitionBy(group, lane).orderBy("start_ms")
    return marked.withColumn("frame_index", F.last("frame_index", ignorenulls=True).over(upto)).select(group, "start_ms", "span_ms", lane, "frame_index")


def transitions(df: DataFrame, key: str, order: list[str], value: str, seam: bool = False) -> DataFrame:
    """(key, from_value, to_value) of neighbouring rows, and with ``seam`` from the last to the first."""
    w = Window.partitionBy(key).orderBy(*order)
    nxt = F.lead(value).over(w)
    if seam:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nxt = F.when(F.lead(F.lit(1)).over(w).isNull(), F.first(value).over(whole)).otherwise(nxt)
    return df.select(key, F.col(value).alias("from_value"), nxt.alias("to_value")).where("to_value is not null")


def grid_cells(
    df: DataFrame, width: str, height: str, cell: tuple[int, int], origin: tuple[int, int] = (0, 0), spacing: tuple[int, int] = (0, 0), grid: tuple[int, int] | None = None
) -> DataFrame:
    """Sheets cut into cells: status canonical (no remainder), oversize (no cell fits, or the wanted grid doesn't) or noncanonical, and one row per cell.

    Cells start at ``origin``, ``spacing`` apart; ``grid`` names their columns
    and rows, else as many are cut as fit. An oversize sheet has no cells.
    """
    (w, h), (x, y), (dx, dy) = cell, origin, spacing
    across, down = F.col(width) - x, F.col(height) - y
    if grid is None:
        columns, rows = F.floor((across + dx) / (w + dx)).cast("int"), F.floor((down + dy) / (h + dy)).cast("int")
    else:
        columns, rows = F.lit(grid[0]), F.lit(grid[1])
    shaped = df.withColumn("_c", columns).withColumn("_r", rows)
    rest_x, rest_y = across - (F.col("_c") * (w + dx) - dx), down - (F.col("_r") * (h + dy) - dy)
    fits = (F.col("_c") > 0) & (F.col("_r") > 0) & (rest_x >= 0) & (rest_y >= 0)
    status = F.when(~fits, "oversize").when((rest_x > 0) | (rest_y > 0), "noncanonical").otherwise("canonical")
    cells = F.when(fits, F.sequence(F.lit(0), F.col("_c") * F.col("_r") - 1))
    return shaped.withColumn("status", status).withColumn("cell", F.explode_outer(cells)).select(
        *df.columns, "status", "cell",
        (F.col("cell") % F.col("_c") * (w + dx) + x).alias("left"), (F.expr("cell div _c") * (h + dy) + y).alias("top"),
    )
