"""Training plans and audits: selections with reasons, equality-checked joins, inherited splits, journals and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.skew import hottest, lookup_join


def gated(df: DataFrame, verbs: list[str], verb: str, gate: str, required: str) -> tuple[DataFrame, DataFrame]:
    """(chosen rows, (reason, n_rows)): rows of the wanted verbs whose gate has the required status; every other row is counted under its first reason."""
    reason = (
        F.when(~F.coalesce(F.col(verb).isin(verbs), F.lit(False)), F.concat(F.lit("verb:"), F.coalesce(verb, F.lit("none"))))
        .when(~F.coalesce(F.col(gate) == required, F.lit(False)), F.concat(F.lit("pixel_gate:"), F.coalesce(gate, F.lit("none"))))
    )
    marked = df.withColumn("_reason", reason)
    return marked.where("_reason is null").drop("_reason"), marked.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n_rows"))


def crossing(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split: a plan must have none."""
    return df.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def same_subject(decision: dict[str, Column]) -> Column:
    """Whether a clip keeps its subject: seen in all frames, the same one, doing what it should, in a leading role, without a helper."""
    return F.coalesce(
        (decision["presence"] == "all_frames") & (decision["relation"] == "same_primary_subject") & decision["match"].isin("clear", "plausible")
        & decision["role"].isin("primary_subject_motion", "primary_subject_with_effects") & ~F.array_contains(F.coalesce(decision["secondary"], F.array().cast("array<string>")), "assist_subject"),
        F.lit(False))


def field_counters(df: DataFrame, fields: list[str], missing: str = "unresolved") -> DataFrame:
    """(field, value, n_rows) of several fields in one pass; null counts as ``missing``."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit(missing)).alias("value")) for f in fields])).alias("x"))
    return stacked.groupBy("x.field", "x.value").agg(F.count("*").alias("n_rows"))


def evidence_inventory(df: DataFrame, role: Column, path: Column) -> DataFrame:
    """(role, n_references, n_paths) of nested evidence brought to one row per reference."""
    return df.groupBy(role.alias("role")).agg(F.count("*").alias("n_references"), F.count_distinct(path).alias("n_paths"))


def worst_metrics(values: dict[str, Column], ratio: Column) -> list[Column]:
    """Least entry of each metric array, and the greatest distance of the ratios from one; null where an entry is missing."""
    whole = lambda a: F.forall(a, lambda x: x.isNotNull()) & (F.size(a) > 0)
    least = [F.when(whole(a), F.array_min(a)).alias(f"minimum_{n}") for n, a in values.items()]
    return [*least, F.when(whole(ratio), F.array_max(F.transform(ratio, lambda x: F.abs(x - 1.0)))).alias("maximum_occupancy_deviation")]


def frame_plan(df: DataFrame, key: str, parts: list[Column], frames: Column, most: int) -> DataFrame:
    """(key, frame, place): the ``most`` frames of least hash over all rows, so a choice is spread over actions and identities and never drifts."""
    every = df.select(key, *[p.alias(f"_p{i}") for i, p in enumerate(parts)], F.explode(F.when(frames > 0, F.sequence(F.lit(0), frames - 1))).alias("frame"))
    text = F.concat(*[x for i in range(len(parts)) for x in (F.col(f"_p{i}"), F.lit("\0"))], F.col(key), F.lit("\0"), F.col("frame").cast("string"))
    top = every.select(key, "frame", F.sha2(text, 256).alias("_h")).orderBy("_h").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_h"))).drop("_h")  # most rows


def first_distinct(df: DataFrame, group: str, order: list[str], digest: str, most: int) -> DataFrame:
    """Of each group the first ``most`` rows in order that differ in ``digest``, with their place."""
    first = df.groupBy(group, digest).agg(F.min(F.struct(*order)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_o"))
    return first.withColumn("place", place).where(F.col("place") <= most).select(group, digest, *[F.col(f"_o.{c}").alias(c) for c in order], "place")


def chosen_with_alternates(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """(keys, name, alternates): the row of least order per key, and how many others offered themselves."""
    return df.groupBy(*keys).agg(F.min_by(name, F.struct(*order)).alias(name), (F.count("*") - 1).alias("n_alternates"))


def matched_pairs(df: DataFrame, identity: str, action: str, digest: str, most: int) -> DataFrame:
    """(identity, first_action, second_action): of the first ``most`` identities in order the first pair of actions, in order, whose digests differ."""
    one = df.groupBy(identity, action).agg(F.min(digest).alias("_d"))  # one target per action
    a, b = one.select(identity, F.col(action).alias("first_action"), F.col("_d").alias("_a")), one.select(identity, F.col(action).alias("second_action"), F.col("_d").alias("_b"))
    pairs = a.join(b, identity).where((F.col("first_action") < F.col("second_action")) & (F.col("_a") != F.col("_b")))
    found = pairs.groupBy(identity).agg(F.min(F.struct("first_action", "second_action")).alias("p"))
    return found.select(identity, "p.first_action", "p.second_action").orderBy(identity).limit(most)


def agreed_join(left: DataFrame, right: DataFrame, key: str, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of a join on one key whose ``same`` fields must agree; keys on one side only and differing fields are faults."""
    a, b = left.withColumn("_l", F.lit(True)).alias("a"), right.withColumn("_r", F.lit(True)).alias("b")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in same]))
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").withColumn(
        "_fault", F.when(F.col("b._r").isNull(), "left_only").when(F.col("a._l").isNull(), "right_only").when(F.size(differ) > 0, F.concat(F.lit("differs:"), F.array_join(differ, ","))))
    rest = [F.col(f"b.{c}") for c in right.columns if c != key and c not in left.columns]
    rows = both.where("_fault is null").select(*[F.col(f"a.{c}") for c in left.columns], *rest)
    return rows, both.where("_fault is not null").groupBy(F.col("_fault").alias("fault")).agg(F.count("*").alias("n_keys"))


def group_agreement(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field the groups in which it has more than one value: all must be 0 for a plan by group."""
    per = df.groupBy(key).agg(*[F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))).alias(f) for f in fields])
    counted = per.agg(*[F.count_if(F.col(f) > 1).alias(f) for f in fields])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_groups")) for f in fields])).alias("x")).select("x.*")


def inherited_splits(part: DataFrame, whole: DataFrame, key: str, component: str, split: str) -> DataFrame:
    """``part`` with component and split of the whole it was drawn from: a subset never draws its own."""
    told = whole.groupBy(key).agg(F.min(component).alias(component), F.min(split).alias(split))
    counts = part.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return lookup_join(part, told, key, "left", hot=hottest(counts, key, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))


def pending(work: DataFrame, journal: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """(key, state): pending (not in the journal), done, or changed (journalled with other facts)."""
    a, j = work.alias("a"), journal.withColumn("_done", F.lit(True)).alias("j")
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"j.{f}"))
    state = F.when(F.col("j._done").isNull(), "pending").when(same, "done").otherwise("changed")
    return a.join(j, F.col(f"a.{key}") == F.col(f"j.{key}"), "left").select(F.col(f"a.{key}").alias(key), state.alias("state"))


def prompt_table(df: DataFrame, text: str) -> DataFrame:
    """(prompt, rows): the distinct trimmed prompts with the number of rows that ask for each; blank ones are left out."""
    bare = F.trim(text)
    return df.select(bare.alias("prompt")).where((bare != "") & bare.isNotNull()).groupBy("prompt").agg(F.count("*").alias("n_rows"))


def scoped_parents(df: DataFrame, name: str, parent: str, separator: str = ".") -> DataFrame:
    """(name, resolved, method) of a parent named without its scope: the innermost enclosing scope that has it, else the only class of that simple name."""
    parts = F.split(F.col(name), f"[{separator}]")
    known = df.select(F.col(name).alias("_full")).distinct()
    asked = df.where(F.col(parent).isNotNull()).select(name, parent).distinct()
    scopes = asked.select(name, parent, F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("_n")).select(
        name, parent, "_n", F.when(F.col("_n") == 0, F.col(parent)).otherwise(F.concat(F.array_join(F.slice(F.split(F.col(name), f"[{separator}]"), F.lit(1), F.col("_n")), separator), F.lit(separator), F.col(parent))).alias("_full"))
    inner = scopes.join(known, "_full").where(F.col("_full") != F.col(name)).groupBy(name, parent).agg(F.max_by("_full", "_n").alias("_inner"))
    simple = known.select(F.element_at(F.split("_full", f"[{separator}]"), -1).alias(parent), "_full").groupBy(parent).agg(F.count("*").alias("_c"), F.min("_full").alias("_only")).where("_c = 1")
    found = asked.join(inner, [name, parent], "left").join(simple, parent, "left")
    return found.select(
        name, parent, F.coalesce("_inner", "_only").alias("resolved"),
        F.when(F.col("_inner").isNotNull(), "scope").when(F.col("_only").isNotNull(), "unique_name").otherwise("unresolved").alias("method"))


def role_of(tokens: Column, rules: list[tuple[str, list[str]]], other: str) -> tuple[Column, Column]:
    """(role, basis): the first rule one of whose words is among the tokens, and that word; else ``other`` and no basis."""
    role, basis = F.lit(other), F.lit(None).cast("string")
    for name, words in reversed(rules):
        hits = F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]))  # in the order of the tokens
        role, basis = F.when(F.size(hits) > 0, name).otherwise(role), F.when(F.size(hits) > 0, F.get(hits, F.lit(0))).otherwise(basis)
    return role, basis


def loop_of_roles(roles: Column, looping: list[str], once: list[str]) -> Column:
    """Loop mode by the set of roles that use a sequence: loop, one_shot, role_dependent where both do, else unknown."""
    has = lambda names: F.arrays_overlap(roles, F.array(*[F.lit(n) for n in names]))
    both = F.coalesce(has(looping), F.lit(False)), F.coalesce(has(once), F.lit(False))
    return F.when(both[0] & both[1], "role_dependent").when(both[0], "loop").when(both[1], "one_shot").otherwise("unknown")
