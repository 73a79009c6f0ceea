"""Reproducible samples and subsets: probes, round robins, rectangles, contrasts and sampler weights."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.skew import hottest, lookup_join


def hash_order(domain: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(domain), F.lit(chr(0)), key.cast("string")), 256)


def probe(df: DataFrame, group: str, key: str, most: int, domain: str = "probe") -> DataFrame:
    """Up to ``most`` rows per group, first by hash; rank-limited before the shuffle."""
    order = Window.partitionBy(group).orderBy("_hash", key)
    return df.withColumn("_hash", hash_order(domain, F.col(key))).withColumn("probe_rank", F.row_number().over(order)).where(F.col("probe_rank") <= most).drop("_hash")


def round_robin(df: DataFrame, stratum: str, turn: Column, group: str | None, key: str, most: int, domain: str = "robin") -> DataFrame:
    """Up to ``most`` rows per group, taking the strata in turn: the hash-first of each, then the second of each, ...

    ``turn`` orders the strata within a round. Each stratum offers no more
    than ``most`` rows, so the second ranking sees a bounded number per group.
    """
    groups = [group] if group else []
    inner = Window.partitionBy(*groups, stratum).orderBy("_hash", key)
    offered = (
        df.withColumn("_hash", hash_order(domain, F.col(key)))
        .withColumn("_round", F.row_number().over(inner))
        .where(F.col("_round") <= most)
        .withColumn("_turn", turn)
    )
    outer = Window.partitionBy(*groups).orderBy("_round", "_turn", stratum, "_hash", key)
    return offered.withColumn("pick", F.row_number().over(outer)).where(F.col("pick") <= most).drop("_hash", "_round", "_turn")


def diverse(df: DataFrame, identity: str, key: str, most: int, domain: str = "diverse") -> DataFrame:
    """The first ``most`` rows when every identity gives its first row before any gives a second."""
    inner = Window.partitionBy(identity).orderBy("_hash", key)
    deep = df.withColumn("_hash", hash_order(domain, F.col(key))).withColumn("depth", F.row_number().over(inner)).where(F.col("depth") <= most)
    return deep.orderBy("depth", "_hash", key).limit(most).drop("_hash")


def having_all(df: DataFrame, identity: str, label: str, wanted: list[str]) -> DataFrame:
    """Relational division: identities that have every wanted label."""
    return (
        df.where(F.col(label).isin(wanted)).groupBy(identity).agg(F.count_distinct(label).alias("_n"))
        .where(F.col("_n") == len(set(wanted))).select(identity)
    )


def rectangle(df: DataFrame, identity: str, label: str, wanted: list[str], best: list[Column | str]) -> DataFrame:
    """One row, the best, for every cell of complete identities times wanted labels."""
    cells = df.where(F.col(label).isin(wanted)).join(having_all(df, identity, label, wanted), identity, "left_semi")
    rest = [c for c in df.columns if c not in (identity, label)]
    return cells.groupBy(identity, label).agg(F.min_by(F.struct(*rest), F.struct(*best)).alias("_r")).select(identity, label, *[F.col(f"_r.{c}").alias(c) for c in rest])


def label_pareto(df: DataFrame, identity: str, label: str, vocabulary: list[str]) -> DataFrame:
    """(k, labels, n_identities): for every k the label sets of size k that most identities have completely, all ties.

    Identities are reduced to the set of their labels and counted per set
    first, so the subsets are tried on at most 2^|vocabulary| rows.
    """
    names = sorted(set(vocabulary))
    if len(names) > 16:
        raise ValueError("the subsets of more than 16 labels are too many")
    bit = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)])
    masks = (
        df.where(F.col(label).isin(names)).groupBy(identity).agg(F.bit_or(bit[F.col(label)]).alias("mask"))
        .groupBy("mask").agg(F.count("*").alias("n"))
    )
    subsets = [(len(c), "|".join(c), sum(1 << names.index(x) for x in c)) for k in range(1, len(names) + 1) for c in combinations(names, k)]
    held = masks.select("n", F.explode(F.array(*[
        F.when(F.col("mask").bitwiseAND(F.lit(m)) == m, F.struct(F.lit(k).alias("k"), F.lit(text).alias("labels"))) for k, text, m in subsets
    ])).alias("s")).where("s is not null")
    counts = held.groupBy("s.k", "s.labels").agg(F.sum("n").alias("n_identities"))
    return counts.withColumn("_r", F.rank().over(Window.partitionBy("k").orderBy(F.desc("n_identities")))).where("_r = 1").drop("_r")


def contrast_groups(df: DataFrame, condition: list[str], action: str, target: str) -> DataFrame:
    """Causal contrasts: under one condition, actions with differing targets.

    Per condition and action there must be one target, else the action
    conflicts; actions with equal targets collapse to the first; a condition
    is kept when two or more targets are left. Per condition: status, number of
    actions, conflicts, aliases and contrasts, and the kept actions.
    """
    per_action = df.where(F.col(action).isNotNull() & F.col(target).isNotNull()).groupBy(*condition, action).agg(
        F.count_distinct(target).alias("_n"), F.min(target).alias("_t")
    )
    per_target = per_action.groupBy(*condition, F.when(F.col("_n") == 1, F.col("_t")).alias("_t")).agg(
        F.min(action).alias("_first"), F.count("*").alias("_members")
    )
    single = F.col("_t").isNotNull()
    out = per_target.groupBy(*condition).agg(
        F.sum("_members").alias("n_actions"),
        F.coalesce(F.sum(F.when(~single, F.col("_members"))), F.lit(0)).alias("n_conflicting"),
        F.coalesce(F.sum(F.when(single, F.col("_members") - 1)), F.lit(0)).alias("n_aliases"),
        F.count_if(single).alias("n_contrasts"),
        F.array_join(F.array_sort(F.collect_list(F.when(single, F.col("_first")))), "|").alias("actions"),
    )
    status = (
        F.when(F.col("n_contrasts") >= 2, "selected").when(F.col("n_conflicting") > 0, "conflicting_targets")
        .when(F.col("n_aliases") > 0, "aliases_only").otherwise("single_action")
    )
    return out.withColumn("status", status)


def cyclic_next(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``df`` with the value of the next row of the group, the first following the last."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("next_value", F.coalesce(F.lead(value).over(w), F.first(value).over(w)))


def sampler_weights(df: DataFrame, identity: str, action: str) -> DataFrame:
    """``df`` with the chance of drawing each row when identity, then action, then row are drawn evenly."""
    rows = df.groupBy(identity, action).agg(F.count("*").alias("_rows"))
    actions = rows.groupBy(identity).agg(F.count("*").alias("_actions"))
    identities = actions.count()
    cells = rows.join(actions, identity)
    weights = cells.select(F.to_json(F.struct(identity, action)).alias("_cell"), (1 / (F.lit(identities) * F.col("_actions") * F.col("_rows"))).alias("weight"))
    hot = hottest(cells.select(F.to_json(F.struct(identity, action)).alias("_cell"), F.col("_rows").alias("n")), "_cell", df.count())
    keyed = df.where(F.col(identity).isNotNull() & F.col(action).isNotNull()).withColumn("_cell", F.to_json(F.struct(identity, action)))
    return lookup_join(keyed, weights, "_cell", hot=hot).drop("_cell")


def pair_candidates(df: DataFrame, identity: str, action: str, most: int) -> DataFrame:
    """(identity, first_action, second_action, n_identities): per pair of actions its first ``most`` identities, and how many have it.

    Offers enough for ``most`` picks by ``greedy_pairs``: before the last of
    them fewer than ``most`` identities are used, so of a pair with more
    identities one of the first ``most`` is unused and precedes all others.
    """
    held = df.where(F.col(identity).isNotNull() & F.col(action).isNotNull()).groupBy(F.col(identity).alias("identity")).agg(F.array_sort(F.collect_set(action)).alias("_a"))
    pairs = held.select("identity", F.explode(F.flatten(F.transform("_a", lambda x: F.transform(
        F.filter("_a", lambda y: y > x), lambda y: F.struct(x.alias("first_action"), y.alias("second_action")))))).alias("p")).select("identity", "p.*")
    names = ["first_action", "second_action"]
    counts = pairs.groupBy(*names).agg(F.count("*").alias("n_identities"))
    first = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("identity"))).where(F.col("_r") <= most).drop("_r")
    return first.join(counts, names).select("identity", *names, "n_identities")


def greedy_pairs(candidates: list[tuple[str, str, str]], most: int, frequency: dict[tuple[str, str], int] | None = None) -> list[tuple[str, str, str]]:
    """Balanced (identity, action, action) pairs, one best candidate at a time.

    Best is that of the identity least used so far, then a pair not used yet,
    the actions least used, the pair that fewest identities have, the names.
    ``frequency`` is the number of identities of each pair; without it the
    candidates are counted.
    """
    left, out = set(candidates), []
    held = frequency if frequency is not None else Counter(c[1:] for c in left)
    used_identity: Counter[str] = Counter()
    used_action: Counter[str] = Counter()
    used_pairs: set[tuple[str, str]] = set()
    while left and len(out) < most:
        best = min(left, key=lambda c: (used_identity[c[0]], c[1:] in used_pairs, used_action[c[1]] + used_action[c[2]], held[c[1:]], c[1:], c[0]))
        left.discard(best)
        out.append(best)
        used_identity[best[0]] += 1
        used_pairs.add(best[1:])
        used_action.update(best[1:])
    return out


def balanced_splits(sizes: list[tuple[str, int]], ratios: dict[str, float], seed: str = "balanced") -> dict[str, str]:
    """Components, largest first, to the split that keeps the squared relative deviation from the targets least.

    Exact ties are broken by a seeded digest, a split without share gets
    nothing, and every other one at least a component where there are enough.
    The driver holds one (component, size) per component, as each choice
    depends on all before; use ``hash_split`` where components are too many.
    """
    import hashlib

    digest = lambda value: hashlib.sha256(f"{seed}\0{value}".encode()).digest()
    active = [s for s, r in ratios.items() if r > 0]
    total = sum(n for _, n in sizes)
    target = {s: total * ratios[s] for s in active}
    have, held = dict.fromkeys(active, 0), dict.fromkeys(active, 0)
    out: dict[str, str] = {}
    order = sorted(sizes, key=lambda c: (-c[1], digest(c[0]), c[0].encode()))
    for k, (name, n) in enumerate(order):
        waiting = [s for s in active if not held[s]]
        pool = waiting if waiting and len(order) - k == len(waiting) else active

        def cost(s: str) -> tuple[float, bytes, bytes]:
            away = sum((have[x] + (n if x == s else 0) - target[x]) ** 2 / max(target[x], 1.0) for x in active)
            return away, digest(f"{name}\0{s}"), s.encode()

        best = min(pool, key=cost)
        have[best] += n
        held[best] += 1
        out[name] = best
    return out
