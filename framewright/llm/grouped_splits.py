"""p6: splits that keep related records together.

Rows are tied by identity or source file. The graph is built over the distinct
(identity, file) pairs rather than over rows, its components are found by
hash-to-min, and components are sent to splits by weighted rendezvous hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.keys import digest, letters_and_digits, split_name
from framewright.operators.graph import components
from framewright.operators.skew import lookup_join
from framewright.session import Scratch, load

WEIGHTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def rendezvous(key: Column, weights: dict[str, float] = WEIGHTS, seed: str = "grouped") -> Column:
    """The split of greatest weighted score; adding a split moves only what it wins.

    Score of a split: weight / -ln(u), with u a uniform hash of split and key.
    A null key gives null.
    """
    offers = [
        F.struct(
            (F.lit(w) / -F.log((_drawn(F.concat(F.lit(f"{seed}|{name}|"), key)) + 0.5) / float(1 << 52))).alias("score"),
            F.lit(name).alias("split"),
        )
        for name, w in sorted(weights.items())
        if w > 0
    ]
    return F.when(key.isNotNull(), F.greatest(*offers)["split"])


def _drawn(text: Column) -> Column:
    """The first 52 bits of the SHA-256 of a text."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def _node(first: str, second: str) -> Column:
    """A graph node of fixed width: 96 bits of the SHA-256 of the token."""
    return F.substring(F.sha2(F.coalesce(first, second), 256), 1, 24)


def tied_groups(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(sequence_id, split, group): one row per sequence, ``group`` null where nothing ties it.

    Identities and files are compared by their plain forms; an absent value
    ties nothing. A row tied by nothing is a group of its own. Repeated rows
    of a key count once; other columns are ignored.
    """
    scratch = Scratch(spark, "tied")
    rows = scratch.write(
        df.where(F.col("sequence_id").isNotNull()).select(
            "sequence_id",
            split_name(F.col("split")).alias("split"),
            F.concat(F.lit("i"), letters_and_digits(F.col("identity_id"))).alias("identity"),
            F.concat(F.lit("f"), digest(F.col("source_file_sha256"))).alias("file"),
        ),
        "rows",
    )
    links = rows.where(F.col("identity").isNotNull() | F.col("file").isNotNull()).select(
        _node("identity", "file").alias("src"), _node("file", "identity").alias("dst")
    )
    # half of one edge per row at most, and far fewer once equal ones have gone
    found = components(spark, links.distinct())
    keyed = rows.select("sequence_id", "split", _node("identity", "file").alias("node"), (F.col("identity").isNotNull() | F.col("file").isNotNull()).alias("_tied"))
    keyed = keyed.withColumn("node", F.when(F.col("_tied"), F.col("node"))).drop("_tied")
    return lookup_join(keyed, found, "node", "left").select("sequence_id", "split", F.col("component").alias("group"))


def grouped(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their group, and per group its first sequence, size and splits."""
    rows = Scratch(spark, "groups").write(tied_groups(spark, df).distinct(), "rows")
    groups = (
        rows.where(F.col("group").isNotNull())
        .groupBy("group")
        .agg(
            F.min("sequence_id").alias("group_first_sequence_id"),
            F.count_distinct("sequence_id").alias("n_sequences"),
            F.max((F.col("split") == "train").cast("int")).alias("_train"),
            F.max((F.col("split") == "validation").cast("int")).alias("_validation"),
            F.max((F.col("split") == "test").cast("int")).alias("_test"),
        )
        .withColumn(
            "n_splits",
            F.coalesce("_train", F.lit(0)) + F.coalesce("_validation", F.lit(0)) + F.coalesce("_test", F.lit(0)),
        )
        .drop("_train", "_validation", "_test")
    )
    return rows, groups


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Every row of each group whose rows lie in more than one split."""
    rows, groups = grouped(spark, load(spark, root, "prepared_broad_rows"))
    torn = groups.where("n_splits > 1").select("group", "group_first_sequence_id")
    return (
        lookup_join(rows.where(F.col("group").isNotNull()), torn, "group")
        .select("sequence_id", "group_first_sequence_id")
        .distinct()
    )


def p6_splits(spark: SparkSession, root: str) -> DataFrame:
    """A new split for every sequence, about 80/10/10, that tears no group."""
    rows, groups = grouped(spark, load(spark, root, "prepared_broad_rows"))
    named = lookup_join(rows, groups.select("group", "group_first_sequence_id"), "group", "left")
    first = F.coalesce("group_first_sequence_id", "sequence_id")
    return (
        named.select(
            "sequence_id",
            first.alias("group_first_sequence_id"),
            F.col("split").alias("old_split"),
            rendezvous(first).alias("new_split"),
        )
        .groupBy("sequence_id")
        .agg(
            F.min("group_first_sequence_id").alias("group_first_sequence_id"),
            F.min("old_split").alias("old_split"),
            F.min("new_split").alias("new_split"),
        )
    )


QUERIES = {"p6_found": p6_found, "p6_splits": p6_splits}
_GROUPS = r"""
        WITH RECURSIVE base AS (
            SELECT DISTINCT sequence_id,
                CASE WHEN regexp_matches(s, '^train') THEN 'train' WHEN regexp_matches(s, '^(val|dev)') THEN 'validation'
                     WHEN regexp_matches(s, '^test') THEN 'test' END AS split,
                CASE WHEN i NOT IN ('', 'unknown') THEN 'i' || i END AS identity,
                CASE WHEN regexp_full_match(f, '[0-9a-f]{64}') AND NOT regexp_full_match(f, '0+') THEN 'f' || f END AS file
            FROM (SELECT sequence_id, regexp_replace(lower(split), '[^a-z]+', '', 'g') AS s,
                regexp_replace(lower(translate(identity_id,
                    (SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)),
                    (SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)))),
                    '[^\p{L}\p{N}]+', '', 'g') AS i,
                regexp_replace(regexp_replace(lower(source_file_sha256), 'sha-?256', ''), '[^0-9a-z]+', '', 'g') AS f
                FROM prepared_broad_rows)),
        links AS (SELECT DISTINCT coalesce(identity, file) AS a, coalesce(file, identity) AS b FROM base
                  WHERE coalesce(identity, file) IS NOT NULL),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a AS node, a AS seen FROM both_ways UNION
                  SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.seen = w.a),
        comp AS (SELECT node, min(seen) AS g FROM reach GROUP BY node),
        placed AS (SELECT b.sequence_id, b.split, c.g FROM base b JOIN comp c ON c.node = coalesce(b.identity, b.file))
"""
_SCORE = "{w} / -ln((CAST(('0x' || substr(sha256('grouped|{name}|' || first), 1, 13)) AS UBIGINT) + 0.5) / 4503599627370496.0)"
ORACLES = {
    "p6_found": _GROUPS + """,
        torn AS (SELECT g, min(sequence_id) AS group_first_sequence_id FROM placed GROUP BY g HAVING count(DISTINCT split) > 1)
        SELECT DISTINCT p.sequence_id, t.group_first_sequence_id FROM placed p JOIN torn t USING (g)
    """,
    "p6_splits": _GROUPS + f""",
        firsts AS (SELECT g, min(sequence_id) AS first FROM placed GROUP BY g),
        every AS (SELECT b.sequence_id, coalesce(f.first, b.sequence_id) AS first, b.split FROM base b LEFT JOIN comp c ON c.node = coalesce(b.identity, b.file) LEFT JOIN firsts f ON f.g = c.g WHERE b.sequence_id IS NOT NULL),
        drawn AS (SELECT *, CASE WHEN {_SCORE.format(w=0.8, name='train')} > greatest({_SCORE.format(w=0.1, name='test')}, {_SCORE.format(w=0.1, name='validation')}) THEN 'train'
            WHEN {_SCORE.format(w=0.1, name='test')} > {_SCORE.format(w=0.1, name='validation')} THEN 'test' ELSE 'validation' END AS new_split FROM every)
        SELECT sequence_id, min(first) AS group_first_sequence_id, min(split) AS old_split, min(new_split) AS new_split FROM drawn GROUP BY 1
    """,
}
