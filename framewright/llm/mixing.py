"""p8: mixing sources to target weights, each repeated at most a capped number of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.keys import letters_and_digits
from framewright.operators.ranks import distributed_rank
from framewright.operators.skew import lookup_join
from framewright.session import Scratch, load


def token_count(text: Column) -> Column:
    """Runs of letters, digits and underscores, and other single characters that aren't blank; null counts 0.

    Each run is replaced by one character and blanks are dropped; what remains is one character per token.
    """
    runs = F.regexp_replace(text, r"[\p{L}\p{N}_]+", "a")
    return F.coalesce(F.char_length(F.regexp_replace(runs, r"[\p{IsWhite_Space}\x1c-\x1f]+", "")), F.lit(0)).cast("bigint")


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source_key, tokens); a document without source belongs to none."""
    return documents.select(
        "doc_id", letters_and_digits(F.col("source")).alias("source_key"), token_count(F.col("text")).alias("tokens")
    ).where(F.col("source_key").isNotNull())


def mixture_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mixture and source: tokens, budget, wanted and reachable tokens, and expected copies per document.

    ``sizes`` holds (source_key, tokens) per source. A source without
    documents, or of documents without tokens, can give nothing.
    """
    wanted = targets.withColumn("source_key", letters_and_digits(F.col("doc_source")))
    with_size = wanted.join(sizes, "source_key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
    pools = (
        with_size.select("mixture_name", "source_key", "tokens").distinct()
        .groupBy("mixture_name").agg(F.sum("tokens").alias("pool"))
    )
    return (
        with_size.join(pools, "mixture_name")
        .withColumn("budget", F.col("budget_ratio") * F.col("pool"))
        .withColumn("wanted", F.col("target_weight") * F.col("budget"))
        .withColumn("reachable", (F.col("max_repeats") * F.col("tokens")).cast("double"))
        .withColumn("short", F.col("wanted") > F.col("reachable"))
        .withColumn(
            "copies",
            F.when(F.col("tokens") > 0, F.least(F.col("wanted") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0),
        )
    )


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source_key").agg(F.sum("tokens").alias("tokens"))


def _drawn(text: Column) -> Column:
    """The first 52 bits of the SHA-256 of a text."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def mixed(spark: SparkSession, documents: DataFrame, targets: DataFrame, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(draws, plan): draws holds (mixture_name, doc_id, source_key, tokens, copies) with copies >= 1.

    Systematic sampling: documents of a source stand in a hashed order; each
    adds its expected copies to a running sum, one random offset per mixture
    and source is added, and a document is emitted once per integer boundary
    its step crosses. So every document gets the whole number below or above
    its expected copies, and never more than ``max_repeats``.
    """
    sized = Scratch(spark, "mixing").write(sized_documents(documents), "sized")
    plan = mixture_plan(source_sizes(sized), targets)
    ranked = distributed_rank(
        spark,
        sized.withColumn("_shuffled", _drawn(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string")))),
        ["source_key"],
        ["_shuffled", "doc_id"],
    )
    rates = plan.where("copies > 0").select("mixture_name", "source_key", "copies").groupBy("source_key").agg(
        F.collect_list(F.struct("mixture_name", "copies")).alias("rates")
    )  # one entry per mixture that names the source
    stepped = lookup_join(ranked, rates, "source_key").select("doc_id", "source_key", "tokens", "rank", F.explode("rates").alias("r"))
    offset = _drawn(F.concat(F.lit(f"{seed}|"), F.col("r.mixture_name"), F.lit("|"), F.col("source_key"))) / float(1 << 52)
    crossed = F.floor(F.col("rank") * F.col("r.copies") + offset) - F.floor((F.col("rank") - 1) * F.col("r.copies") + offset)
    draws = stepped.select(F.col("r.mixture_name").alias("mixture_name"), "doc_id", "source_key", "tokens", crossed.cast("int").alias("copies"))
    return draws.where("copies > 0"), plan


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    """Every document drawn for a mixture, with its number of copies."""
    draws, _ = mixed(spark, load(spark, root, "documents"), load(spark, root, "mixture_targets"))
    return draws.select("mixture_name", "doc_id", "copies")


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Per mixture and source: target share, tokens drawn and the share really reached."""
    draws, plan = mixed(spark, load(spark, root, "documents"), load(spark, root, "mixture_targets"))
    drawn = draws.groupBy("mixture_name", "source_key").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies")
    )
    joined = plan.join(drawn, ["mixture_name", "source_key"], "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0).cast("bigint")))
    totals = joined.groupBy("mixture_name").agg(F.sum("drawn_tokens").alias("_all"))
    return joined.join(totals, "mixture_name").select(
        "mixture_name", "doc_source", "target_weight", "max_repeats", "tokens",
        F.round("wanted", 3).alias("wanted_tokens"), "short", "drawn_tokens",
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(F.when(F.col("_all") > 0, F.col("drawn_tokens") / F.col("_all")).otherwise(0.0), 9).alias("reached_share"),
    )


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Sources whose draw can't give their share of the budget even at full repetition."""
    return p8_shares(spark, root).where("short").select("mixture_name", "doc_source")


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares, "p8_mixture": p8_mixture}

_SIZES = r"""
    sized AS (
        SELECT regexp_replace(lower(source), '[^\p{L}\p{N}]+', '', 'g') AS k,
            length(regexp_replace(regexp_replace(text, '[\p{L}\p{N}_]+', 'a', 'g'),
                '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g')) AS t
        FROM documents),
    sizes AS (SELECT k, sum(t) AS tokens FROM sized WHERE k NOT IN ('', 'unknown') GROUP BY k),
    wanted AS (
        SELECT m.*, coalesce(s.tokens, 0) AS tokens FROM mixture_targets m
        LEFT JOIN sizes s ON s.k = regexp_replace(lower(m.doc_source), '[^\p{L}\p{N}]+', '', 'g')),
    pools AS (SELECT mixture_name, sum(tokens) AS pool FROM wanted GROUP BY mixture_name)
"""
_DRAWS = """
    plan AS (SELECT w.*, regexp_replace(lower(doc_source), '[^\\p{L}\\p{N}]+', '', 'g') AS k, target_weight * (budget_ratio * pool) AS wanted_tokens,
        CASE WHEN tokens > 0 THEN least(CAST(target_weight * (budget_ratio * pool) AS DOUBLE) / CAST(tokens AS DOUBLE), CAST(max_repeats AS DOUBLE)) ELSE 0.0 END AS rate FROM wanted w JOIN pools USING (mixture_name)),
    placed AS (SELECT doc_id, k, t, row_number() OVER (PARTITION BY k ORDER BY ('0x' || substr(sha256('mix|' || doc_id), 1, 13))::UBIGINT, doc_id) AS r
        FROM (SELECT doc_id, regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', '', 'g') AS k,
            coalesce(length(regexp_replace(regexp_replace(text, '[\\p{L}\\p{N}_]+', 'a', 'g'),
                '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g')), 0) AS t FROM documents) WHERE k NOT IN ('', 'unknown')),
    steps AS (SELECT mixture_name, doc_id, placed.k, t, r, rate, CAST(('0x' || substr(sha256('mix|' || mixture_name || '|' || placed.k), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496.0 AS o FROM placed JOIN plan ON plan.k = placed.k WHERE rate > 0),
    draws AS (SELECT mixture_name, doc_id, k, t, CAST(floor(r * rate + o) - floor((r - 1) * rate + o) AS INTEGER) AS copies FROM steps WHERE floor(r * rate + o) > floor((r - 1) * rate + o))
"""
ORACLES = {
    "p8_found": f"""WITH {_SIZES}
        SELECT mixture_name, doc_source FROM wanted JOIN pools USING (mixture_name)
        WHERE target_weight * (budget_ratio * pool) > max_repeats * tokens
    """,
    "p8_mixture": f"WITH {_SIZES}, {_DRAWS} SELECT mixture_name, doc_id, copies FROM draws",
    "p8_shares": f"""WITH {_SIZES}, {_DRAWS},
        got AS (SELECT mixture_name, k, CAST(sum(t * copies) AS BIGINT) AS n, max(copies) AS most FROM draws GROUP BY 1, 2),
        every AS (SELECT p.*, coalesce(g.n, 0) AS n, coalesce(g.most, 0) AS most FROM plan p LEFT JOIN got g USING (mixture_name, k))
        SELECT mixture_name, doc_source, target_weight, max_repeats, CAST(tokens AS BIGINT) AS tokens, round(wanted_tokens, 3) AS wanted_tokens, wanted_tokens > max_repeats * tokens AS short,
            n AS drawn_tokens, most AS most_copies, round(CASE WHEN sum(n) OVER (PARTITION BY mixture_name) > 0 THEN n / sum(n) OVER (PARTITION BY mixture_name) ELSE 0.0 END, 9) AS reached_share FROM every
    """,
}
