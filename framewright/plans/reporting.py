"""Report, audit and split queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.hashing import bucket_split, hash_split, member_hash
from framewright.functions.keys import digest, split_name
from framewright.operators import reports as R
from framewright.operators.graph import components, star_edges
from framewright.operators.sampling import balanced_splits
from framewright.operators.skew import union_all
from framewright.session import Scratch, load

RATIOS = {"train": 0.9, "validation": 0.05, "test": 0.05}


def corpus_summary(spark: SparkSession, root: str) -> DataFrame:
    names = ["sources", "corpus_items", "prepared_broad_rows", "latent_motion_training_rows", "raw_properties", "documents", "events"]
    return R.table_counts({n: load(spark, root, n) for n in names})


def distributions(spark: SparkSession, root: str) -> DataFrame:
    documents, motions = load(spark, root, "documents"), load(spark, root, "latent_motion_training_rows")
    frames = load(spark, root, "prepared_broad_rows")
    size = F.concat_ws("x", F.transform("source_size", lambda v: v.cast("string")))
    return union_all([
        R.distribution(documents, F.col("lang"), "lang"),
        R.distribution(documents, F.col("doc_kind"), "doc_kind"),
        R.distribution(motions, F.col("loop_mode"), "loop_mode"),
        R.distribution(motions, split_name(F.col("split")), "split"),
        R.distribution(frames, F.when(F.col("source_size").isNotNull(), size), "dimensions"),
    ])


def source_records(spark: SparkSession, root: str) -> DataFrame:
    """One line per registered source with totals of every child table."""
    items = load(spark, root, "corpus_items").dropDuplicates(["id"])
    motions, frames = load(spark, root, "latent_motion_training_rows"), load(spark, root, "prepared_broad_rows")
    parents = load(spark, root, "sources").select(F.col("id").alias("source_id"), "kind")
    return R.child_totals(parents, "source_id", {
        "n_items": (items, F.count("*")),
        "n_external_ids": (items, F.count_distinct("external_id")),
        "n_tombstoned": (items, F.count("tombstoned_at")),
        "n_motions": (motions, F.count_distinct("sequence_id")),
        "n_frames": (frames.dropDuplicates(["sequence_id"]), F.coalesce(F.sum(F.size(F.coalesce("frame_phases", F.array().cast("array<double>")))), F.lit(0))),
    })


def rights_states(spark: SparkSession, root: str) -> DataFrame:
    """Rights of every item from the licence marks in the documents that name it."""
    mark = F.regexp_extract("text", r"CC-X-[0-9]", 0)
    observed = load(spark, root, "documents").where("item_id is not null").select("item_id", F.when(mark != "", mark).alias("label"))
    items = load(spark, root, "corpus_items").select(F.col("id").alias("item_id"))
    return R.rights_states(items, observed, "item_id", "label")


def coverage_grouping_sets(spark: SparkSession, root: str) -> DataFrame:
    motions = load(spark, root, "latent_motion_training_rows").withColumn("part", split_name(F.col("split")))
    return R.coverage(motions, "part", ["loop_mode", "source_id"])


def ratio_rollup(spark: SparkSession, root: str) -> DataFrame:
    lines = load(spark, root, "lineitem")
    return R.ratio_rollup(lines, ["l_returnflag", "l_linestatus"], (F.col("l_quantity") > 25).cast("bigint"), F.lit(1).cast("bigint")).select(
        "l_returnflag", "l_linestatus", "numerator", "denominator", F.round("ratio", 9).alias("ratio")
    )


def split_overlap_scalar(spark: SparkSession, root: str) -> DataFrame:
    frames = load(spark, root, "prepared_broad_rows").select("sequence_id", digest(F.col("source_file_sha256")).alias("file"), split_name(F.col("split")).alias("part"))
    return R.split_overlaps(frames.distinct(), "file", "part")


def split_overlap_array(spark: SparkSession, root: str) -> DataFrame:
    """Frame counts and sides that occur in more than one split, from an exploded array."""
    frames = load(spark, root, "prepared_broad_rows").select(F.explode("source_size").alias("side"), split_name(F.col("split")).alias("part"))
    return R.split_overlaps(frames, "side", "part")


def duplicate_excess(spark: SparkSession, root: str) -> DataFrame:
    return R.duplicate_summary(load(spark, root, "documents").select(F.sha2("text", 256).alias("blob")), "blob")


def multi_action_identities(spark: SparkSession, root: str) -> DataFrame:
    """The sequences of every identity with more than one verb, with the number of its verbs."""
    motions = load(spark, root, "latent_motion_training_rows").where("identity_id is not null")
    return R.multi_label_groups(motions, "identity_id", "verb", "sequence_id", 2)


def nearest_rank_distribution(spark: SparkSession, root: str) -> DataFrame:
    return R.nearest_rank(load(spark, root, "orders"), "o_orderpriority", "o_totalprice", {"p10": (1, 10), "median": (1, 2)})


def confusion_matrix(spark: SparkSession, root: str) -> DataFrame:
    return R.confusion(load(spark, root, "orders"), "o_orderstatus", "o_orderpriority").withColumn("share_of_actual", F.round("share_of_actual", 9))


def split_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Leakage-safe split of the documents by exact text, and what each split covers per language."""
    docs = load(spark, root, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.sha2("text", 256).alias("blob"))
    split = docs.withColumn("split", hash_split("documents", F.col("blob"), RATIOS))
    return split.groupBy("split", "lang").agg(F.count("*").alias("n_docs"), F.count_distinct("blob").alias("n_components"))


def hash_split_1000(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents")
    return docs.select("doc_id", bucket_split(F.col("text"), 1000, 16, [(900, "train"), (950, "validation")], "test").alias("split"))


def hash_split_100(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "customer").select("c_custkey", bucket_split(F.col("c_name"), 100, 8, [(90, "train"), (95, "validation")], "test").alias("split"))


def _document_groups(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, component): documents tied by equal text or by the same item."""
    docs = load(spark, root, "documents").select("doc_id", F.concat(F.lit("t"), F.sha2("text", 256)).alias("text_token"), F.concat(F.lit("i"), "item_id").alias("item_token"))
    tokens = docs.select("doc_id", F.explode(F.array_compact(F.array("text_token", "item_token"))).alias("token"))
    return components(spark, star_edges(tokens, "doc_id", "token")).select(F.col("node").alias("doc_id"), "component")


def leakage_components(spark: SparkSession, root: str) -> DataFrame:
    return _document_groups(spark, root)


def component_ids(spark: SparkSession, root: str) -> DataFrame:
    """Per group of equal texts with more than one document, its identity: the hash of its sorted members."""
    docs = load(spark, root, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.sha2("text", 256).alias("blob"))
    return (
        docs.groupBy("blob").agg(F.collect_list("doc").alias("_m")).where(F.size("_m") > 1)
        .select("blob", member_hash(F.col("_m"), "duplicate-component:").alias("component_id"), F.size("_m").cast("bigint").alias("n_members"))
    )


def balanced_split(spark: SparkSession, root: str) -> DataFrame:
    """Whole components to splits by greedy balance; sizes per split."""
    groups = Scratch(spark, "balanced-split").write(_document_groups(spark, root), "groups")
    sizes = [(str(r["component"]), r["n"]) for r in groups.groupBy("component").agg(F.count("*").alias("n")).collect()]
    placed = spark.createDataFrame(sorted(balanced_splits(sizes, RATIOS).items()) or [("", "")], "component string, split string")
    joined = groups.withColumn("component", F.col("component").cast("string")).join(placed, "component")
    return joined.groupBy("split").agg(F.count("*").alias("n_docs"), F.count_distinct("component").alias("n_components"))


def no_leakage_check(spark: SparkSession, root: str) -> DataFrame:
    """Components in more than one split after a split by component: always none."""
    split = _document_groups(spark, root).withColumn("split", hash_split("documents", F.col("component").cast("string"), RATIOS))
    torn = split.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1")
    return torn.agg(F.count("*").alias("n_torn_components"))


QUERIES = {f.__name__: f for f in (
    split_coverage, corpus_summary, distributions, source_records, rights_states, coverage_grouping_sets, ratio_rollup,
    split_overlap_scalar, split_overlap_array, duplicate_excess, multi_action_identities, nearest_rank_distribution,
    confusion_matrix, hash_split_1000, hash_split_100, leakage_components, component_ids, balanced_split, no_leakage_check,
)}

_SPLIT = """CASE WHEN regexp_replace(lower({c}), '[^a-z]+', '', 'g') LIKE 'train%' THEN 'train'
    WHEN regexp_matches(regexp_replace(lower({c}), '[^a-z]+', '', 'g'), '^(val|dev)') THEN 'validation'
    WHEN regexp_replace(lower({c}), '[^a-z]+', '', 'g') LIKE 'test%' THEN 'test' END"""
SPLIT = _SPLIT.format(c="split")
_DIGEST = "regexp_replace(regexp_replace(lower({c}), 'sha-?256', ''), '[^0-9a-z]+', '', 'g')"
FILE = _DIGEST.format(c="source_file_sha256")


def _leading(text: str, digits: int) -> str:
    return f"('0x' || substr({text}, 1, {digits}))::UBIGINT"


_FRACTION = _leading("sha256('documents' || chr(0) || {key})", 16)
_CUTS = (int(0.9 * 2**64), int((0.9 + 0.05) * 2**64))

_COST = "({a} - ta) * ({a} - ta) / greatest(ta, 1.0) + ({b} - tb) * ({b} - tb) / greatest(tb, 1.0) + ({d} - tb) * ({d} - tb) / greatest(tb, 1.0)"

ORACLES = {
    "corpus_summary": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}"
        for n in ["sources", "corpus_items", "prepared_broad_rows", "latent_motion_training_rows", "raw_properties", "documents", "events"]
    ),
    "distributions": f"""
        SELECT 'lang' AS dimension, coalesce(lang, 'none') AS value, count(*) AS n_rows FROM documents GROUP BY ALL
        UNION ALL SELECT 'doc_kind', coalesce(doc_kind, 'none'), count(*) FROM documents GROUP BY ALL
        UNION ALL SELECT 'loop_mode', coalesce(loop_mode, 'none'), count(*) FROM latent_motion_training_rows GROUP BY ALL
        UNION ALL SELECT 'split', coalesce({SPLIT}, 'none'), count(*) FROM latent_motion_training_rows GROUP BY ALL
        UNION ALL SELECT 'dimensions', coalesce(array_to_string(source_size, 'x'), 'none'), count(*) FROM prepared_broad_rows GROUP BY ALL
    """,
    "source_records": """
        WITH items AS (SELECT DISTINCT ON (id) * FROM corpus_items ORDER BY id, ingested_at),
        frames AS (SELECT DISTINCT ON (sequence_id) * FROM prepared_broad_rows ORDER BY sequence_id)
        SELECT s.id AS source_id, s.kind, coalesce(i.a, 0) AS n_items, coalesce(i.b, 0) AS n_external_ids, coalesce(i.c, 0) AS n_tombstoned,
            coalesce(m.a, 0) AS n_motions, coalesce(CAST(f.a AS BIGINT), 0) AS n_frames
        FROM sources s
        LEFT JOIN (SELECT source_id, count(*) a, count(DISTINCT external_id) b, count(tombstoned_at) c FROM items GROUP BY 1) i ON i.source_id = s.id
        LEFT JOIN (SELECT source_id, count(DISTINCT sequence_id) a FROM latent_motion_training_rows GROUP BY 1) m ON m.source_id = s.id
        LEFT JOIN (SELECT source_id, sum(coalesce(len(frame_phases), 0)) a FROM frames GROUP BY 1) f ON f.source_id = s.id
    """,
    "rights_states": """
        WITH o AS (SELECT item_id, nullif(regexp_extract(text, 'CC-X-[0-9]'), '') AS label FROM documents WHERE item_id IS NOT NULL),
        p AS (SELECT item_id, count(*) n, count(*) FILTER (label IS NULL) u, string_agg(DISTINCT label, '|' ORDER BY label) l, count(DISTINCT label) k FROM o GROUP BY 1)
        SELECT i.item_id, coalesce(n, 0) AS n_observations, coalesce(u, 0) AS n_unknown, coalesce(l, '') AS labels,
            CASE WHEN n IS NULL THEN 'none' WHEN k = 0 THEN 'unknown' WHEN k > 1 THEN 'conflicting' WHEN u > 0 THEN 'partial' ELSE 'known' END AS rights_state
        FROM (SELECT DISTINCT id AS item_id FROM corpus_items) i LEFT JOIN p USING (item_id)
    """,
    "coverage_grouping_sets": f"""
        WITH d AS (
            SELECT coalesce({SPLIT}, 'none') AS split, 'loop_mode' AS dimension, coalesce(loop_mode, 'none') AS value FROM latent_motion_training_rows
            UNION ALL SELECT coalesce({SPLIT}, 'none'), 'source_id', coalesce(source_id, 'none') FROM latent_motion_training_rows)
        SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, dimension, value, count(*) AS n_rows
        FROM d GROUP BY GROUPING SETS ((dimension, value), (split, dimension, value))
    """,
    "ratio_rollup": """
        SELECT CASE WHEN grouping(l_returnflag) = 1 THEN '*' ELSE l_returnflag END AS l_returnflag,
            CASE WHEN grouping(l_linestatus) = 1 THEN '*' ELSE l_linestatus END AS l_linestatus,
            CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS numerator, count(*) AS denominator,
            round(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) / count(*), 9) AS ratio
        FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    """,
    "split_overlap_scalar": f"""
        WITH b AS (SELECT DISTINCT sequence_id, {FILE} AS file, {SPLIT} AS part FROM prepared_broad_rows)
        SELECT file, string_agg(DISTINCT part, '|' ORDER BY part) AS splits, count(*) AS n_rows FROM b
        WHERE regexp_full_match(file, '[0-9a-f]{{64}}') AND NOT regexp_full_match(file, '0+') AND part IS NOT NULL
        GROUP BY file HAVING count(DISTINCT part) > 1
    """,
    "split_overlap_array": f"""
        WITH b AS (SELECT unnest(source_size) AS side, {SPLIT} AS part FROM prepared_broad_rows)
        SELECT side, string_agg(DISTINCT part, '|' ORDER BY part) AS splits, count(*) AS n_rows FROM b
        WHERE side IS NOT NULL AND part IS NOT NULL GROUP BY side HAVING count(DISTINCT part) > 1
    """,
    "duplicate_excess": """
        WITH g AS (SELECT sha256(text) b, count(*) n FROM documents WHERE text IS NOT NULL GROUP BY 1)
        SELECT count(*) AS n_values, count(*) FILTER (n > 1) AS n_duplicate_groups, coalesce(CAST(sum(n) FILTER (n > 1) AS BIGINT), 0) AS n_duplicate_rows,
            coalesce(CAST(sum(n - 1) FILTER (n > 1) AS BIGINT), 0) AS n_excess_rows FROM g
    """,
    "multi_action_identities": """
        WITH d AS (SELECT DISTINCT identity_id, verb, sequence_id FROM latent_motion_training_rows WHERE identity_id IS NOT NULL AND verb IS NOT NULL),
        n AS (SELECT identity_id, count(DISTINCT verb) AS n_labels FROM d GROUP BY identity_id HAVING count(DISTINCT verb) >= 2)
        SELECT identity_id, verb, sequence_id, n_labels FROM d JOIN n USING (identity_id)
    """,
    "nearest_rank_distribution": """
        WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i,
            count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_totalprice IS NOT NULL)
        SELECT o_orderpriority, count(*) AS n_rows, min(o_totalprice) AS least, max(o_totalprice) FILTER (i = (n - 1) // 10) AS p10,
            max(o_totalprice) FILTER (i = (n - 1) // 2) AS median, max(o_totalprice) AS greatest FROM r GROUP BY 1
    """,
    "confusion_matrix": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows,
            round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 9) AS share_of_actual
        FROM orders GROUP BY 1, 2
    """,
    "split_coverage": f"""
        WITH d AS (SELECT coalesce(lang, 'none') AS lang, sha256(text) AS blob FROM documents),
        s AS (SELECT *, {_FRACTION.format(key='blob')} AS f FROM d)
        SELECT CASE WHEN f < {_CUTS[0]}::UBIGINT THEN 'train' WHEN f < {_CUTS[1]}::UBIGINT THEN 'validation' ELSE 'test' END AS split,
            lang, count(*) AS n_docs, count(DISTINCT blob) AS n_components FROM s GROUP BY 1, 2
    """,
    "hash_split_1000": f"""
        SELECT doc_id, CASE WHEN {_leading('sha256(text)', 16)} % 1000 < 900 THEN 'train'
            WHEN {_leading('sha256(text)', 16)} % 1000 < 950 THEN 'validation' ELSE 'test' END AS split FROM documents
    """,
    "hash_split_100": f"""
        SELECT c_custkey, CASE WHEN {_leading('sha256(c_name)', 8)} % 100 < 90 THEN 'train'
            WHEN {_leading('sha256(c_name)', 8)} % 100 < 95 THEN 'validation' ELSE 'test' END AS split FROM customer
    """,
    "leakage_components": """
        WITH RECURSIVE t AS (SELECT doc_id, 't' || sha256(text) AS token FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT doc_id, 'i' || item_id FROM documents WHERE item_id IS NOT NULL),
        c AS (SELECT token, min(doc_id) AS centre FROM t GROUP BY 1),
        e AS (SELECT DISTINCT doc_id AS a, centre AS b FROM t JOIN c USING (token)),
        w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT a AS node, a AS seen FROM w UNION SELECT r.node, w.b FROM r JOIN w ON r.seen = w.a)
        SELECT node AS doc_id, min(seen) AS component FROM r GROUP BY 1
    """,
    "balanced_split": f"""
        WITH RECURSIVE t AS (SELECT doc_id, 't' || sha256(text) AS token FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT doc_id, 'i' || item_id FROM documents WHERE item_id IS NOT NULL),
        c AS (SELECT token, min(doc_id) AS centre FROM t GROUP BY 1), e AS (SELECT DISTINCT doc_id AS a, centre AS b FROM t JOIN c USING (token)),
        w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM w UNION SELECT r.node, w.b FROM r JOIN w ON r.seen = w.a),
        n AS (SELECT CAST(component AS VARCHAR) AS c, count(*) AS n FROM (SELECT node, min(seen) AS component FROM r GROUP BY 1) GROUP BY 1),
        o AS (SELECT c, n, row_number() OVER (ORDER BY n DESC, sha256('balanced' || chr(0) || c), c) AS k, sum(n) OVER () * 0.9::DOUBLE AS ta, sum(n) OVER () * 0.05::DOUBLE AS tb, count(*) OVER () AS m FROM n),
        g AS (SELECT 0 AS k, 0 AS a, 0 AS b, 0 AS d, 0 AS ka, 0 AS kb, 0 AS kd, '' AS s, 0 AS n
            UNION ALL SELECT q.k, q.a + CASE WHEN q.s = 'train' THEN q.n ELSE 0 END, q.b + CASE WHEN q.s = 'validation' THEN q.n ELSE 0 END, q.d + CASE WHEN q.s = 'test' THEN q.n ELSE 0 END,
                q.ka + (q.s = 'train')::INT, q.kb + (q.s = 'validation')::INT, q.kd + (q.s = 'test')::INT, q.s, q.n
            FROM (SELECT o.k, g.a, g.b, g.d, g.ka, g.kb, g.kd, o.n, list_sort(list_filter([
                {{'e': {_COST.format(a='g.a + o.n', b='g.b', d='g.d')}, 'h': sha256('balanced' || chr(0) || c || chr(0) || 'train'), 's': 'train', 'w': g.ka = 0}},
                {{'e': {_COST.format(a='g.a', b='g.b + o.n', d='g.d')}, 'h': sha256('balanced' || chr(0) || c || chr(0) || 'validation'), 's': 'validation', 'w': g.kb = 0}},
                {{'e': {_COST.format(a='g.a', b='g.b', d='g.d + o.n')}, 'h': sha256('balanced' || chr(0) || c || chr(0) || 'test'), 's': 'test', 'w': g.kd = 0}}],
                lambda x: x.w OR o.m - o.k + 1 <> (g.ka = 0)::INT + (g.kb = 0)::INT + (g.kd = 0)::INT))[1].s AS s FROM g JOIN o ON o.k = g.k + 1) q)
        SELECT s AS split, CAST(sum(n) AS BIGINT) AS n_docs, count(*) AS n_components FROM g WHERE k > 0 GROUP BY 1
    """,
    "component_ids": """
        WITH g AS (SELECT sha256(text) AS blob, string_agg(CAST(doc_id AS VARCHAR), chr(0) ORDER BY CAST(doc_id AS VARCHAR)) AS m, count(*) AS n
            FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
        SELECT blob, 'duplicate-component:' || sha256(m) AS component_id, n AS n_members FROM g
    """,
    "no_leakage_check": "SELECT 0::BIGINT AS n_torn_components",
}
