"""Labels, licences, addresses, captions and other text facts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def nfc_trimmed(values: pd.Series) -> pd.Series:
    """NFC form without outer blanks."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v.strip()))


def ascii_form(col: Column) -> Column:
    """Compatibility decomposition reduced to ASCII; ASCII text never leaves the JVM."""
    return F.coalesce(_decomposed(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def slug(col: Column) -> Column:
    """Lower-case ASCII letters and digits, all else turned into single inner underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_form(col)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def present(col: Column) -> Column:
    """The trimmed text, null when nothing is left: blank counts as missing."""
    trimmed = F.trim(col)
    return F.when(trimmed != "", trimmed)


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[present(c) for c in cols])


def license_label(expression: Column, raw: Column) -> Column:
    """The licence expression, else the raw licence line."""
    return first_present(expression, raw)


# Licence texts with a settled meaning, as lower-case patterns.
NON_COMMERCIAL = r"(^|[^a-z])nc([^a-z]|$)|non-?commercial"
PUBLIC_DOMAIN = r"cc0|public domain|unlicense"
OPEN = r"cc-?by|apache|(^|[^a-z])mit([^a-z]|$)|gpl|bsd|ofl"


def rights_status(label: Column) -> Column:
    """unknown, restricted (non-commercial), public_domain, open or other."""
    text = F.lower(label)
    return (
        F.when(label.isNull(), "unknown")
        .when(text.rlike(NON_COMMERCIAL), "restricted")
        .when(text.rlike(PUBLIC_DOMAIN), "public_domain")
        .when(text.rlike(OPEN), "open")
        .otherwise("other")
    )


def url_references(text: Column) -> Column:
    """Distinct addresses in a text in order of appearance, closing punctuation cut off."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def humanized(identity: Column) -> Column:
    """The readable end of an identifier: leaf, camel case and acronyms opened, picture extension dropped, lower-case words; "unknown subject" if none are left."""
    leaf = F.regexp_extract(identity, r"([^:/\\]*)$", 1)
    opened = F.regexp_replace(F.regexp_replace(leaf, r"(?<=[a-z0-9])(?=[A-Z])", " "), r"(?<=[A-Z])(?=[A-Z][a-z])", " ")
    bare = F.regexp_replace(opened, r"(?i)\.(?:png|gif|webp|apng|jpg|jpeg)$", "")
    words = F.lower(F.trim(F.regexp_replace(bare, r"[^0-9A-Za-z]+", " ")))
    return F.when(words == "", "unknown subject").otherwise(words)


def clauses(*parts: tuple[str, Column]) -> Column:
    """"label value" clauses joined by commas; missing and unknown values say nothing."""
    kept = [
        F.when(present(v).isNotNull() & (F.lower(F.trim(v)) != "unknown"), F.concat(F.lit(label), F.trim(v)))
        for label, v in parts
    ]
    return F.concat_ws(", ", *kept)


def budgeted_words(parts: Column, most: int) -> Column:
    """Phrases of an array kept in order while the words fit a budget, joined by "; ".

    A phrase that is too long is skipped, not the end: a later shorter one may
    still fit. Null and blank phrases, and those that without regard to case
    stand in a kept one, are dropped; blanks inside are collapsed.
    """
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))
    plain = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p.isNotNull() & (p != ""))

    def step(state: Column, phrase: Column) -> Column:
        words = F.size(F.split(phrase, " "))
        fits = (state["used"] + words <= most) & ~F.exists(state["kept"], lambda k: F.contains(F.lower(k), F.lower(phrase)))
        return F.when(
            fits, F.struct(F.array_append(state["kept"], phrase).alias("kept"), (state["used"] + words).alias("used"))
        ).otherwise(state)

    return F.aggregate(plain, start, step, lambda s: F.array_join(s["kept"], "; "))


def leaks_label(label: Column, caption: Column, least: int = 4) -> Column:
    """Whether a caption gives a label away: the label has at least ``least`` letters and stands in the text."""
    bare = F.lower(F.trim(label))
    return F.coalesce((F.length(bare) >= least) & F.contains(F.lower(caption), bare), F.lit(False))


def normalized_label(df: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """``df`` with (label, confidence, method) of a raw label against (name, canonical) pairs.

    missing 0.0 (null or empty), exact 1.0 (the canonical name), alias 0.98
    (another name), embedded_token 0.85 (the longest name standing in the label
    as whole words, of equally long ones the first), unmapped 0.0. Names are
    compared as slugs. Distinct labels are matched, not rows; the embedded names
    of a label are looked up word run by word run, up to the words of the
    longest name, so there is no cross join.
    """
    key = slug(F.col(column))
    names = (
        vocabulary.select(slug(F.col("name")).alias("_name"), slug(F.col("canonical")).alias("_canonical"))
        .where("_name <> ''")
        .groupBy("_name").agg(F.min("_canonical").alias("_canonical"))
    )
    keyed = df.withColumn("_key", key)
    distinct = keyed.where("_key <> ''").select("_key").distinct()
    words = F.split("_key", "_")
    most = names.agg(F.max(F.size(F.split("_name", "_")))).first()[0] or 1
    runs = distinct.select(
        "_key",
        F.explode(F.array_distinct(F.flatten(F.transform(
            F.sequence(F.lit(1), F.size(words)),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - i + 1)),
                lambda n: F.array_join(F.slice(words, i, n), "_"),
            ),
        )))).alias("_name"),
    )
    best = (
        runs.join(names, "_name")
        .withColumn("_whole", F.col("_name") == F.col("_key"))
        .groupBy("_key")
        .agg(F.min_by(F.struct("_canonical", "_name", "_whole"), F.struct(-F.length("_name"), "_name")).alias("_hit"))
        .select(
            "_key",
            F.col("_hit._canonical").alias("_label"),
            F.when(F.col("_hit._whole") & (F.col("_hit._name") == F.col("_hit._canonical")), "exact")
            .when(F.col("_hit._whole"), "alias").otherwise("embedded_token").alias("_method"),
        )
    )
    method = F.when(F.coalesce(F.col(column), F.lit("")) == "", "missing").otherwise(F.coalesce("_method", F.lit("unmapped")))
    confidence = F.create_map(*[F.lit(x) for kv in {"missing": 0.0, "exact": 1.0, "alias": 0.98, "embedded_token": 0.85, "unmapped": 0.0}.items() for x in kv])
    return (
        keyed.join(best, "_key", "left")
        .withColumn("method", method)
        .withColumn("label", F.col("_label"))
        .withColumn("confidence", confidence[F.col("method")])
        .drop("_key", "_label", "_method")
    )


def token_ids(text: Column, most: int) -> Column:
    """Byte token ids of a text: 1, then each UTF-8 byte + 3 of its trimmed NFC form, then 2, padded with 0 to ``most`` ids.

    Too long a text is cut between characters, never inside one. A blank text
    gives null. ``token_mask`` tells ids from padding.
    """
    room = most - 2

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            held = b"" if v is None else unicodedata.normalize("NFC", v.strip()).encode()
            if len(held) > room:
                held = held[:room].decode(errors="ignore").encode()
            out.append([1, *[x + 3 for x in held], 2, *[0] * (room - len(held))] if held else None)
        return pd.Series(out)

    return ids(text)


def token_mask(ids: Column) -> Column:
    """Which ids of a padded row count."""
    return F.transform(ids, lambda i: i != 0)
