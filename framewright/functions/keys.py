"""Comparable forms of identities, digests, splits and absent values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """NFKC of each text; null stays null."""
    known = values.notna()
    if known.any():
        values = values.copy()
        values[known] = [unicodedata.normalize("NFKC", v) for v in values[known]]
    return values


def compatible(col: Column) -> Column:
    """NFKC form; only text outside ASCII is handed to Python."""
    return F.coalesce(nfkc(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def letters_and_digits(col: Column) -> Column:
    """Lower-case letters and digits of the compatibility form, in order.

    Null, blank and "unknown" (any case or width) give null: an absent value
    equals nothing.
    """
    plain = F.regexp_replace(F.lower(compatible(col)), r"[^\p{L}\p{N}]+", "")
    return F.when(~plain.isin("", "unknown"), plain)


def digest(col: Column) -> Column:
    """The 64 hex digits of a SHA-256 in any spelling, else null.

    A leading algorithm name, case, separators and blanks don't count; 64 zeros
    and values that don't hold exactly 64 hex digits are absent.
    """
    bare = F.regexp_replace(F.lower(col), r"sha-?256", "")
    bare = F.regexp_replace(bare, r"[^0-9a-z]+", "")
    return F.when(bare.rlike(r"^[0-9a-f]{64}$") & ~bare.rlike(r"^0+$"), bare)


def split_name(col: Column) -> Column:
    """train, validation, test, or null for no split."""
    word = F.regexp_replace(F.lower(col), r"[^a-z]+", "")
    return (
        F.when(word.startswith("train"), F.lit("train"))
        .when(word.rlike(r"^(val|dev)"), F.lit("validation"))
        .when(word.startswith("test"), F.lit("test"))
    )
