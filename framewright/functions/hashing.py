"""Content hashes, derived identifiers and deterministic split draws."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def derived_id(prefix: str, *parts: Column, digits: int = 32) -> Column:
    """prefix + leading hex digits of the SHA-256 of the parts joined by a zero byte; a null part is left out."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(chr(0), *parts), 256), 1, digits))


def member_hash(members: Column, prefix: str = "") -> Column:
    """Hash of a set of identifiers: sorted by bytes, joined by a zero byte."""
    return F.concat(F.lit(prefix), F.sha2(F.array_join(F.array_sort(members), chr(0)), 256))


def hash_fraction(seed: str, key: Column) -> Column:
    """First eight digest bytes of seed, zero byte and key as a decimal below 2^64."""
    leading = F.substring(F.sha2(F.concat(F.lit(seed), F.lit(chr(0)), key), 256), 1, 16)
    return F.conv(leading, 16, 10).cast("decimal(20,0)")


def hash_split(seed: str, key: Column, ratios: dict[str, float]) -> Column:
    """The split whose cumulative ratio first exceeds the key's fraction; the last split takes the rest."""
    at, total, out = hash_fraction(seed, key), 0.0, None
    *head, last = ratios
    for name in head:
        total += ratios[name]
        bound = F.lit(str(int(total * 2**64))).cast("decimal(20,0)")
        out = F.when(at < bound, name) if out is None else out.when(at < bound, name)
    return out.otherwise(last) if out is not None else F.lit(last)


def bucket_split(key: Column, buckets: int, digits: int, bounds: list[tuple[int, str]], last: str) -> Column:
    """Split by the leading hex digits of the key's SHA-256 modulo ``buckets``."""
    leading = F.conv(F.substring(F.sha2(key, 256), 1, digits), 16, 10).cast("decimal(20,0)")
    bucket = (leading % buckets).cast("int")
    out = None
    for bound, name in bounds:
        out = F.when(bucket < bound, name) if out is None else out.when(bucket < bound, name)
    return out.otherwise(last)


def array_hash(dtype: Column, shape: Column, data: Column) -> Column:
    """Hash of an array: element type, shape joined by x, then the bytes in row order, parted by zero bytes."""
    header = F.concat(dtype, F.lit(chr(0)), F.array_join(F.transform(shape, lambda d: d.cast("string")), "x"), F.lit(chr(0)))
    return F.sha2(F.concat(F.encode(header, "UTF-8"), data), 256)


def canonical_text(value: object) -> str:
    """JSON with sorted keys, no blanks, and text outside ASCII kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null and broken JSON give null."""

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else canonical_text(json.loads(v))
        except ValueError:
            return None

    return values.map(one)


@F.pandas_udf(T.StringType())
def canonical_sha256(values: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON texts."""

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else hashlib.sha256(canonical_text(json.loads(v)).encode()).hexdigest()
        except ValueError:
            return None

    return values.map(one)


def decoded_json(col: Column) -> Column:
    """(valid, document): a document that doesn't parse is kept raw and marked, never an error."""
    parsed = F.try_parse_json(col)
    return F.struct(parsed.isNotNull().alias("valid"), parsed.alias("document"), F.when(parsed.isNull(), col).alias("raw"))
