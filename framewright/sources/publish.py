"""Sinks with stable bytes: canonical JSON lines, CSV, Markdown, bundles with hashes, all published whole or not at all."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import os
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.hashing import canonical_text


def require_capacity(folder: str, bytes_needed: int, floor: int = 1 << 30) -> None:
    """Refuse a write that would leave less than ``floor`` bytes free."""
    free = shutil.disk_usage(folder).free
    if free - bytes_needed < floor:
        raise OSError(f"{bytes_needed} bytes would leave less than {floor} of {free} free")


def publish(path: str, chunks: Iterable[bytes], overwrite: bool = False) -> str:
    """Write a file through a temporary one beside it and return its SHA-256; an existing file is not replaced unless asked."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    digest = hashlib.sha256()
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".publish-")
    try:
        with os.fdopen(handle, "wb") as f:
            for chunk in chunks:
                digest.update(chunk)
                f.write(chunk)
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(temporary, path)
        else:
            os.link(temporary, path)  # fails if it exists
            os.unlink(temporary)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
    return digest.hexdigest()


def put(root: str, data: bytes) -> str:
    """Store bytes under their own digest; equal bytes are stored once."""
    from framewright.sources.archives import store_path

    digest = hashlib.sha256(data).hexdigest()
    path = store_path(root, digest)
    if not os.path.exists(path):
        try:
            publish(path, [data])
        except FileExistsError:
            pass
    return digest


def rows_in_order(df: DataFrame, order: list[str]) -> Iterable[dict]:
    """Rows one partition at a time in a total order; the driver holds a partition, never the table."""
    return (r.asDict(recursive=True) for r in df.orderBy(*order).toLocalIterator())


def jsonl(df: DataFrame, order: list[str]) -> Iterable[bytes]:
    for row in rows_in_order(df, order):
        yield (canonical_text(row) + "\n").encode()


def csv_lines(df: DataFrame, order: list[str]) -> Iterable[bytes]:
    """CSV with the frame's columns in order, line feeds, and arrays and structs as canonical JSON."""
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    writer.writerow(df.columns)
    for row in rows_in_order(df, order):
        writer.writerow(["" if v is None else canonical_text(v) if isinstance(v, dict | list) else v for v in row.values()])
        if buffer.tell() > 1 << 16:
            yield buffer.getvalue().encode()
            buffer.seek(0)
            buffer.truncate()
    yield buffer.getvalue().encode()


def jsonl_gz(df: DataFrame, order: list[str]) -> Iterable[bytes]:
    """Compressed JSON lines in pieces, without name or time, so equal rows give equal bytes; the driver holds a piece at a time."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0) as f:
        for line in jsonl(df, order):
            f.write(line)
            if out.tell() > 1 << 16:
                yield out.getvalue()
                out.seek(0)
                out.truncate()
    yield out.getvalue()


# Characters with a meaning in Markdown text.
MARKDOWN = r"([\\`*_{}\[\]<>()#+!|~-])"


def markdown_lines(df: DataFrame, group: str, member: str, detail: str) -> DataFrame:
    """(group, kind, member, line): a heading per group and a list entry per member, escaped."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("unknown")), r"\s+", " "), MARKDOWN, r"\\$1")
    heads = df.select(F.col(group).alias("g"), F.lit(0).alias("kind"), F.lit("").alias("m"), F.concat(F.lit("## "), safe(F.col(group))).alias("line")).distinct()
    entries = df.select(F.col(group).alias("g"), F.lit(1).alias("kind"), F.col(member).alias("m"), F.concat(F.lit("- "), safe(F.col(member)), F.lit(": "), safe(F.col(detail))).alias("line"))
    return heads.unionByName(entries)


def bundle(folder: str, files: dict[str, Iterable[bytes]]) -> dict:
    """Publish several files and a manifest of their sizes and digests as one directory that appears whole."""
    if os.path.exists(folder):
        raise FileExistsError(folder)
    parent = os.path.dirname(os.path.abspath(folder))
    os.makedirs(parent, exist_ok=True)
    staged = tempfile.mkdtemp(dir=parent, prefix=".bundle-")
    try:
        entries = []
        for name, chunks in sorted(files.items()):
            digest = publish(os.path.join(staged, name), chunks)
            entries.append({"name": name, "sha256": digest, "size_bytes": os.path.getsize(os.path.join(staged, name))})
        manifest = {"files": entries}
        publish(os.path.join(staged, "manifest.json"), [(json.dumps(manifest, sort_keys=True, indent=2) + "\n").encode()])
        os.rename(staged, folder)
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        raise
    return manifest


def write_versioned(df: DataFrame, root: str, table: str, version: str) -> str:
    """Write a table version that nothing may replace."""
    path = f"{root}/{version}/{table}.parquet"
    df.write.mode("errorifexists").parquet(path)
    return path
