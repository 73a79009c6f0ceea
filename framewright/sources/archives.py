"""Files as tables: archives and their members, picture headers, manifests, credits, listings, pages and registries."""

from __future__ import annotations

import hashlib
import html.parser
import io
import os
import re
import struct
import tomllib
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bounds an archive must keep."""

    members: int = 100_000
    member_bytes: int = 1 << 30
    total_bytes: int = 8 << 30
    ratio: float = 1000.0


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def member_path(name: str) -> tuple[str | None, str]:
    """(normalized path, fault): NFC, forward slashes, no empty or dot parts; climbing, absolute, drive and NUL names are faults."""
    text = unicodedata.normalize("NFC", name).replace("\\", "/")
    if "\0" in text:
        return None, "nul"
    if text.startswith("/"):
        return None, "absolute"
    if re.match(r"^[A-Za-z]:", text):
        return None, "drive"
    parts = [p for p in text.split("/") if p not in ("", ".")]
    if ".." in parts:
        return None, "traversal"
    return ("/".join(parts), "") if parts else (None, "empty")


_MEMBERS = (
    "archive string, ordinal int, path string, fault string, size_bytes bigint, compressed_bytes bigint, crc32 bigint, method int, "
    "is_directory boolean, is_encrypted boolean, is_link boolean"
)


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _MEMBERS.split(", ")]
    for b in batches:
        rows = []
        for sha, content in zip(b["sha256"], b["content"]):
            try:
                entries = zipfile.ZipFile(io.BytesIO(content)).infolist()
            except (zipfile.BadZipFile, ValueError):
                rows.append((sha, -1, None, "unreadable", 0, 0, 0, 0, False, False, False))
                continue
            for k, e in enumerate(entries):
                path, fault = member_path(e.filename)
                link = (e.external_attr >> 16) & 0o170000 == 0o120000
                rows.append((sha, k, path, fault, e.file_size, e.compress_size, e.CRC, e.compress_type, e.is_dir(), bool(e.flag_bits & 1), link))
        yield pd.DataFrame(rows, columns=columns)


def zip_members(files: DataFrame) -> DataFrame:
    """The central directory of every archive as rows; a broken archive is one row with a fault."""
    return files.select("sha256", "content").mapInPandas(_list_members, _MEMBERS)


def archive_verdicts(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per archive: counts, bytes, and the ordered reasons against it."""
    file = ~F.col("is_directory")
    folded = F.when(F.col("path").isNotNull() & file, F.lower("path"))
    per_name = members.groupBy("archive", folded.alias("_f")).agg(F.count("*").alias("_n"), F.count_distinct("path").alias("_d"))
    names = per_name.where("_f is not null").groupBy("archive").agg(
        F.max(F.col("_n") > F.col("_d")).alias("repeated"), F.max(F.col("_d") > 1).alias("collides"))
    facts = members.groupBy("archive").agg(
        F.count_if(F.col("ordinal") >= 0).alias("n_members"), F.count_if(file & (F.col("ordinal") >= 0)).alias("n_files"),
        F.sum("size_bytes").alias("total_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"),
        F.max("size_bytes").alias("_most"), F.array_sort(F.collect_set(F.when(F.col("fault") != "", F.col("fault")))).alias("_faults"),
        F.max("is_encrypted").alias("_enc"), F.max("is_link").alias("_link"),
    ).join(names, "archive", "left")
    own = F.array_compact(F.array(
        F.when(F.col("n_members") > limits.members, F.lit("too_many_members")), F.when(F.col("_most") > limits.member_bytes, F.lit("member_too_large")),
        F.when(F.col("total_bytes") > limits.total_bytes, F.lit("too_large")),
        F.when(F.col("total_bytes") > F.col("compressed_bytes") * limits.ratio, F.lit("ratio")),
        F.when(F.col("repeated"), F.lit("repeated_path")), F.when(F.col("collides"), F.lit("case_collision")),
        F.when(F.col("_enc"), F.lit("encrypted")), F.when(F.col("_link"), F.lit("link"))))
    return facts.select("archive", "n_members", "n_files", "total_bytes", "compressed_bytes", F.concat("_faults", own).alias("reasons"))


def inventory_rows(members: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(archive_inventories, archive_members) of listed archives; unreadable ones have neither.

    The inventory's digest is taken over the members in order, at most
    ``limits.members`` of them; an archive with more has none.
    """
    listed = members.where("ordinal >= 0")
    line = F.concat_ws("|", F.lpad(F.col("ordinal").cast("string"), 9, "0"), F.coalesce("path", F.lit("")), F.col("size_bytes").cast("string"), F.col("crc32").cast("string"))
    few = listed.where(F.col("ordinal") < limits.members)
    digests = few.groupBy("archive").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("inventory_sha256"))
    totals = listed.groupBy("archive").agg(
        F.count("*").cast("int").alias("member_count"), F.count_if(~F.col("is_directory")).cast("int").alias("file_count"),
        F.sum("size_bytes").alias("total_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"))
    inventories = totals.join(digests, "archive").select(
        F.col("archive").alias("archive_blob_sha256"), "member_count", "file_count", "total_bytes", "compressed_bytes",
        F.when(F.col("member_count") <= limits.members, F.col("inventory_sha256")).alias("inventory_sha256"))
    rows = listed.select(
        F.col("archive").alias("archive_blob_sha256"), "ordinal", F.col("path").alias("normalized_path"), "size_bytes", "compressed_bytes", "crc32",
        F.col("method").alias("compression_method"), F.when(F.col("fault") == "", "listed").otherwise("refused").alias("inspection_status"), F.lit(None).cast("string").alias("extracted_blob_sha256"))
    return inventories, rows


def extracted(files: DataFrame, members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive, ordinal, sha256, size_bytes, content, ok, fault) of the chosen members, sizes and checksums verified.

    ``members`` holds (archive, ordinal) of what to extract, chosen by any
    filter over ``zip_members``; each archive is read where it lies with its own
    short list. No more is unpacked than the limits allow, whatever the
    directory says: a member that goes on beyond them is refused, and so are the
    rest of an archive whose total does, links and encrypted members.
    """
    chosen = members.groupBy("archive").agg(F.array_sort(F.collect_set("ordinal")).alias("wanted"))
    columns = ["archive", "ordinal", "sha256", "size_bytes", "content", "ok", "fault"]

    def taken(archive: zipfile.ZipFile, entry: zipfile.ZipInfo, room: int) -> tuple[bytes | None, str]:
        if entry.flag_bits & 1:
            return None, "encrypted"
        if (entry.external_attr >> 16) & 0o170000 == 0o120000:
            return None, "link"
        most = min(limits.member_bytes, room, int(limits.ratio * max(entry.compress_size, 1)))
        with archive.open(entry) as f:
            data = f.read(most + 1)
        if len(data) > most:
            return None, "beyond_limits"
        if len(data) != entry.file_size or zlib.crc32(data) != entry.CRC:
            return None, "differs"
        return data, ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sha, content, wanted in zip(b["sha256"], b["content"], b["wanted"]):
                room = limits.total_bytes
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    entries = archive.infolist()
                except (zipfile.BadZipFile, ValueError):
                    yield pd.DataFrame([(sha, k, None, 0, None, False, "unreadable") for k in wanted], columns=columns)
                    continue
                for k in wanted:
                    try:
                        data, fault = taken(archive, entries[k], room)
                    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):
                        data, fault = None, "unreadable"
                    except IndexError:
                        data, fault = None, "missing"
                    room -= len(data or b"")
                    digest = hashlib.sha256(data).hexdigest() if data is not None else None
                    yield pd.DataFrame([(sha, k, digest, len(data or b""), data, data is not None, fault)], columns=columns)

    return files.join(chosen, files["sha256"] == chosen["archive"]).select("sha256", "content", "wanted").mapInPandas(
        run, "archive string, ordinal int, sha256 string, size_bytes bigint, content binary, ok boolean, fault string"
    )


def png_facts(content: bytes) -> dict:
    """Size, bit depth, colour type, alpha kind and frame count from the chunks of a PNG; format null if it isn't one."""
    facts = {"format": None, "width": 0, "height": 0, "bit_depth": 0, "alpha": "none", "n_frames": 0, "palette_sha256": None}
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return facts
    at, colour = 8, -1
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            return facts | {"format": None}
        if kind == b"IHDR":
            facts["width"], facts["height"], facts["bit_depth"], colour = struct.unpack(">IIBB", body[:10])
            facts |= {"format": "png", "n_frames": 1, "alpha": "channel" if colour in (4, 6) else "none"}
        elif kind == b"PLTE":
            facts["palette_sha256"] = hashlib.sha256(body).hexdigest()
        elif kind == b"tRNS" and facts["alpha"] == "none":
            facts["alpha"] = "palette" if colour == 3 else "key"
        elif kind == b"acTL":
            facts |= {"format": "apng", "n_frames": struct.unpack(">I", body[:4])[0]}
        at += 12 + size
    return facts


def png_observations(files: DataFrame) -> DataFrame:
    """Header facts of every file; what is not a whole PNG keeps a null format."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"sha256": s} | png_facts(c) for s, c in zip(b["sha256"], b["content"])], columns=["sha256", "format", "width", "height", "bit_depth", "alpha", "n_frames", "palette_sha256"])

    return files.select("sha256", "content").mapInPandas(run, "sha256 string, format string, width bigint, height bigint, bit_depth int, alpha string, n_frames bigint, palette_sha256 string")


MANIFEST = (
    "schema_version int, sequence_count int, sequences array<struct<sequence_id:string,identity_id:string,split:string,action:string,view:string,"
    "direction:string,loop_mode:string,entity_class:string,quality_tier:string,frame_count:int,target_bucket:array<int>,"
    "caption:struct<description:string>,output:struct<format:string,dtype:string,shape:array<int>,relative_path:string,file_sha256:string,"
    "array_content_sha256:string,size_bytes:bigint>,timing:struct<duration_ms:array<double>,phase:array<double>>,"
    "provenance:struct<source_id:string,source_pack_id:string,source_blob_sha256:array<string>>>>"
)


def manifest_clips(spark: SparkSession, path: str, split: str | None = None, sequence_ids: list[str] | None = None) -> DataFrame:
    """The clips of a materialization manifest; a requested clip that is missing or filtered out is an error."""
    clips = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.inline("sequences"))
    if split:
        clips = clips.where(F.col("split") == split)
    if sequence_ids:
        clips = clips.where(F.col("sequence_id").isin(sequence_ids))
        found = {r[0] for r in clips.select("sequence_id").distinct().collect()}
        if missing := sorted(set(sequence_ids) - found):
            raise ValueError(f"requested clips are not there: {missing}")
    return clips


def credits(spark: SparkSession, path: str) -> DataFrame:
    """A credits CSV with a header, byte order mark tolerated; listed fields are split on commas."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    named = raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return named.select("filename", "notes", *[split(F.col(c)).alias(c) for c in ("authors", "licenses", "urls")])


def listing_blocks(df: DataFrame, text: str) -> DataFrame:
    """Rows of a key = value listing whose entries are parted by blank lines, as maps."""
    blocks = df.select(F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), r"\n\s*\n")).alias("block", "_b"))
    lines = F.filter(F.split("_b", "\n"), lambda x: F.contains(x, F.lit(" = ")))
    return blocks.select("block", F.map_from_entries(F.transform(lines, lambda x: F.struct(
        F.trim(F.substring_index(x, " = ", 1)).alias("k"), F.regexp_replace(x, r"^.*? = ", "").alias("v")))).alias("facts")).where(F.size("facts") > 0)


class _Sections(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.heading, self.level, self.link, self.text = [], "", 0, None, ""

    def handle_starttag(self, tag, attrs):
        if re.fullmatch(r"h[1-6]", tag):
            self.level, self.text = int(tag[1]), ""
        elif tag == "a":
            self.link, self.text = dict(attrs).get("href"), ""

    def handle_endtag(self, tag):
        if re.fullmatch(r"h[1-6]", tag):
            self.heading, self.level = " ".join(self.text.split()), 0
        elif tag == "a" and self.link:
            self.rows.append((self.heading, self.link, " ".join(self.text.split())))
            self.link = None

    def handle_data(self, data):
        self.text += data


def page_links(df: DataFrame, key: str, page: str) -> DataFrame:
    """(page_id, ordinal, section, url, label): the links of HTML pages under their nearest heading."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["page_id"], b["page"]):
                parser = _Sections()
                parser.feed(text or "")
                rows += [(k, i, *r) for i, r in enumerate(parser.rows)]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "section", "url", "label"])

    return df.select(F.col(key).cast("string").alias("page_id"), F.col(page).alias("page")).mapInPandas(run, "page_id string, ordinal int, section string, url string, label string")


def key_value_sections(text: str) -> list[tuple[str, int, str, str]]:
    """(section, ordinal, key, value) of a definition file with [sections] and ; comments; keys are lower case."""
    rows, section = [], ""
    for line in text.splitlines():
        line = line.split(";", 1)[0].strip()
        if m := re.fullmatch(r"\[\s*(.*?)\s*\]", line):
            section = m[1].lower()
        elif "=" in line:
            k, v = (x.strip() for x in line.split("=", 1))
            rows.append((section, len(rows), k.lower(), v.strip('"')))
    return rows


def registry(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A [table.name] registry of a TOML file as rows (name, key, value), arrays one row per entry."""
    with open(path, "rb") as f:
        document = tomllib.load(f).get(table, {})
    rows = [
        (name, k, str(x))
        for name, entry in sorted(document.items())
        for k, v in sorted((entry if isinstance(entry, dict) else {"value": entry}).items())
        for x in (v if isinstance(v, list) else [v])
    ]
    return spark.createDataFrame(rows, "name string, key string, value string")


def merged(base: dict, override: dict) -> dict:
    """A configuration with another laid over it, tables merged in depth."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def image_runs(expression: str) -> list[tuple[str, int]]:
    """(image, duration) of ``name[1~4,7].png:100*2``: numbered ranges in either direction keep their zero padding.

    Several brackets count in step and must be of one length. A missing
    duration is 0 and "*n" repeats the whole run.
    """
    m = re.fullmatch(r"(.+?)(?::(\d+))?(?:\*(\d+))?", expression.strip())
    name, duration, times = m[1], int(m[2] or 0), int(m[3] or 1)
    parts = re.split(r"\[([^\]]*)\]", name)
    lists = []
    for spec in parts[1::2]:
        numbers = []
        for piece in spec.split(","):
            a, _, b = piece.strip().partition("~")
            if b:
                step = 1 if int(b) >= int(a) else -1
                numbers += [str(n).zfill(len(a)) for n in range(int(a), int(b) + step, step)]
            else:
                numbers.append(a)
        lists.append(numbers)
    if len({len(x) for x in lists}) > 1:
        raise ValueError(f"brackets of different length in {expression!r}")
    rows = zip(*lists) if lists else [()]
    run = ["".join(p if i % 2 == 0 else row[i // 2] for i, p in enumerate(parts)) for row in (zip(*lists) if lists else [()])]
    return [(image, duration) for _ in range(times) for image in run]


def store_path(root: str, digest: str) -> str:
    """Place of a blob in a store named by content, two levels deep."""
    if not re.fullmatch(r"[0-9a-f]{64}", digest):
        raise ValueError("not a SHA-256 digest")
    return os.path.join(root, "objects", digest[:2], digest[2:4], digest)
