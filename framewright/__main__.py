"""Command line: list and run queries, build a snapshot, export report bundles, inspect archives."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from framewright.operators.selection import TEMPORAL_MODES, Filters
from framewright.plans import catalog
from framewright.plans.snapshot import SplitPolicy, build_snapshot, driver_index, snapshot_of
from framewright.session import build_session, ship_package
from framewright.sources import archives, publish


def _reports(spark, root: str, out: str) -> dict:
    """Sources as CSV, items as JSON lines, credits as Markdown and a summary, in one bundle that appears whole."""
    from framewright.session import load

    sources = catalog.QUERIES["source_records"](spark, root)
    items = load(spark, root, "corpus_items").dropDuplicates(["id"]).select("id", "source_id", "title", "creator_name", "canonical_url")
    named = items.withColumn("source_id", F.coalesce("source_id", F.lit("unresolved")))
    lines = publish.markdown_lines(named, "source_id", "title", "creator_name").orderBy("g", "kind", "m", "line")
    counts = {r["table_name"]: r["n_rows"] for r in catalog.QUERIES["corpus_summary"](spark, root).collect()}
    return publish.bundle(out, {
        "sources.csv": publish.csv_lines(sources, ["source_id"]),
        "inventory.jsonl": publish.jsonl(items, ["id"]),
        "attribution.md": ((r["line"] + "\n").encode() for r in lines.toLocalIterator()),
        "summary.json": [(json.dumps(counts, sort_keys=True, indent=2) + "\n").encode()],
    })


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="framewright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of all queries")
    run = commands.add_parser("run", help="run one query over a folder of tables")
    run.add_argument("name", choices=sorted(catalog.QUERIES))
    run.add_argument("root")
    run.add_argument("--out", help="write Parquet here instead of printing")
    shot = commands.add_parser("snapshot", help="split snapshot of a provenance index as one canonical JSON file")
    shot.add_argument("root")
    shot.add_argument("out")
    shot.add_argument("--test-tables", action="store_true", help="read the test tables as an index")
    shot.add_argument("--minimum-frames", type=int, default=2)
    shot.add_argument("--mode", choices=TEMPORAL_MODES, default="known")
    shot.add_argument("--include", action="append", default=[])
    shot.add_argument("--exclude", action="append", default=[])
    shot.add_argument("--strategy", choices=("hash", "balanced"), default="hash")
    reports = commands.add_parser("reports", help="bundle of reports with sizes and digests")
    reports.add_argument("root")
    reports.add_argument("out")
    listing = commands.add_parser("archives", help="verdict on every ZIP under a folder")
    listing.add_argument("path")
    args = parser.parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    if args.command == "run":
        df = catalog.QUERIES[args.name](spark, args.root)
        df.write.mode("errorifexists").parquet(args.out) if args.out else df.show(50, truncate=80)
    elif args.command == "snapshot":
        filters = Filters(minimum_frames=args.minimum_frames, temporal_mode=args.mode, include_sources=tuple(args.include), exclude_sources=tuple(args.exclude))
        policy = SplitPolicy(strategy=args.strategy)
        made = snapshot_of(spark, driver_index(spark, args.root), filters, policy) if args.test_tables else build_snapshot(spark, args.root, filters, policy)
        if made.leaks():
            raise SystemExit("a component lies in more than one split")
        print(publish.publish(args.out, made.chunks()))
    elif args.command == "reports":
        print(json.dumps(_reports(spark, args.root, args.out), indent=2))
    else:
        members = archives.zip_members(archives.binary_files(spark, args.path, "*.zip"))
        archives.archive_verdicts(members).orderBy("archive").show(200, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
