"""Command line: ``python -m plinth scan|lint|find ...`` over source folders."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from plinth.operators.tables import clear_scratch
from plinth.scan import Options, lint, read_project, scan
from plinth.sources.files import outside_root, parse_jsonc, read_sources
from plinth.sources.patterns import find_pattern
from plinth.sources.stores import LISTED, exit_code, report_json, write_report


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="plinth")
    parser.add_argument("command", choices=("scan", "lint", "find"))
    parser.add_argument("roots", nargs="+", help="folders of source files; for find, the pattern first")
    parser.add_argument("--only", default="", help="detectors, comma-separated")
    parser.add_argument("--entry", action="append", default=[], help="a file that is used from outside")
    parser.add_argument("--exclude", action="append", default=[], help="a glob of paths to leave out")
    parser.add_argument("--min-size", type=int, default=Options.min_size)
    parser.add_argument("--max-forward-depth", type=int, default=Options.max_forward_depth)
    parser.add_argument("--config", help="a JSONC file with features, layers, allowed")
    parser.add_argument("--root", help="refuse folders outside of this one")
    parser.add_argument("--out", help="write all findings here as JSON lines")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code: 2 for errors, 1 for findings, else 0."""
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("plinth").getOrCreate()
    roots = args.roots[1:] if args.command == "find" else args.roots
    try:
        files = read_sources(spark, roots, args.exclude)
        if args.root and (far := outside_root(files, args.root)):
            raise ValueError(f"outside of {args.root}: {far}")
        if args.command == "find":
            found = find_pattern(files, args.roots[0])
            for r in found.orderBy("path", "start_off").limit(LISTED).toJSON().collect():
                print(r)
            return exit_code(0, 0)
        if args.command == "lint":
            findings, catalog, detectors, errors = lint(spark, files), spark.createDataFrame([], "code string, cause string"), ["lint"], {}
        else:
            config = parse_jsonc(open(args.config, encoding="utf-8").read()) if args.config else {}
            options = Options(config.get("features"), tuple(filter(None, args.only.split(","))), args.min_size, max_forward_depth=args.max_forward_depth, entry=tuple(args.entry), layers=tuple((x["name"], x["glob"]) for x in config.get("layers", [])), allowed=config.get("allowed"))
            report = scan(spark, files, options, read_project(spark, roots))
            findings, catalog, detectors = report.findings, report.catalog, report.detectors
            errors = {r["path"]: r["message"] for r in report.errors.limit(LISTED).collect()}
        if args.out:
            write_report(findings, args.out)
        print(report_json(findings, catalog, detectors, errors))
        return exit_code(len(errors), findings.limit(1).count())
    except (ValueError, OSError) as e:
        print(f"plinth: {e}", file=sys.stderr)
        return exit_code(1, 0)
    finally:
        clear_scratch(spark)


if __name__ == "__main__":
    sys.exit(main())
