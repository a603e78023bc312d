"""Command lines: `slice` cuts a file by time, `profiles` counts several ranges of one file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from timberline.errors import SpecError
from timberline.plans import runs
from timberline.plans.config import SliceConfig, profiles_from_json
from timberline.sources.reports import profile_report, stats_report
from timberline.sources.sinks import FORMATS, OutputRouter


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="timberline")
    sub = top.add_subparsers(dest="command", required=True)
    cut = sub.add_parser("slice")
    cut.add_argument("logfile")
    cut.add_argument("--start")
    cut.add_argument("--end")
    cut.add_argument("--format", default="plain", choices=sorted(FORMATS))
    cut.add_argument("--time-format", action="append")
    cut.add_argument("--output")
    many = sub.add_parser("profiles")
    many.add_argument("logfile")
    many.add_argument("profiles")
    many.add_argument("--format", default="text", choices=["text", "json"])
    many.add_argument("--output")
    return top


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: a bound, profile or file cannot be used; 2: arguments (argparse)."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if args.command == "slice":
            config = SliceConfig(args.logfile, args.start, args.end, tuple(args.time_format or ()), args.format, args.output)
            router = OutputRouter(args.output, args.output is None, args.format).open()
            print(stats_report(runs.run(spark, config, router)), file=sys.stderr)
            return 0
        text = profile_report(runs.run_profiles(spark, args.logfile, profiles_from_json(args.profiles)), args.format)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as out:
                out.write(text + "\n")
        else:
            print(text)
        return 0
    except SpecError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # the reader's complaints about paths
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"error: no such file: {args.logfile}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
