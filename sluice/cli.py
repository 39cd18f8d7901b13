"""Command line: python -m sluice.cli -m MODE -o OUTPUT INPUT..."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .plans.files import MergeError, merge_to_file, profiles_table
from .sources.files import expand_inputs
from .sources.lines import size_of
from .spec import MergeSpec

#: Options that the specification has, with the type of their values.
VALUES = {"mode": str, "chunk": int, "join-type": str, "key": str, "delimiter": str, "pattern": str, "source-encoding": str, "target-encoding": str, "comment-prefix": str, "dedup": str, "dedup-keep": str, "dedup-delimiter": str, "time-format": str, "time-column": int, "time-delimiter": str, "time-pattern": str, "compat": str}
FLAGS = ["recursive", "skip-blank", "skip-comments", "ignore-case", "dedup-ignore-case", "honor-tz"]
SHORT = {"mode": "-m", "delimiter": "-d", "pattern": "-p", "recursive": "-r", "ignore-case": "-i"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sluice", description="Combine text, CSV, log or binary files.")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-o", "--output")
    p.add_argument("--detect", action="store_true", help="print what the files seem to be")
    p.add_argument("--no-header", dest="header", action="store_false", default=None)
    p.add_argument("--include", help="patterns, separated by commas")
    p.add_argument("--exclude", help="patterns, separated by commas")
    p.add_argument("--dedup-columns", metavar="A-B", help="range of columns from 0")
    p.add_argument("-M", "--max-memory", help="taken and ignored: Spark has its own limits")
    p.add_argument("--file-type", help="taken and ignored: files are told by their content")
    p.add_argument("--smart-io", action="store_true", default=None, help="taken and ignored: Spark splits files")
    for name, kind in VALUES.items():
        p.add_argument(*([SHORT[name]] if name in SHORT else []), f"--{name}", type=kind)
    for name in FLAGS:
        p.add_argument(*([SHORT[name]] if name in SHORT else []), f"--{name}", action="store_true", default=None)
    return p


def spec_of(args: argparse.Namespace) -> MergeSpec:
    options = {k: v for k, v in vars(args).items() if v is not None and k not in ("inputs", "output", "detect", "dedup_columns")}
    for name in ("include", "exclude"):
        if name in options:
            options[name] = tuple(x for x in options[name].split(",") if x)
    if args.dedup_columns:
        first, _, last = args.dedup_columns.partition("-")
        options |= {"dedup": "columns", "dedup_first": int(first), "dedup_last": int(last) if last else -1}
    return MergeSpec.from_options(options)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sluice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        spec = spec_of(args)
        if args.detect:
            for row in profiles_table(spark, expand_inputs(args.inputs, spec.recursive, spec.pattern, spark=spark), spec.compat).collect():
                print(", ".join(f"{k}: {v}" for k, v in row.asDict().items()))
            return 0
        if not args.output:
            raise ValueError("an output is needed")
        began = time.time()
        inputs = expand_inputs(args.inputs, spec.recursive, spec.pattern, args.output, spark)
        read = sum(size_of(spark, p) for p in inputs)
        counts = {"n_files": len(inputs), "n_bytes_read": read} | merge_to_file(spark, args.inputs, spec, args.output)
        took = time.time() - began
        print(", ".join(f"{k}: {v}" for k, v in counts.items()) + f", seconds: {took:.1f}, MB a second: {read / 1e6 / took:.1f}")
        return 0
    except (ValueError, MergeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
