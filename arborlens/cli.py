"""python -m arborlens.cli COMMAND [PATH]: scan, stack, files, framework NAME, deadcode, analyze, json, map. PATH may be a git URL."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import durable
from .functions import text
from .operators import tree, usage
from .plans import analyze, report
from .sources import repo


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="arborlens", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("scan", "stack", "files", "framework", "deadcode", "analyze", "json", "map"):
        p = sub.add_parser(name)
        if name == "framework":
            p.add_argument("name")
        p.add_argument("path", nargs="?", default=".")
        if name in ("analyze", "json"):
            p.add_argument("--time", action="store_true")
        if name == "json":
            p.add_argument("--compact", action="store_true")
        if name == "map":
            p.add_argument("--depth", type=int, default=tree.DEPTH)
    return out


def result(spark: SparkSession, root: str) -> dict:
    """The analysis of one tree; the one row that is collected."""
    row = analyze.analyze(repo.files(spark, root), repo.listing(spark, root)).drop("repo_id").first()
    return row.asDict(recursive=True) if row else analyze.empty()


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """The command's output."""
    began = time.perf_counter()
    root, guard = repo.resolve_input(args.path)
    try:
        root = repo.shared_root(spark, root, guard)
        if args.command == "scan":
            paths = [r["path"] for r in repo.paths(spark, root).orderBy(text.order_key(F.col("path"))).collect()]
            out = "".join(f"{x}\n" for x in [f"{len(paths)} file{'' if len(paths) == 1 else 's'}", *[os.path.join(root, p) for p in paths]])
        elif args.command == "framework":
            paths = [r["path"] for r in usage.files_using(repo.files(spark, root), args.name).collect()]  # the source opens files of the framework's extensions only
            out = report.usage(args.name, [os.path.join(root, p) for p in paths])
        elif args.command == "map":
            label = os.path.basename(os.path.normpath(root)) or "."
            out = tree.render(label, tree.tree_lines(repo.entries(spark, root), max(args.depth, 1)), args.depth)
        else:
            r = result(spark, root)
            out = {"stack": report.stack, "files": report.files, "deadcode": report.dead_code, "analyze": report.full}.get(args.command, lambda r: report.as_json(r, args.compact) + "\n")(r)
    finally:
        if guard:
            guard.cleanup()
        durable.release(spark)
    if getattr(args, "time", False):
        print(f"⏱  Completed in {time.perf_counter() - began:.2f}s", file=sys.stderr)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("arborlens").getOrCreate()
    try:
        print(run(spark, args), end="")
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
