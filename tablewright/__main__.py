"""Command line: run, drift, compare, lineage, explain."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import compare, drift, learn
from .plans.pipeline import Context, Status, run_pipeline
from .plans.report import plain
from .sources import files
from .sources.errors import IngestionError
from .sources.stores import Lineage, Registry

CODES = {Status.COMPLETED: 0, Status.PARTIAL: 1, Status.FAILED: 2}
BAD_USAGE, DRIFTED = 3, 4


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tablewright")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("path")
    for name in ("--target", "--reference", "--output", "--registry", "--lineage"):
        run.add_argument(name)
    two = sub.add_parser("drift")
    two.add_argument("reference")
    two.add_argument("current")
    two.add_argument("--fail-on", choices=["WARNING", "CRITICAL"])
    two = sub.add_parser("compare")
    two.add_argument("left")
    two.add_argument("right")
    two.add_argument("--target")
    events = sub.add_parser("lineage")
    events.add_argument("store")
    events.add_argument("--run")
    why = sub.add_parser("explain")
    why.add_argument("path")
    why.add_argument("target")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(arguments)
    except SystemExit as stop:
        return 0 if stop.code == 0 else BAD_USAGE
    spark = spark or SparkSession.builder.appName("tablewright").getOrCreate()
    show = lambda x: print(json.dumps(plain(x), indent=2, default=str))
    try:
        if a.command == "run":
            context = Context(spark, a.path, a.target, a.reference, a.output, registry=Registry(spark, a.registry) if a.registry else None, lineage=Lineage(spark, a.lineage) if a.lineage else None)
            status, stages = run_pipeline(context)
            show({"status": status.value, "stages": [{"name": s.name, "status": s.status.value, "seconds": s.seconds, "detail": s.detail} for s in stages]})
            return CODES[status]
        if a.command == "drift":
            found = drift.detect(files.load(spark, a.reference)[0], files.load(spark, a.current)[0])
            show(found)
            worse = {"WARNING": ("WARNING", "CRITICAL"), "CRITICAL": ("CRITICAL",)}
            return DRIFTED if a.fail_on and found.status in worse[a.fail_on] else 0
        if a.command == "compare":
            show(compare.compare(files.load(spark, a.left)[0], files.load(spark, a.right)[0], a.target))
        elif a.command == "lineage":
            store = Lineage(spark, a.store)
            (store.trace(a.run) if a.run else store.list_runs()).show(1000, truncate=False)
        else:
            model = learn.train(files.load(spark, a.path)[0], a.target)
            show([r.asDict() for r in learn.permutation_importance(model, repeats=5).collect()])
        return 0
    except IngestionError as error:
        print(error, file=sys.stderr)
        return BAD_USAGE


if __name__ == "__main__":
    sys.exit(main())
