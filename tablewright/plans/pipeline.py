"""The whole programme over one file, stage by stage, with a record of what ran."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

from ..operators import analyze, audit, drift, learn, profile, repair, validate
from ..sources import files
from ..sources.stores import Lineage, Registry


class Status(Enum):
    PENDING = "PENDING"
    COMPLETED = "COMPLETED"
    FAILED = "FAILED"
    SKIPPED = "SKIPPED"
    PARTIAL = "PARTIALLY_COMPLETED"


@dataclass
class StageResult:
    name: str
    status: Status = Status.PENDING
    seconds: float = 0.0
    detail: str = ""


@dataclass
class Context:
    spark: SparkSession
    path: str
    target: str | None = None
    reference: str | None = None
    output: str | None = None
    df: DataFrame | None = None
    original: DataFrame | None = None
    results: dict = field(default_factory=dict)
    lineage: Lineage | None = None
    registry: Registry | None = None


class Skip(Exception):
    """A stage that does not apply; the text says why."""


def ingestion(c: Context) -> str:
    c.df, meta = files.load(c.spark, c.path)
    c.original = c.df
    c.results["metadata"] = vars(meta)
    c.results["summary"] = analyze.analyze(c.df)
    if c.registry:
        c.results["dataset_id"] = c.registry.register(meta.name, c.path, meta.rows, len(meta.columns), meta.sha256)
    return f"{meta.rows} rows, {len(meta.columns)} columns, {len(meta.actions)} cleaning steps"


def validation(c: Context) -> str:
    v = validate.validate(c.df, c.target)
    c.results["validation"] = v
    return f"score {v.score}"


def drift_stage(c: Context) -> str:
    if not c.reference:
        raise Skip("no reference table")
    found = drift.detect(files.load(c.spark, c.reference)[0], c.original)
    c.results["drift"] = found
    return found.status


def profiling(c: Context) -> str:
    c.results["profile"] = [r.asDict() for r in profile.column_stats(c.df).orderBy("position").collect()]
    return f"{len(c.results['profile'])} columns"


def quality(c: Context) -> str:
    c.results["findings"] = audit.find_problems(c.df, c.target)
    return f"{len(c.results['findings'])} findings"


def health(c: Context, key: str = "health") -> str:
    c.results[key] = audit.health(c.df, c.target)
    return f"{c.results[key].overall} ({c.results[key].grade})"


def repairing(c: Context) -> str:
    worker = repair.Repairer(c.df)
    done = worker.auto_repair(c.target)
    c.df = worker.df
    c.results["repair"], c.results["manifest"] = done, worker.manifest(c.target)
    if c.output:
        files.save(c.df, f"{c.output}/repaired.parquet")
    return f"{done.rows_before} to {done.rows_after} rows, {len(done.imputed)} columns imputed"


def health_after(c: Context) -> str:
    if "repair" not in c.results:
        raise Skip("nothing was repaired")
    return health(c, "health_after")


def training(c: Context) -> str:
    if not c.target:
        raise Skip("no target column")
    if c.target not in c.df.columns:
        raise Skip(f"no column '{c.target}'")
    if c.df.limit(learn.LEAST_ROWS).count() < learn.LEAST_ROWS:
        raise Skip(f"fewer than {learn.LEAST_ROWS} rows")
    c.results["model"] = learn.train(c.df, c.target)
    return f"{c.results['model'].name}: {c.results['model'].metrics}"


def evaluation(c: Context) -> str:
    if "model" not in c.results:
        raise Skip("no model")
    curve = learn.robustness(c.df, c.target, "noise")
    c.results["robustness"] = [r.asDict() for r in curve.collect()]
    c.results["elasticity"] = learn.elasticity(curve)
    return f"elasticity {c.results['elasticity']:.4f}"


def explainability(c: Context) -> str:
    if "model" not in c.results:
        raise Skip("no model")
    c.results["importance"] = [r.asDict() for r in learn.permutation_importance(c.results["model"], repeats=5).collect()]
    return f"{len(c.results['importance'])} features"


def reporting(c: Context) -> str:
    if not c.output:
        raise Skip("no output folder")
    from .report import write_reports

    return ", ".join(write_reports(c.results, c.output))


STAGES = [("ingestion", ingestion), ("validation", validation), ("drift", drift_stage), ("profiling", profiling), ("quality", quality), ("health", health), ("repair", repairing), ("health_after", health_after), ("training", training), ("evaluation", evaluation), ("explainability", explainability), ("reporting", reporting)]
CRITICAL = {"ingestion"}


def run_pipeline(context: Context, stages=None) -> tuple[Status, list[StageResult]]:
    """Run the stages in order; only a failed critical stage ends the run."""
    done: list[StageResult] = []
    for name, stage in stages or STAGES:
        result, began = StageResult(name), time.perf_counter()
        try:
            result.detail, result.status = stage(context), Status.COMPLETED
        except Skip as reason:
            result.detail, result.status = str(reason), Status.SKIPPED
        except Exception as error:  # noqa: BLE001  a stage's failure is part of the result
            result.detail, result.status = f"{type(error).__name__}: {error}", Status.FAILED
        result.seconds = round(time.perf_counter() - began, 3)
        done.append(result)
        if context.lineage:
            context.lineage.record(name, result.detail, result.status.value)
        if result.status is Status.FAILED and name in CRITICAL:
            return Status.FAILED, done
    ran = [r for r in done if r.status is not Status.SKIPPED]
    failed = [r for r in ran if r.status is Status.FAILED]
    return (Status.COMPLETED if not failed else Status.FAILED if len(failed) == len(ran) else Status.PARTIAL), done
