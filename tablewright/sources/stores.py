"""Dataset versions and lineage events as append-only Parquet tables."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import objects

REGISTRY = "dataset_id string, name string, version_group string, version int, parent_id string, path string, rows long, columns int, sha256 string, deleted boolean, extra string, registered_at string"
RUNS = "run_id string, model string, params map<string,string>, metrics map<string,double>, artifacts map<string,string>, logged_at string"
EVENTS = "run_id string, dataset_id string, dataset_name string, sequence int, stage string, event_type string, summary string, column string, detail string, recorded_at string"


#: A version, or a year that a month and a day may follow, after a line or an underscore at a name's end.
VERSION, DATED = r"v?\d+(\.\d+)*", r"\d{4}([_-]?\d{2}){0,2}"


def version_group(name: str) -> str:
    """A file's name without extension, version or date at its end."""
    stem = re.split(r"[/\\]", name)[-1].rsplit(".", 1)[0]
    return re.sub(rf"[_-]({VERSION}|{DATED})$", "", stem, flags=re.IGNORECASE) or name


class _Table:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)


class Registry(_Table):
    """Registered tables; the last row of an id counts, so changes and deletions are added too.

    Each change is a file of its own, numbered on from the last one.  A number is
    given once: who finds it taken reads what others have written and tries the
    next one, so several writers at once get different versions.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, REGISTRY)
        self.log = f"{path.rstrip('/')}/_commits"

    def commits(self) -> list[str]:
        return [n for n in objects.names(self.spark, self.log) if n.endswith(".json") and not n.startswith(".")]

    def rows(self, commits: list[str] | None = None) -> DataFrame:
        """All rows of the given commits (of all, if none are given), with ``commit``, the name of each."""
        held = self.commits() if commits is None else commits
        if not held:
            return self.spark.createDataFrame([], REGISTRY + ", commit string")
        return self.spark.read.schema(REGISTRY).json([f"{self.log}/{n}" for n in held]).withColumn("commit", F.col("_metadata.file_name"))

    def current(self, commits: list[str] | None = None) -> DataFrame:
        last = self.rows(commits).groupBy("dataset_id").agg(F.max_by(F.struct("*"), "commit").alias("r"))
        return last.select("r.*").where("NOT deleted").drop("commit")

    def _commit(self, change) -> tuple:
        """Add the row that ``change`` makes of the rows so far; made anew if another writer comes first."""
        while True:
            held = self.commits()
            row = change(self.current(held))
            number = int(held[-1].removesuffix(".json")) + 1 if held else 0
            text = json.dumps(dict(zip([f.split()[0] for f in REGISTRY.split(", ")], row)))
            if objects.put_if_absent(self.spark, f"{self.log}/{number:020d}.json", text):
                return row

    def register(self, name: str, path: str, rows: int, columns: int, sha256: str, **extra) -> str:
        group, dataset_id = version_group(name), uuid.uuid4().hex

        def change(known: DataFrame) -> tuple:
            latest = known.where(F.col("version_group") == group).orderBy(F.desc("version")).first()
            return dataset_id, name, group, latest.version + 1 if latest else 1, latest.dataset_id if latest else None, path, rows, columns, sha256, False, json.dumps(extra), datetime.now(timezone.utc).isoformat()

        self._commit(change)
        return dataset_id

    def get(self, dataset_id: str):
        return self.current().where(F.col("dataset_id") == dataset_id).first()

    def versions(self, group: str) -> DataFrame:
        return self.current().where(F.col("version_group") == group).orderBy("version")

    def latest(self, group: str):
        return self.versions(group).orderBy(F.desc("version")).first()

    def version(self, group: str, number: int):
        return self.versions(group).where(F.col("version") == number).first()

    def groups(self) -> DataFrame:
        return self.current().groupBy("version_group").agg(F.count("*").alias("versions"), F.max("version").alias("latest"))

    def update(self, dataset_id: str, **changes) -> None:
        def change(known: DataFrame) -> tuple:
            held = known.where(F.col("dataset_id") == dataset_id).first()
            if held is None:
                raise KeyError(dataset_id)
            return tuple((held.asDict() | changes | {"registered_at": datetime.now(timezone.utc).isoformat()}).values())

        self._commit(change)

    def delete(self, dataset_id: str) -> None:
        self.update(dataset_id, deleted=True)

    def count(self) -> int:
        return self.current().count()


class Lineage(_Table):
    """What was done to a table, step by step."""

    def __init__(self, spark: SparkSession, path: str, run_id: str | None = None, dataset_id: str | None = None, dataset_name: str | None = None):
        super().__init__(spark, path, EVENTS)
        self.run_id, self.dataset_id, self.dataset_name = run_id or uuid.uuid4().hex, dataset_id, dataset_name
        # A run that is known goes on where it stopped.
        self.sequence = self.trace().agg(F.max("sequence")).first()[0] or 0 if run_id else 0

    def record(self, stage: str, summary: str, event_type: str = "stage", column: str | None = None, detail: dict | None = None) -> None:
        self.record_many([(stage, summary, event_type, column, detail)])

    def record_many(self, events: list[tuple]) -> None:
        rows = []
        for stage, summary, event_type, column, detail in events:
            self.sequence += 1
            rows.append((self.run_id, self.dataset_id, self.dataset_name, self.sequence, stage, event_type, summary, column, json.dumps(detail, default=str) if detail else None, datetime.now(timezone.utc).isoformat()))
        self.append(rows)

    def trace(self, run_id: str | None = None) -> DataFrame:
        return self.rows().where(F.col("run_id") == (run_id or self.run_id)).orderBy("sequence")

    def trace_for_dataset(self, dataset_id: str) -> DataFrame:
        latest = self.rows().where(F.col("dataset_id") == dataset_id).agg(F.max_by("run_id", "recorded_at")).first()[0]
        return self.trace(latest) if latest else self.rows().limit(0)

    def list_runs(self, limit: int = 50) -> DataFrame:
        return runs_of(self.rows()).orderBy(F.desc("last")).limit(limit)


class RunLog(_Table):
    """Training runs with their parameters, metrics and the places of their files."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, RUNS)

    def log(self, model: str, params: dict, metrics: dict, artifacts: dict[str, str] | None = None) -> str:
        """Append a run; metrics that are no numbers are left out."""
        run_id = uuid.uuid4().hex
        numbers = {k: float(v) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        self.append([(run_id, model, {k: str(v) for k, v in params.items()}, numbers, artifacts or {}, datetime.now(timezone.utc).isoformat())])
        return run_id

    def best(self, metric: str, largest: bool = True):
        """The run with the best value of a metric; of equal ones the first."""
        value = F.col("metrics")[metric]
        return self.rows().where(value.isNotNull()).orderBy(value.desc() if largest else value, "logged_at").first()


def runs_of(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.first("dataset_name").alias("dataset_name"), F.count("*").alias("events"), F.max("recorded_at").alias("last"))


def stage_summary(events: DataFrame) -> DataFrame:
    """stage, its events, the columns it touched, and its first step, for each run and stage."""
    return events.groupBy("run_id", "stage").agg(F.count("*").alias("events"), F.array_sort(F.collect_set("column")).alias("columns"), F.min("sequence").alias("first"))


def column_history(events: DataFrame, column: str) -> DataFrame:
    return events.where(F.col("column") == column).orderBy("run_id", "sequence")


def numbered_versions(rows: DataFrame, group: str, order: str, identity: str) -> DataFrame:
    """version and parent of each row of a group, in an order."""
    w = Window.partitionBy(group).orderBy(order, identity)
    return rows.withColumn("version", F.row_number().over(w)).withColumn("parent", F.lag(identity).over(w))
