"""Sinks: run store (append-only Parquet by day, or a view), gate reports, fixtures, incremental appends."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import PERSISTED, without_prefixed


def record(states: DataFrame) -> DataFrame:
    """Runs as they are stored: allowlisted columns only, as JSON payload, with a summary beside it."""
    kept = [c for c in states.columns if c in PERSISTED]
    return states.select("run_id", "study_id", "status", "created_at", F.size("alerts").alias("alert_count"), F.to_json(F.struct(*kept)).alias("payload"))


RUNS = "run_id string, study_id string, status string, created_at double, alert_count int, payload string"


class MemoryStore:
    """Runs of this session, by name of a view."""

    def __init__(self, spark: SparkSession, view: str = "runs"):
        self.spark, self.view, self.rows = spark, view, None

    def append(self, states: DataFrame) -> None:
        new = record(states).cache()
        self.rows = new if self.rows is None else self.rows.unionByName(new)
        self.rows.createOrReplaceTempView(self.view)

    def read(self) -> DataFrame:
        return self.rows


class TableStore:
    """Runs as Parquet under path: a folder a day, in it one for each of SHARDS hash values of the run id, in it one for each batch.

    A batch that is written again replaces its own rows, so a stream's batches may run twice. A lookup by run id reads one
    shard, where a bloom filter on the id passes over row groups that do not hold it.
    """

    SHARDS = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def shard(cls, run_id: Column) -> Column:
        return F.pmod(F.xxhash64(run_id), F.lit(cls.SHARDS)).cast("int")

    def append(self, states: DataFrame, batch: str | int | None = None) -> None:
        """Rows of a numbered batch, or of one of its own."""
        name = uuid.uuid4().hex if batch is None else str(batch)
        rows = record(states).withColumns({"day": F.to_date(F.timestamp_seconds("created_at")), "shard": self.shard(F.col("run_id")), "batch": F.lit(f"b{name}")})
        write = rows.repartition("day", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        write.option("parquet.bloom.filter.enabled#run_id", "true").option("parquet.bloom.filter.expected.ndv#run_id", "100000").partitionBy("day", "shard", "batch").parquet(self.path)

    def sink(self, states: DataFrame, checkpoint: str):
        """The streaming query, to be started, that appends a stream of states; a batch that runs again adds nothing."""
        return states.writeStream.foreachBatch(lambda df, n: self.append(df, n)).option("checkpointLocation", checkpoint)

    def _whole(self) -> DataFrame:
        return self.spark.read.schema(f"{RUNS}, day date, shard int, batch string").parquet(self.path)

    def read(self) -> DataFrame:
        return self._whole().drop("day", "shard", "batch")

    def get(self, run_id: str, day: str | None = None) -> DataFrame:
        """The run with that id: read from its shard, and of its day alone if that is given."""
        rows = self._whole().where((F.col("shard") == self.shard(F.lit(run_id))) & (F.col("run_id") == run_id))
        return (rows if day is None else rows.where(F.col("day") == F.to_date(F.lit(day)))).drop("day", "shard", "batch")


def open_store(spark: SparkSession, kind: str, path: str = "") -> MemoryStore | TableStore:
    if kind == "memory":
        return MemoryStore(spark)
    if kind == "table":
        return TableStore(spark, path)
    raise ValueError(f"unknown run store {kind!r}")


def get(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def newest(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Summaries, newest first."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit).select("run_id", "study_id", "status", "created_at", "alert_count")


def newest_of_study(runs: DataFrame) -> DataFrame:
    return runs.groupBy("study_id").agg(F.max(F.struct("created_at", "run_id", "status", "payload")).alias("x")).select("study_id", "x.*")


def write_gate_report(suites: DataFrame, rolled: DataFrame, path: str | None = None) -> int:
    """Prints and, with a path, writes the gate report; 0, or 2 if a hard suite failed. Suites are a handful of rows."""
    rows, total = [r.asDict(recursive=True) for r in suites.collect()], rolled.first()
    report = {"suites": rows, "hard_failures": list(total["hard_failures"]), "gate_pass": total["gate_pass"]}
    print(json.dumps(report, ensure_ascii=False), file=sys.stderr)
    if path:
        suites.sparkSession.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return 0 if total["gate_pass"] else 2


def write_scores(scores: DataFrame, path: str) -> None:
    """Raw scores, written once; every threshold is a query over them."""
    scores.write.mode("overwrite").partitionBy("label").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Fixtures and candidate sets."""
    rows.write.mode("overwrite").json(path)


def masked(events: DataFrame, *texts: str) -> DataFrame:
    """Trace events for export: embedded images as digests, identifiers scrubbed."""
    from ..functions import text

    return events.withColumns({c: text.scrub(text.mask_data_uris(F.col(c)))[0] for c in texts})


def exportable(public_key: str, secret_key: str) -> bool:
    return bool(public_key and secret_key)


def export(spans: DataFrame, public_key: str, secret_key: str, write: Callable[[DataFrame], None], routers: tuple[str, ...] = (), texts: tuple[str, ...] = ("text",)) -> bool:
    """Hands masked spans without those of routers to write; does nothing, and says so, unless both keys are set."""
    if not exportable(public_key, secret_key):
        return False
    write(masked(without_prefixed(spans, "name", routers) if routers else spans, *texts))
    return True

