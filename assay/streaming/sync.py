"""Syncing several landed sources by streams: latest rows by key, and a cursor for each source that advances with every run."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from assay.streaming import ledger

CURSOR = "source string, cursor timestamp, run int, rows long, error string"


class Progress(StreamingQueryListener):
    """Counts the rows and runs of queries by id, and stops one after a number of runs; a run that finds nothing counts."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.runs: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}
        self.error: dict[str, str | None] = {}
        self.limit: dict[str, tuple[int, threading.Event]] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.id), threading.Event())

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + sum(max(s.numInputRows, 0) for s in event.progress.sources)
        self._ran(key)

    def onQueryIdle(self, event) -> None:
        self._ran(str(event.id))

    def _ran(self, key: str) -> None:
        self.runs[key] = self.runs.get(key, 0) + 1
        most, enough = self.limit.get(key, (0, None))
        if enough and self.runs[key] >= most:
            enough.set()

    def onQueryTerminated(self, event) -> None:
        self.error[str(event.id)] = event.exception
        self.ended.setdefault(str(event.id), threading.Event()).set()


def _cursors(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, CURSOR).coalesce(1).write.parquet(f"{path}/cursors/{uuid.uuid4().hex}")


def cursors(spark: SparkSession, path: str) -> DataFrame:
    """The last cursor of each source, with the rows of all its runs."""
    every = spark.read.schema(CURSOR).option("recursiveFileLookup", True).parquet(f"{path}/cursors")
    last = Window.partitionBy("source").orderBy(F.desc("run"), F.desc("cursor"))
    total = F.sum("rows").over(Window.partitionBy("source"))
    return every.withColumn("rows_total", total).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def run(sources: dict[str, DataFrame], path: str, key: str, order: str, number: int) -> None:
    """One run over all sources (streams of one schema each), every one to the end of what is there.

    Each source has a checkpoint and a table of its own. Its cursor becomes the start of the run, also when nothing came; a source that fails keeps its
    cursor, has its error in a row, and does not stop the others.
    """
    spark = next(iter(sources.values())).sparkSession
    began, seen = time.time(), Progress()
    spark.streams.addListener(seen)
    try:
        queries: dict[str, StreamingQuery] = {name: ledger.upserted(s, f"{path}/data/{name}", key, order, f"{path}/at/{name}") for name, s in sources.items()}
        errors = {}
        for name, q in queries.items():
            try:
                q.awaitTermination()
            except Exception as e:  # noqa: BLE001  a source's failure is a row of the cursors
                errors[name] = str(e)[:500]
        for q in queries.values():
            seen.ended.setdefault(str(q.id), threading.Event()).wait(30)
    finally:
        spark.streams.removeListener(seen)
    start = spark.range(1).select(F.timestamp_seconds(F.lit(began)).alias("t")).first().t
    before = {r.source: r.cursor for r in cursors(spark, path).collect()} if errors and number > 1 else {}
    _cursors(spark, path, [(name, before.get(name) if name in errors else start, number, seen.rows.get(str(q.id), 0), errors.get(name)) for name, q in queries.items()])


def polled(stream: DataFrame, path: str, key: str, order: str, *, every: str = "10 seconds", runs: int = 1, timeout: float = 600) -> int:
    """Runs on a processing-time trigger until so many runs are done; the number of rows that came. A run limit of 0 goes on until the timeout (in seconds)."""
    spark, seen, enough = stream.sparkSession, Progress(), threading.Event()
    spark.streams.addListener(seen)
    try:
        q = ledger.upserted(stream, f"{path}/data/polled", key, order, f"{path}/at/polled", processingTime=every)
        seen.limit[str(q.id)] = runs or 1 << 60, enough
        if seen.runs.get(str(q.id), 0) >= runs > 0:
            enough.set()
        until = time.time() + timeout
        while time.time() < until and q.isActive and not enough.wait(0.2):
            pass
        q.stop()
        if q.exception():
            raise q.exception()
        return seen.rows.get(str(q.id), 0)
    finally:
        spark.streams.removeListener(seen)


def latest(spark: SparkSession, path: str, source: str, key: str, order: str) -> DataFrame:
    """The latest row of each key of a source; no row where nothing has come yet."""
    return ledger.latest(spark, f"{path}/data/{source}", key, order)
