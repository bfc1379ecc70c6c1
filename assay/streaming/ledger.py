"""Streams over the ledger: healing per fingerprint, append without repeats, headline metrics by time, export upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEQUENCE = "fingerprint long, first_blocked long, latest_blocked long, healed long, blocked_attempts long"
STATE = "first long, latest long, attempts long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Blocks open and extend a sequence, an allowed action closes it; a sequence that times out closes without one."""
    first, latest, attempts = state.get if state.exists else (None, None, 0)
    out = []
    if state.hasTimedOut:
        if attempts:
            out.append((key[0], first, latest, None, attempts))
        state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEQUENCE.split(", ")])
        return
    rows = pd.concat(list(batches)).sort_values(["created_at", "decision_id"], ascending=[True, False])
    for r in rows.itertuples():
        if r.blocked:
            first, latest, attempts = (r.decision_id if not attempts else first), r.decision_id, attempts + 1
        elif attempts:
            out.append((key[0], first, latest, r.decision_id, attempts))
            first = latest = None
            attempts = 0
    if attempts:
        state.update((first, latest, attempts))
        state.setTimeoutTimestamp(int(rows.created_at.max().timestamp() * 1000) + TTL_MS)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=[c.split()[0] for c in SEQUENCE.split(", ")]).astype({"healed": "Int64"})


#: Event time after which an open sequence closes as unresolved.
TTL_MS = 30 * 24 * 3600 * 1000


def healing(ledger: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Closed sequences of a ledger stream (decision_id, created_at, fingerprint, blocked); event time must not go back by more than delay."""
    return ledger.withWatermark("created_at", delay).groupBy("fingerprint").applyInPandasWithState(_fold, SEQUENCE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def appended(ledger: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each decision_id once, with state for as long as the delay."""
    return ledger.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["decision_id"])


def headline(ledger: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Blocks and protected files in tumbling windows."""
    w = ledger.withWatermark("created_at", delay).groupBy(F.window("created_at", width))
    return w.agg(F.count_if("blocked").alias("blocked_actions"), F.sum(F.when(F.col("blocked"), F.floor("value"))).alias("protected_files")).select(F.col("window.start").alias("start"), "blocked_actions", "protected_files")


def sessions(ledger: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    return ledger.withWatermark("created_at", delay).groupBy("fingerprint", F.session_window("created_at", gap)).agg(F.count("*").alias("n")).select("fingerprint", F.col("session_window.start").alias("start"), "n")


def upserted(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, **trigger):
    """Appends each batch's latest rows of each key to a table folder, one part for each batch; `latest` reads it. The checkpoint is the cursor.

    A batch that is tried again replaces its own part. Polling is a processingTime trigger; the default takes what is there and ends.
    """
    from pyspark.sql import Window

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The latest row of each key that any batch has written."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("batch"))
    return spark.read.option("basePath", path).parquet(path).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


def compacted(spark: SparkSession, path: str, to: str, key: str, order: str) -> None:
    """The latest rows as one batch in a new folder, when there are many batches."""
    latest(spark, path, key, order).write.parquet(f"{to}/batch=-1")
