"""Queries that run the streams over the events table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.sources.shared import folder, written
from assay.sources.tables import LEDGER_SQL, ledger, table
from assay.streaming import ledger as streams
from assay.streaming import sync


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The ledger as a stream of files in time order."""
    rows = written(ledger(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("day", F.to_date("created_at")), "ledger")
    return spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """All output of a stream, by way of a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{folder(spark)}/assay-stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/at").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def streaming_healing(spark, d):
    """Healed sequences found by the stream; batch `healing_sequences` is the same for those that healed."""
    return _run(streams.healing(_stream(spark, d).select("decision_id", "created_at", "fingerprint", "blocked")), "append").where("healed IS NOT NULL")


def streaming_ledger(spark, d):
    s = _stream(spark, d).select("decision_id", "created_at", "fingerprint", "blocked")
    return _run(streams.appended(s.union(s)), "append").select("decision_id", "fingerprint", "blocked")


def streaming_headline(spark, d):
    """Blocks and what they protected by day, of the days that the watermark has closed."""
    return _run(streams.headline(_stream(spark, d).select("decision_id", "created_at", "blocked", "value")), "append").select(F.unix_micros("start").alias("start_us"), "blocked_actions", "protected_files")


def streaming_sessions(spark, d):
    """Sessions of six hours by fingerprint, of those that the watermark has closed."""
    return _run(streams.sessions(_stream(spark, d).select("created_at", "fingerprint")), "append").select("fingerprint", F.unix_micros("start").alias("start_us"), "n")


def streaming_upsert(spark, d):
    """Events as landed exports, of which the latest of each user stays; the second run finds nothing new."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), "event_type")
    rows = written(e, "landed")
    base = f"{folder(spark)}/assay-upsert-{uuid.uuid4().hex}"
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
        streams.upserted(stream, f"{base}/out", "key", "version", f"{base}/at").awaitTermination()
    return streams.latest(spark, f"{base}/out", "key", "version")


def sync_cursors(spark, d):
    """Events landed by type and synced twice; before the second run only errors land, so the other sources' second run is empty and their cursors advance all the same."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), "event_type")
    base = f"{folder(spark)}/assay-sync-{uuid.uuid4().hex}"
    kinds = ("click", "error", "purchase", "view")
    late = (F.col("event_type") == "error") & (F.col("version") % 2 == 1)
    for number, part in ((1, ~late), (2, late)):
        e.where(part).repartition(2).write.mode("append").partitionBy("event_type").parquet(f"{base}/landed")
        streams_ = {k: spark.readStream.schema("key long, version long").parquet(f"{base}/landed/event_type={k}") for k in kinds}
        sync.run(streams_, f"{base}/synced", "key", "version", number)
        if number == 1:
            first = written(sync.cursors(spark, f"{base}/synced").select("source", F.col("cursor").alias("was")), "cursors")
    counts = None
    for k in kinds:
        n = sync.latest(spark, f"{base}/synced", k, "key", "version").agg(F.count("*").alias("n_keys"), F.sum("version").alias("sum_versions")).withColumn("source", F.lit(k))
        counts = n if counts is None else counts.unionByName(n)
    now = sync.cursors(spark, f"{base}/synced").join(first, "source").join(counts, "source")
    return now.select("source", "run", F.col("rows").alias("rows_last"), "rows_total", (F.col("cursor") > F.col("was")).alias("advanced"), "n_keys", "sum_versions")


QUERIES = {f.__name__: f for f in (streaming_healing, streaming_ledger, streaming_headline, streaming_sessions, streaming_upsert, sync_cursors)}

_SEQ = f"""WITH {LEDGER_SQL}, s AS (SELECT *, coalesce(sum(CASE WHEN blocked THEN 0 ELSE 1 END) OVER (PARTITION BY fingerprint ORDER BY created_at, decision_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) seq FROM ledger),
q AS (SELECT fingerprint, count(*) FILTER (WHERE blocked) blocked_attempts, arg_min(decision_id, (created_at, -decision_id)) FILTER (WHERE blocked) first_blocked, arg_max(decision_id, (created_at, -decision_id)) FILTER (WHERE blocked) latest_blocked, max(decision_id) FILTER (WHERE NOT blocked) healed FROM s GROUP BY fingerprint, seq)"""
ORACLE_SQL = {
    "streaming_healing": f"{_SEQ} SELECT fingerprint, first_blocked, latest_blocked, healed, blocked_attempts FROM q WHERE healed IS NOT NULL AND blocked_attempts > 0",
    "streaming_ledger": f"WITH {LEDGER_SQL} SELECT decision_id, fingerprint, blocked FROM ledger",
    "streaming_headline": f"WITH {LEDGER_SQL} SELECT epoch_us(date_trunc('day', created_at)) start_us, count(*) FILTER (WHERE blocked) blocked_actions, CAST(sum(floor(value)) FILTER (WHERE blocked) AS BIGINT) protected_files FROM ledger GROUP BY date_trunc('day', created_at) HAVING date_trunc('day', created_at) + INTERVAL 1 DAY <= (SELECT max(created_at) FROM ledger) - INTERVAL 1 HOUR",
    "streaming_sessions": f"""WITH {LEDGER_SQL}, g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w >= INTERVAL 6 HOURS THEN 1 ELSE 0 END new FROM ledger WINDOW w AS (PARTITION BY fingerprint ORDER BY created_at)), s AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY fingerprint ORDER BY created_at ROWS UNBOUNDED PRECEDING) k FROM g)
        SELECT fingerprint, epoch_us(min(created_at)) start_us, count(*) n FROM s GROUP BY fingerprint, k HAVING max(created_at) + INTERVAL 6 HOURS <= (SELECT max(created_at) FROM ledger) - INTERVAL 1 HOUR""",
    "streaming_upsert": """SELECT user_id "key", max(event_id) AS "version", arg_max(event_type, event_id) event_type FROM events GROUP BY user_id""",
    "sync_cursors": """WITH k AS (SELECT event_type, user_id, max(event_id) v FROM events WHERE event_type IN ('click', 'error', 'purchase', 'view') GROUP BY ALL), n AS (SELECT event_type, count(*) n, count(*) FILTER (WHERE event_type = 'error' AND event_id % 2 = 1) late FROM events GROUP BY event_type)
        SELECT event_type AS "source", 2 run, any_value(late) rows_last, any_value(n) rows_total, TRUE advanced, count(*) n_keys, CAST(sum(v) AS BIGINT) sum_versions FROM k JOIN n USING (event_type) GROUP BY event_type""",
}
