"""Ledger analytics: healing sequences, headline metrics, feeds and table upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions import fixed, text
from assay.sources.shared import written
from assay.sources.tables import sized


def sequences(ledger: DataFrame) -> DataFrame:
    """Per fingerprint and sequence: the first block opens it, later blocks count, the first allowed action heals it.

    Rows of one time go by larger id first. An allowed action without an open block belongs to no sequence.
    """
    w = Window.partitionBy("fingerprint").orderBy("created_at", F.desc("decision_id"))
    done = F.sum((~F.col("blocked")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ledger.withColumn("seq", F.coalesce(done, F.lit(0))).withColumn("at", F.struct("created_at", (-F.col("decision_id")).alias("d")))
    b, a = F.col("blocked"), ~F.col("blocked")
    out = rows.groupBy("fingerprint", "seq").agg(
        F.count_if(b).alias("blocked_attempts"), F.min_by(F.when(b, F.col("decision_id")), F.when(b, F.col("at"))).alias("first_blocked"), F.max_by(F.when(b, F.col("decision_id")), F.when(b, F.col("at"))).alias("latest_blocked"),
        F.min(F.when(b, F.col("created_at"))).alias("blocked_at"), F.max(F.when(b, F.col("created_at"))).alias("latest_blocked_at"), F.max(F.when(a, F.col("decision_id"))).alias("healed"), F.max(F.when(a, F.col("created_at"))).alias("healed_at"),
    ).where("blocked_attempts > 0")
    return out.withColumn("minutes", F.round((F.unix_micros(F.col("healed_at").cast("timestamp")) - F.unix_micros(F.col("blocked_at").cast("timestamp"))) / 6e7, 4))


def healing(seq: DataFrame) -> DataFrame:
    ok = F.col("healed").isNotNull()
    return seq.agg(
        F.count("*").alias("blocked_sequences"), F.count_if(ok).alias("healed_sequences"), F.count_if(~ok).alias("unresolved_sequences"), F.round(F.count_if(ok) / F.greatest(F.lit(1), F.count("*")), 6).alias("healing_rate"),
        F.round(F.avg(F.when(ok, F.col("blocked_attempts"))), 4).alias("average_retries"), F.round(F.median(F.when(ok, F.col("minutes"))) + 1e-7, 4).alias("median_minutes"),
    )


def headline(records: DataFrame) -> DataFrame:
    """Blocks, those with a linked incident, and the files, tests, docs and runbooks that they protected; records: blocked, linked, files, tests, docs, runbooks."""
    b = F.col("blocked")
    kept = [F.coalesce(F.sum(F.when(b, F.col(c))), F.lit(0)).cast("long").alias(f"protected_{c}") for c in ("files", "tests", "docs", "runbooks")]
    return records.agg(F.count_if(b).alias("blocked_actions"), F.count_if(b & F.col("linked")).alias("incident_linked"), *kept, F.count("*").alias("actions"))


def overview(records: DataFrame, *, limit: int = 250, feed_limit: int = 12, only=None) -> DataFrame:
    """One row on the latest records, of those the ones that `only` selects: headline metrics, healing, the five latest heals and the risk feed."""
    recent = latest(records, limit)
    recent = written(recent if only is None else recent.where(only), "recent")  # `limit` rows at most
    seq = written(sequences(recent), "sequences")
    heals = seq.where("healed IS NOT NULL").orderBy(F.desc("healed_at"), F.desc("healed")).limit(5)
    order = lambda rows, *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda x: x["cell"]), "|")
    heals = heals.agg(order(heals, (-F.unix_micros(F.col("healed_at").cast("timestamp"))).alias("t"), (-F.col("healed")).alias("i"), F.concat_ws(">", F.col("first_blocked").cast("string"), F.col("healed").cast("string")).alias("cell")).alias("recent_heals"))
    risks = feed(seq, recent.withColumn("value", F.when(F.col("linked"), 100).otherwise(0)), feed_limit)
    risks = risks.agg(order(risks, (~F.col("signal")).alias("s"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), F.col("decision_id").alias("i"), F.concat_ws(":", F.col("decision_id").cast("string"), "status").alias("cell")).alias("risk_feed"))
    out = headline(recent)
    for part in (healing(seq), heals, risks):
        out = out.join(F.broadcast(part), how="cross")  # each is one row
    return out


def by_id(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    return ledger.join(ids.select("decision_id").distinct(), "decision_id", "left_semi")


def upserted(ledger: DataFrame, changes: DataFrame, key: str = "decision_id", *order) -> DataFrame:
    """The ledger with changes: of a key's rows those of the changes win, of several of those the last by order."""
    both = ledger.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), *order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def imported(spark: SparkSession, lines: str, folder: str, schema: str, key: str = "decision_id") -> DataFrame:
    """Records of a JSON-lines file and of a folder of JSON files; the first one of a key wins, lines before files, both in their order."""
    one = spark.read.schema(schema).json(lines).withColumn("_at", F.struct(F.lit(0).alias("o"), F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))
    two = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folder).withColumn("_at", F.struct(F.lit(1).alias("o"), F.col("_metadata.file_name").alias("f"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("i")))
    return first_wins(one.unionByName(two).where(F.col(key).isNotNull()), key, "_at").drop("_at")


def signals(parts: DataFrame) -> DataFrame:
    """Per request its signals, each source and relation once, numbered by label and source; parts: evidence and twins with snippets."""
    kind = signal_kind(F.col("path"))
    label = F.element_at(F.create_map(*[F.lit(x) for pair in fixed.SIGNAL_LABELS.items() for x in pair]), kind)
    rows = parts.where(kind.isNotNull()).select("request_id", F.col("path").alias("source"), F.when(F.col("twin"), "twin_case").otherwise("evidence_span").alias("relation"), kind.alias("source_kind"), label.alias("label"), text.trimmed(F.col("snippet")).alias("summary"))
    once = rows.dropDuplicates(["request_id", "source", "relation"]).withColumn("title", text.title(F.coalesce("summary", "source")))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("label", "source", "relation")))


def lookback(seconds, days: int):
    """Relative time clause for so many seconds back: minutes, hours or days, rounded up; of null the days given."""
    s = F.greatest(seconds, F.lit(60))
    minutes = F.ceil(s / 60)
    clause = F.when(minutes < 60, F.concat(F.lit("-"), minutes.cast("string"), F.lit("m"))).when(minutes < 24 * 60, F.concat(F.lit("-"), F.ceil(s / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.lit("-"), F.ceil(s / 86400).cast("string"), F.lit("d")))
    return F.when(seconds.isNull(), f"-{max(1, days)}d").otherwise(clause)


def comment(record: DataFrame) -> DataFrame:
    """A pull request's comment for each record: decision, figures, what is missing and what was violated."""
    bullets = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n### {title}\n- "), F.array_join(c, "\n- ")))
    head = F.concat(F.lit("## Decision: "), F.col("decision"), F.when(F.col("allowed"), " (allowed)").otherwise(" (blocked)"))
    figures = F.format_string("Hazard %.2f, confidence %.2f, %d files affected.", "hazard", "confidence", "impacted_files")
    return record.withColumn("comment", F.concat_ws("\n", head, figures, bullets("Missing evidence", F.col("missing")), bullets("Policy violations", F.col("violations")), F.col("prompt")))


def feed(seq: DataFrame, ledger: DataFrame, limit: int) -> DataFrame:
    """Healed sequences by their first block and open ones by their latest; those with signals first, then the newest."""
    healed = seq.where("healed IS NOT NULL").select(F.col("first_blocked").alias("decision_id"), F.lit("healed_on_retry").alias("status"), F.col("healed").alias("healed_decision_id"))
    open_ = seq.where("healed IS NULL").select(F.col("latest_blocked").alias("decision_id"), F.lit("still_blocked").alias("status"), F.lit(None).cast("long").alias("healed_decision_id"))
    rows = healed.unionByName(open_).join(ledger.select("decision_id", "created_at", (F.col("value") >= 50).alias("signal")), "decision_id")
    return rows.orderBy(F.desc("signal"), F.desc("created_at"), "decision_id").limit(limit)


def latest(ledger: DataFrame, n: int) -> DataFrame:
    return ledger.orderBy(F.desc("decision_id")).limit(n)


def first_wins(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def signal_kind(source):
    """Kind of signal that a source path is, by its first folder; null for others."""
    p = F.lower(source)
    return F.when(p.startswith("external_jira/"), "jira").when(p.startswith("external_slack/"), "slack").when(p.startswith("external_pagerduty/"), "pagerduty").when(p.rlike("^(external_)?incidents/"), "incident").when(p.rlike("^(external_github_)?prs/"), "github")


def fingerprint(repo, summary, changed):
    return F.concat_ws("::", F.coalesce(repo, F.lit("")), text.normalized(summary), F.array_join(F.array_sort(changed), "|"))


def labels(policies: DataFrame):
    """The labels of a row of policies: of flags that are set, and of limits with their value."""
    kinds = dict(policies.dtypes)
    one = lambda c, label: F.when(F.col(c), F.lit(label)) if kinds[c] == "boolean" else F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    return F.array_compact(F.array(*[one(c, label) for c, label in fixed.POLICY_LABELS.items()]))


def as_lines(ledger: DataFrame, path: str, key: str = "decision_id") -> None:
    """Writes records as JSON lines in the order of their ids; the files' order goes on where the one before ends."""
    ledger.orderBy(key).select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line and place of all lines of a folder of text files, in the order of the files' names and of the lines in them, from 0.

    Lines are numbered in the stretch of a file that a task reads; only the stretches' sizes are added up over all.
    """
    read = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = written(read, "lines")
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("file", "start").orderBy("at")) - 1
    return lines.withColumn("nth", inside).join(sized(written(before, "stretches")), ["file", "start"]).select("line", (F.col("before") + F.col("nth")).cast("long").alias("place"))
