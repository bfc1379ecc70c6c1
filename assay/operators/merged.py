"""A keyed table that grows by batches and merges on read: batches are sorted runs in parts by the key's hash, merged by level.

Of a key's rows the one of the least level and, within it, of the last run holds. A merge takes all runs of a part's level to the next one, so whatever lies deeper
is older. Live runs are listed by part; the listing is written last, so a run that fails counts for nothing and is done anew under its number. For one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.operators.ledger import first_wins
from assay.operators.upkeep import last_version
from assay.sources.shared import written
from assay.sources.tables import sized

LISTING = "part int, run int, level int, parts int"


def part_of(key: Column, parts: int | Column) -> Column:
    """The part of a key, by its MD5 as a string; rows without a key lie in part 0 and are one key."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % parts, F.lit(0)).cast("int")


def live(spark: SparkSession, folder: str) -> DataFrame:
    """The runs that count: part, run, level and the number of parts."""
    last = last_version(spark, f"{folder}/live")
    return spark.read.schema(LISTING).parquet(f"{folder}/live/version={last}") if last else spark.createDataFrame([], LISTING)


def _write(rows: DataFrame, folder: str, key: str, level: int, parts: int, others: DataFrame, run: int) -> None:
    """A run: files of a part hold ranges of keys in order, so a lookup skips most of them by their bounds."""
    rows.repartitionByRange("part", key).sortWithinPartitions("part", key).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows/run={run}")
    new = rows.select("part").distinct().select("part", F.lit(run).alias("run"), F.lit(level).alias("level"), F.lit(parts).alias("parts"))
    others.unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{folder}/live/version={run}")


def append(rows: DataFrame, folder: str, key: str, *order, parts: int = 16) -> None:
    """Adds a batch; of rows of one key the first by order. parts counts for a folder's first batch; let it grow with the table."""
    spark, listing = rows.sparkSession, live(rows.sparkSession, folder)
    first = listing.first()
    n = first.parts if first else parts
    batch = first_wins(rows, key, *order) if "_gone" in rows.columns else first_wins(rows, key, *order).withColumn("_gone", F.lit(False))
    _write(written(batch.withColumn("part", part_of(F.col(key), n)), "batch"), folder, key, 0, n, listing, last_version(spark, f"{folder}/live") + 1)


def retract(keys: DataFrame, folder: str, key: str) -> None:
    """A batch that takes away keys."""
    schema = _rows(keys.sparkSession, folder).drop("part", "run", "_gone").schema
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != key]
    append(keys.select(key, *empty, F.lit(True).alias("_gone")), folder, key, key)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").withColumns({"part": F.col("part").cast("int"), "run": F.col("run").cast("int")})


def _read(spark: SparkSession, folder: str, runs: DataFrame) -> DataFrame:
    """Rows of listed runs, with their level; folders of other runs and parts are pruned. A listing has as many rows as there are parts and runs of them."""
    runs = written(runs.select("part", "run", "level"), "runs")
    # both lists are short: a level holds few runs, and parts are a parameter
    seen = runs.agg(F.collect_set("run").alias("runs"), F.collect_set("part").alias("parts")).first()
    return _rows(spark, folder).where(F.col("run").isin(seen.runs) & F.col("part").isin(seen.parts)).join(sized(runs), ["part", "run"])


def _newest(rows: DataFrame, key: str) -> DataFrame:
    return first_wins(rows, key, "level", F.desc("run"))


def current(spark: SparkSession, folder: str, key: str, only: list[int] | None = None) -> DataFrame:
    """The rows that hold, of some parts or of all. Parts of a single run are read as they are; only the others are ranked."""
    listing = live(spark, folder)
    if only is not None:
        listing = listing.where(F.col("part").isin(only))
    counted = written(listing.withColumn("n", F.count("*").over(Window.partitionBy("part"))), "listing")
    one, more = _read(spark, folder, counted.where("n = 1")), _newest(_read(spark, folder, counted.where("n > 1")), key)
    return one.unionByName(more).where("NOT _gone").drop("_gone", "part", "run", "level")


def lookup(ids: DataFrame, folder: str, key: str) -> DataFrame:
    """Current rows of some keys; only their parts are read."""
    spark, first = ids.sparkSession, live(ids.sparkSession, folder).first()
    wanted = written(ids.select(key).distinct(), "ids")
    only = [r.part for r in wanted.select(part_of(F.col(key), first.parts if first else 1).alias("part")).distinct().collect()]  # parts at most
    return current(spark, folder, key, only).join(sized(wanted), key, "left_semi")


def compact(spark: SparkSession, folder: str, key: str, fanout: int = 4) -> None:
    """Merges the runs of each part's level that holds `fanout` of them into one of the next level; other parts are neither read nor written.

    Rows that were taken away leave the table when nothing lies deeper.
    """
    level = 0
    while True:
        listing = written(live(spark, folder), "listing")
        full = listing.groupBy("part").agg(F.count_if(F.col("level") == level).alias("n"), F.max("level").alias("deepest")).where(F.col("n") >= fanout).select("part", "deepest")
        full = written(full, "full")
        if not full.isEmpty():
            merging = listing.where(F.col("level") == level).join(sized(full), "part")
            rows = _newest(_read(spark, folder, merging), key).drop("run", "level").join(sized(full), "part").where(~F.col("_gone") | (F.col("deepest") > level)).drop("deepest")
            others = listing.hint("merge").join(merging.select("part", "run"), ["part", "run"], "left_anti")
            _write(written(rows, "merge"), folder, key, level + 1, listing.first().parts, others, last_version(spark, f"{folder}/live") + 1)
        elif level >= (listing.agg(F.max("level")).first()[0] or 0):
            return
        level += 1


def swept(spark: SparkSession, folder: str) -> list[int]:
    """Deletes runs of which no part counts any more, and returns their numbers; readers must have ended that began before the last merge."""
    hadoop, root = spark._jvm.org.apache.hadoop.fs, f"{folder}/rows"
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    keep, last = {r.run for r in live(spark, folder).select("run").distinct().collect()}, last_version(spark, f"{folder}/live")
    runs = {int(s.getPath().getName().removeprefix("run=")): s.getPath() for s in fs.listStatus(hadoop.Path(root)) if s.isDirectory()}
    gone = sorted(n for n in runs if n <= last and n not in keep)
    for n in gone:
        fs.delete(runs[n], True)
    return gone
