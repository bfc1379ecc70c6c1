"""Derived tables that are kept up to date instead of rebuilt: builds of corpora, and rows derived from single files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import catalog
from assay.sources.shared import written
from assay.sources.tables import sized

MANIFEST = "corpus string, build_id string, built_at timestamp, status string, fingerprint string, signature string"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each corpus and build that was finished."""
    if not exists(spark, f"{folder}/manifests"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{folder}/manifests")


def materialized(wanted: DataFrame, folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Acts on the plan of builds: corpus and action (built, refreshed or reused). wanted: corpus, fingerprint, signature.

    A table's function gets the corpora to build and returns their rows with a column corpus; reused corpora are neither read nor written.
    Every run writes to folders of its own, its manifests last: a run that fails leaves nothing that counts, and of two runs at the same
    time each is whole, the later one being read. A run in which all is reused writes nothing.
    """
    spark = wanted.sparkSession
    wanted = wanted.select(F.col("corpus").cast("string").alias("corpus"), F.col("fingerprint").cast("string").alias("fingerprint"), F.col("signature").cast("string").alias("signature"))
    plan = written(catalog.build_plan(wanted, manifests(spark, folder)), "plan")
    todo = written(wanted.hint("merge").join(plan.where("action <> 'reused'").select("corpus"), "corpus", "left_semi"), "todo")
    if not todo.isEmpty():
        build = uuid.uuid4().hex
        for name, rows in tables.items():
            rows(todo).write.partitionBy("corpus").parquet(f"{folder}/{name}/build_id={build}")
        done = todo.select("corpus", F.lit(build).alias("build_id"), F.current_timestamp().alias("built_at"), F.lit("ready").alias("status"), "fingerprint", "signature")
        done.write.parquet(f"{folder}/manifests/{build}")
    return plan


def current(spark: SparkSession, folder: str, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A table's rows of each corpus's newest build; partitions of other builds are pruned. keep: columns of files' metadata to add."""
    newest = written(catalog.newest(manifests(spark, folder)).where("n = 1").select("corpus", "build_id"), "newest")
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/build_id=*")
    rows = rows.select("*", *[F.col(f"_metadata.{c}").alias(c) for c in keep])
    rows = rows.withColumn("corpus", F.col("corpus").cast("string")).withColumn("build_id", F.col("build_id").cast("string"))
    return rows.join(sized(newest), ["corpus", "build_id"])


def last_version(spark: SparkSession, folder: str) -> int:
    """The last finished version of a folder; 0 before the first."""
    if not exists(spark, folder):
        return 0
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)
    names = [s.getPath().getName().removeprefix("version=") for s in found if exists(spark, f"{s.getPath()}/_SUCCESS")]
    return max(map(int, names), default=0)


def _listing(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/files/version={version}") if version else spark.createDataFrame([], "path string, size long, changed string, made int")


def updated(listing: DataFrame, folder: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Brings rows derived from single files up to date with a listing (path, size, changed): path and change (added, changed, removed or kept).

    derive gets the paths of files that are new or changed, and returns rows with a column path; only those files are read. A version holds the rows of what it
    has read and a listing that names, for each file, the version in which its rows lie: rows of changed and removed files are thereby retracted without touching them.
    The listing is written last; a run that fails is done anew under the same number. For one writer at a time.
    """
    spark = listing.sparkSession
    last = last_version(spark, f"{folder}/files")
    before = _listing(spark, folder, last)
    old = before.select("path", F.col("size").alias("was"), F.col("changed").alias("then"), "made")
    both = listing.select("path", "size", F.col("changed").cast("string").alias("changed")).hint("merge").join(old, "path", "full")
    change = F.when(F.col("size").isNull() & F.col("changed").isNull(), "removed").when(F.col("made").isNull(), "added").when(F.col("was").eqNullSafe(F.col("size")) & F.col("then").eqNullSafe(F.col("changed")), "kept").otherwise("changed")
    changes = written(both.withColumn("change", change), "changes")
    made = F.when(F.col("change") == "kept", F.col("made")).otherwise(F.lit(last + 1)).cast("int")
    new = changes.where("change IN ('added', 'changed')").select("path")
    derive(new).write.mode("overwrite").parquet(f"{folder}/derived/version={last + 1}")
    changes.where("change <> 'removed'").select("path", "size", "changed", made.alias("made")).write.mode("overwrite").parquet(f"{folder}/files/version={last + 1}")
    return changes.select("path", "change")


def derived(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that hold now."""
    files = _listing(spark, folder, last_version(spark, f"{folder}/files")).select("path", F.col("made").alias("version"))
    rows = spark.read.option("basePath", f"{folder}/derived").parquet(f"{folder}/derived")
    return rows.hint("merge").join(files, ["path", "version"], "left_semi").drop("version")


def compacted(spark: SparkSession, folder: str) -> None:
    """One more version that holds all rows by itself, when versions have become many."""
    last = last_version(spark, f"{folder}/files")
    derived(spark, folder).write.mode("overwrite").parquet(f"{folder}/derived/version={last + 1}")
    _listing(spark, folder, last).withColumn("made", F.lit(last + 1)).write.mode("overwrite").parquet(f"{folder}/files/version={last + 1}")
