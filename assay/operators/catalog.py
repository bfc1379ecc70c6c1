"""The catalogue of built corpora: keys, fingerprints, freshness, build plans, listing, deletion and retention, and the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def snapshot(files: DataFrame) -> DataFrame:
    """files (corpus, path, size, changed) to a fingerprint of each corpus that does not depend on their order."""
    digest = F.conv(F.left(F.md5(F.concat_ws("|", "path", "size", "changed")), F.lit(8)), 16, 10).cast("long")
    return files.groupBy("corpus").agg(F.bit_xor(digest).alias("fingerprint"), F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def settings_signature(**settings):
    """Digest of the settings on which derived tables depend, in the order of their names."""
    return F.sha2(F.lit("|".join(f"{k}={settings[k]}" for k in sorted(settings))), 256)


def corpus_key(root, sources, signature):
    """24 digits that name a corpus: its root, its sources in order and the settings."""
    return F.left(F.sha2(F.concat_ws("\n", root, F.array_join(F.array_sort(sources), "\n"), signature), 256), F.lit(24))


def delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or changed since: the only ones whose derived rows have to be made again."""
    return now.join(before.select("corpus", "path", "size", "changed"), ["corpus", "path", "size", "changed"], "left_anti")


def build_plan(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    """What to do for each wanted corpus (corpus, fingerprint, signature): reused, refreshed (it differs from its newest manifest) or built (it has none)."""
    old = newest(manifests).where("n = 1").select("corpus", F.col("fingerprint").alias("was"), F.col("signature").alias("by"), F.lit(True).alias("known"))
    same = (F.col("was") == F.col("fingerprint")) & (F.col("by") == F.col("signature"))
    return wanted.join(old, "corpus", "left").select("corpus", F.when(F.col("known").isNull(), "built").when(same, "reused").otherwise("refreshed").alias("action"))


def freshness(manifests: DataFrame, snapshots: DataFrame) -> DataFrame:
    both = manifests.join(snapshots.select("corpus", F.col("fingerprint").alias("now")), "corpus", "full")
    return both.select("corpus", F.when(F.col("fingerprint").isNull(), "missing").when(F.col("now").isNull() | (F.col("fingerprint") != F.col("now")), "stale").otherwise("ready").alias("status"))


def newest(manifests: DataFrame) -> DataFrame:
    w = Window.partitionBy("corpus").orderBy(F.desc("built_at"), F.desc("build_id"))
    return manifests.withColumn("n", F.row_number().over(w))


def listed(manifests: DataFrame) -> DataFrame:
    """The newest manifest of each corpus, ready ones first, then by name."""
    return newest(manifests).where("n = 1").drop("n").orderBy(F.col("status") != "ready", "corpus")


def deletion(manifests: DataFrame, wanted: DataFrame, *, dry_run: bool) -> DataFrame:
    """For each wanted corpus: missing if it has no manifest, else would_delete or deleted. Asking again is harmless."""
    held = manifests.select("corpus").distinct().withColumn("held", F.lit(True))
    done = "would_delete" if dry_run else "deleted"
    return wanted.select("corpus").distinct().join(held, "corpus", "left").select("corpus", F.when(F.col("held"), done).otherwise("missing").alias("outcome"))


def pruned(manifests: DataFrame, *, stale_only: bool) -> DataFrame:
    """Corpora that a prune takes away: all of them, or those whose newest manifest is stale."""
    last = newest(manifests).where("n = 1")
    return (last.where("status = 'stale'") if stale_only else last).select("corpus", "build_id")


def retention(manifests: DataFrame, now, max_age_hours: int, most: int) -> DataFrame:
    """Why each manifest goes: stale before expired before overflow, which are all but the `most` newest, stale ones counted."""
    newest_first = (F.desc("built_at"), F.desc("build_id"))
    last = manifests.orderBy(*newest_first).limit(most).agg(F.min(F.struct("built_at", "build_id")).alias("last"))  # a row: the oldest that stays
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("built_at").cast("timestamp"))) / 3.6e9
    over = F.struct("built_at", "build_id") < F.col("last")
    reason = F.when(F.col("status") == "stale", "stale").when(age >= max_age_hours, "expired").when(over, "overflow")
    return manifests.join(F.broadcast(last), how="cross").withColumn("reason", reason).drop("last")


def persist(tables: dict[str, DataFrame], manifest: DataFrame, folder: str) -> None:
    """Writes a build's tables (with a column corpus) and, when they are there, its manifest: a build without manifest does not count.

    Only the partitions of the corpora that are built are replaced.
    """
    for name, df in {**tables, "manifests": manifest}.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of all builds whose manifests are there."""
    df = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    if name == "manifests":
        return df
    return df.join(read(spark, folder, "manifests").select("corpus").distinct(), "corpus", "left_semi")


def drop(spark: SparkSession, folder: str, names: list[str], corpora: list[str]) -> None:
    """Deletes corpora's partitions, their manifests first; what is not there is passed over."""
    for name in ["manifests", *[n for n in names if n != "manifests"]]:
        for corpus in corpora:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/corpus={corpus}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
