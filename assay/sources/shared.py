"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import functools
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="assay-shared-")


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is configured, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or _own_folder()).rstrip("/")


#: Folders written by each application, until they are forgotten.
_written: dict[str, list[str]] = {}


def written(df: DataFrame, name: str = "table", row_group: int | None = None) -> DataFrame:
    """`df`, written once and read back: later uses do not compute it again, and lost executors cost nothing.

    row_group: bytes of a row group, for tables of long rows, of which writers and readers hold one group at a time.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/assay-{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_made: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of all files below a folder, as one digest."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found, seen = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), hashlib.sha256()
    rows = []
    while found.hasNext():
        f = found.next()
        rows.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    for row in sorted(rows):
        seen.update(row.encode())
    return seen.hexdigest()


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], row_group: int | None = None) -> DataFrame:
    """A table derived from a folder of tables, written when it is first asked for in an application and read by all queries after that.

    It is made anew when a file below the folder has changed since, and gone after `forget`.
    """
    key, state = (spark.sparkContext.applicationId, sf_dir, name), _state(spark, sf_dir)
    if _made.get(key, ("",))[0] != state:
        _made[key] = state, written(make(), name, row_group)
    return _made[key][1]


def made(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether `once` has a table of that name that no file's change has outdated."""
    return _made.get((spark.sparkContext.applicationId, sf_dir, name), ("",))[0] == _state(spark, sf_dir)


def forget(spark: SparkSession) -> None:
    """Deletes all tables that this application has written here; results that rest on them must have been read."""
    app, hadoop = spark.sparkContext.applicationId, spark._jvm.org.apache.hadoop.fs
    for path in _written.pop(app, []):
        where = hadoop.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    for key in [k for k in _made if k[0] == app]:
        del _made[key]


def spread(df: DataFrame) -> DataFrame:
    """Input of fewer splits than the cluster has cores, dealt out to all of them; larger input as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
