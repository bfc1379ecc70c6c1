"""Tables and joins that several operators of this package use."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="assay-checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables; a temporary one only where none is set, in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or _own_folder()).rstrip("/")


#: Paths and catalogue names of tables written inside the scratches now open.
_scratches: list[list[tuple[str, str | None]]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes what is written inside, but for tables marked to keep, at its end: what is returned from it may only read those."""
    _scratches.append([])
    try:
        yield
    finally:
        for path, name in _scratches.pop():
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """`df`, written once to the shared folder and read back: cuts the lineage, survives lost executors.

    keep: the table outlives the scratch in which it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/assay-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if _scratches and not keep:
        _scratches[-1].append((path, None))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str, buckets: int | None = None) -> DataFrame:
    """Like `written`, in buckets by a column: joins on it move the other side only. For rows that are large and few."""
    spark = df.sparkSession
    path, key = f"{shared_folder(spark)}/assay-{name}-{uuid.uuid4().hex}", f"assay_{name}_{uuid.uuid4().hex}"
    df.write.option("path", path).option("compression", "none").bucketBy(buckets or parts(spark), by).format("parquet").saveAsTable(key)
    if _scratches:
        _scratches[-1].append((path, key))
    return spark.table(key)


def emptied(df: DataFrame) -> None:
    """Deletes the files of a table that was made by `bucketed` inside a scratch, when nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed_rows(df: DataFrame, *more, without: tuple[str, ...] = ()) -> DataFrame:
    """The rows as one struct column `row`, and further columns: whatever the columns' names, those of an operator cannot clash with them."""
    return df.select(F.struct(*[quoted(c) for c in df.columns if c not in without]).alias("row"), *more)


def quoted(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(df: DataFrame, name: str) -> F.Column:
    """A column as one that can be hashed: maps and variants, or what holds them, as JSON (maps of equal entries in another order count as different)."""
    odd = any(x in df.schema[name].dataType.simpleString() for x in ("map<", "variant", "interval", "geo"))
    return F.to_json(F.struct(quoted(name).alias("c"))) if odd else quoted(name)


def row_key(*columns) -> F.Column:
    """64 bits that tell rows of different values apart; equal rows share one, so it is the same on each reading."""
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*columns, *(c.isNull() for c in columns))


def ascii_lower(column):
    """A-Z to lower case and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
