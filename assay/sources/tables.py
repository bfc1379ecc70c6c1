"""The driver's tables as inputs of the engine: corpus, requests, dependency edges and ledger."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import paths
from assay.sources.shared import once, spread, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By doc_id modulo 8: how a document's path begins and ends; its source, and its id (of a test: the id of what it tests) stand between.
_LAYOUT = (("src/", "/doc_", ".py"), ("tests/", "/test_doc_", ".py"), ("docs/", "/doc_", ".md"), ("runbooks/", "/doc_", ".md"), ("prs/", "/pr_", ".md"), ("incidents/", "/doc_", ".md"), ("web/components/", "/Doc", "Panel.tsx"), ("web/components/", "/Doc", "Panel.test.tsx"))


def _path(doc_id, source):
    """A document's path follows from its id and source; a test is named after the document before it."""
    k, part = F.pmod(doc_id, F.lit(8)).cast("int"), lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in _LAYOUT]), k + 1)
    number = F.when(k.isin(1, 7), doc_id - 1).otherwise(doc_id).cast("string")
    return F.concat(part(0), F.coalesce(source, F.lit("none")), part(1), number, part(2))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus: doc_id, path, source_type, content (with a blank line after every sentence that ends a line), source, lang."""
    d = spread(table(spark, sf_dir, "documents"))
    path = _path(F.col("doc_id"), F.col("source"))
    content = F.replace(F.coalesce("text", F.lit("")), F.lit(".\n"), F.lit(".\n\n"))
    return d.select("doc_id", path.alias("path"), paths.source_type(path).alias("source_type"), content.alias("content"), "source", "lang")


def corpus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path of each document, without its text."""
    return table(spark, sf_dir, "documents").select(_path(F.col("doc_id"), F.col("source")).alias("path"))


_SQL_PATH = "(CASE {0} % 8 " + " ".join(f"WHEN {k} THEN '{a}' || coalesce({{1}}, 'none') || '{b}' || ({{0}}{' - 1' if k in (1, 7) else ''}) || '{c}'" for k, (a, b, c) in enumerate(_LAYOUT)) + " END)"
#: The same in SQL.
CORPUS_SQL = f"""docs AS (SELECT doc_id, path, CASE WHEN contains('/' || path, '/tests/') OR contains(path, '.test.') THEN 'test' WHEN contains(path, 'runbook') THEN 'runbook' WHEN contains(path, 'incident') THEN 'incident'
  WHEN contains('/' || path, '/prs/') THEN 'pr' WHEN regexp_matches(path, '\\.(py|tsx)$') THEN 'code' ELSE 'doc' END source_type, content, source, lang FROM
  (SELECT doc_id, {_SQL_PATH.format('doc_id', 'source')} path, replace(coalesce(text, ''), '.' || chr(10), '.' || chr(10) || chr(10)) content, source, lang FROM documents))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as requests: request_id, query and changed_paths.

    Item i changes a code file, a component, both or a file that is not there, by i modulo 4: documents 8i and 8i + 6.
    """

    def make() -> DataFrame:
        b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.coalesce("text", F.lit("")).alias("query"))
        k = F.pmod("request_id", F.lit(4))
        offsets = F.when(k == 0, F.array(F.lit(0))).when(k == 1, F.array(F.lit(6))).when(k == 2, F.array(F.lit(0), F.lit(6))).otherwise(F.array().cast("array<int>"))
        wanted = b.select("request_id", F.explode(offsets).alias("o")).select("request_id", (F.col("request_id") * 8 + F.col("o")).alias("doc_id"))
        d = table(spark, sf_dir, "documents").select("doc_id", _path(F.col("doc_id"), F.col("source")).alias("path"))
        changed = d.join(sized(written(wanted, "wanted")), "doc_id").groupBy("request_id").agg(F.array_sort(F.collect_set("path")).alias("changed_paths"))
        ghost = F.array(F.concat(F.lit("./src/gone_"), F.col("request_id").cast("string"), F.lit(".py")))
        return b.hint("merge").join(changed, "request_id", "left").withColumn("changed_paths", F.transform(F.coalesce("changed_paths", ghost), paths.normalized))

    return once(spark, sf_dir, "requests", make)


REQUESTS_SQL = f"""reqs AS (SELECT item_id request_id, coalesce(text, '') query, coalesce((SELECT list_sort(list(path)) FROM docs WHERE (item_id % 4 IN (0, 2) AND doc_id = item_id * 8) OR (item_id % 4 IN (1, 2) AND doc_id = item_id * 8 + 6)), ['src/gone_' || item_id || '.py']) changed_paths FROM benchmark)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on what (src on dst): code on the code eight ids before unless that begins a run of five, components alike; tests, docs and runbooks on their code."""
    d = table(spark, sf_dir, "documents").select("doc_id", _path(F.col("doc_id"), F.col("source")).alias("path"))
    k = F.pmod("doc_id", F.lit(8))
    back = F.when(k.isin(0, 6) & (F.pmod(F.floor(F.col("doc_id") / 8), F.lit(5)) > 0), 8).when(k == 1, 1).when(k == 2, 2).when(k == 3, 3).when(k == 7, 1)
    pairs = d.select(F.col("path").alias("src"), (F.col("doc_id") - back).alias("doc_id")).where("doc_id IS NOT NULL").hint("merge").join(d.withColumnRenamed("path", "dst"), "doc_id")
    return once(spark, sf_dir, "edges", lambda: pairs.select("src", "dst").where("src <> dst").distinct())


EDGES_SQL = """edges AS (SELECT DISTINCT a.path src, b.path dst FROM docs a JOIN docs b ON b.doc_id = a.doc_id - CASE WHEN a.doc_id % 8 IN (0, 6) AND (a.doc_id // 8) % 5 > 0 THEN 8 WHEN a.doc_id % 8 IN (1, 7) THEN 1 WHEN a.doc_id % 8 = 2 THEN 2 WHEN a.doc_id % 8 = 3 THEN 3 END WHERE a.path <> b.path)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as decisions: error is a block, purchase an allowed action; the user is the action's fingerprint."""
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin("error", "purchase")).select(
        F.col("event_id").alias("decision_id"), F.col("ts").alias("created_at"), F.col("user_id").alias("fingerprint"), (F.col("event_type") == "error").alias("blocked"), "value", "event_type"
    )


LEDGER_SQL = "ledger AS (SELECT event_id decision_id, ts created_at, user_id fingerprint, event_type = 'error' blocked, value, event_type FROM events WHERE event_type IN ('error', 'purchase'))"


def small(df: DataFrame, most: int = 100_000, most_bytes: int = 64_000_000) -> bool:
    """Whether a written table's rows and its plan's size allow a broadcast."""
    return df.limit(most + 1).count() <= most and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes


def sized(df: DataFrame, most: int = 100_000, most_bytes: int = 64_000_000) -> DataFrame:
    """A written table marked for broadcast if its rows and its plan's size are small, else for a sort-merge join."""
    return F.broadcast(df) if small(df, most, most_bytes) else df.hint("merge")


def tasks(df: DataFrame, parts: float) -> int:
    """Tasks for so many parts of fixed size: as many as the cluster has cores at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, ceil(parts))
