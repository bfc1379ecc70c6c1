"""Queries that build, change and build again, and show what was read and written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.functions import text
from assay.operators import catalog, graph, merged, upkeep
from assay.plans.graph import _TREE, sources
from assay.sources.shared import folder, once, written
from assay.sources.tables import LEDGER_SQL, ledger, sized, table


def _base(spark, name: str) -> str:
    return f"{folder(spark)}/assay-{name}-{uuid.uuid4().hex}"


def _lines(docs):
    """A build's table: the lines of each corpus's texts that are not blank."""
    def rows(todo):
        # corpora are few and may be large: their texts stay where they are read
        mine = docs.join(sized(todo.select("corpus")), "corpus", "left_semi")
        return mine.select("corpus", "doc_id", F.posexplode(text.lines(F.coalesce("text", F.lit("")))).alias("line", "body")).where("trim(body) <> ''")

    return rows


def acting_builds(spark, d):
    """Corpora by language, built, then changed and built again: French texts change, Spanish ones go, a corpus comes. What is reused is not written, as the files' times show."""
    one = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("corpus"), "doc_id", "text")
    more = one.where("corpus = 'de' AND doc_id % 2 = 0").withColumn("corpus", F.lit("more"))
    two = one.where("corpus <> 'es'").withColumn("text", F.when(F.col("corpus") == "fr", F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text"))).unionByName(more)
    base, sign = _base(spark, "builds"), catalog.settings_signature(stride=48, window=96)
    print_ = F.sum(F.xxhash64("doc_id", "text").cast("decimal(20,0)")).alias("fingerprint")
    seen = []
    for docs in (one, two):
        plan = upkeep.materialized(docs.groupBy("corpus").agg(print_).withColumn("signature", sign), base, {"lines": _lines(docs)})
        files = upkeep.current(spark, base, "lines", ("file_modification_time",)).groupBy("corpus").agg(F.max("file_modification_time").alias("at"), F.count("*").alias("n_lines"))
        seen.append(written(plan.hint("merge").join(files, "corpus", "left"), "seen"))
    again = seen[0].select("corpus", F.col("at").alias("was"))
    return seen[1].hint("merge").join(again, "corpus", "left").select("corpus", "action", "n_lines", F.coalesce(F.col("at") > F.col("was"), F.lit(True)).alias("rewritten"))


def _updated(spark, d):
    """The source tree, read in full at first, then again after changes: of the Python modules those of a number divisible by ten change, the next ones go; one is new."""

    def make():
        tree = sources(spark, d)
        number = F.regexp_extract("path", r"^pkgs/n\d+/mod(\d+)\.py$", 1)
        n = F.when(number != "", number.cast("int") % 10)
        new = F.when(n == 0, F.lit("import changed\n")).otherwise(F.col("content"))
        after = tree.where(F.coalesce(n != 1, F.lit(True))).select("path", new.alias("content"))
        after = written(after.unionByName(spark.range(1).select(F.lit("pkgs/new.py").alias("path"), F.lit("import os, pkgs.n1\n").alias("content"))), "tree")
        base = _base(spark, "imports")
        for t in (tree, after):
            listing = t.select("path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("changed"))
            changes = upkeep.updated(listing, base, lambda new, t=t: graph.imports(t.hint("merge").join(new, "path", "left_semi")))
        return upkeep.derived(spark, base).select("path", "module", F.lit("import").alias("change")).unionByName(changes.select("path", F.lit(None).cast("string").alias("module"), "change"))

    return once(spark, d, "updated-imports", make)


def incremental_imports(spark, d):
    """Imports after an update that read only the changed files; a full rebuild gives the same."""
    return _updated(spark, d).where("change = 'import'").select("path", "module")


def incremental_changes(spark, d):
    """How many files an update found added, changed, removed and kept."""
    return _updated(spark, d).where("change <> 'import'").groupBy("change").agg(F.count("*").alias("n_files"))


#: Batches of `merged_ledger`.
_BATCHES = 6


def merged_ledger(spark, d):
    """Decisions in batches, each with changes to the batch before, and at last a batch that takes some away; merged on read, after two compactions."""

    def make():
        base, rows = _base(spark, "merged"), ledger(spark, d).select("decision_id", "fingerprint", "blocked")
        turn = F.col("decision_id") % _BATCHES
        for b in range(_BATCHES):
            changes = rows.where((turn == b - 1) & (F.col("decision_id") % 4 == 0)).withColumn("fingerprint", -F.col("fingerprint") - 1)
            merged.append(rows.where(turn == b).unionByName(changes).withColumn("batch", F.lit(b)), base, "decision_id", "batch", parts=8)
            if b == 3:
                merged.compact(spark, base, "decision_id", 3)
        merged.retract(rows.where("decision_id % 10 = 0"), base, "decision_id")
        merged.compact(spark, base, "decision_id", 3)
        return merged.current(spark, base, "decision_id")

    return once(spark, d, "merged-ledger", make)


def compacted_parts(spark, d):
    """Three batches, of which the last two touch the first parts only: a compaction writes these and leaves the files of the others."""
    base, rows = _base(spark, "merged"), ledger(spark, d).select("decision_id", "fingerprint")
    merged.append(rows, base, "decision_id", "decision_id", parts=8)
    for i in range(2):
        merged.append(rows.where(merged.part_of(F.col("decision_id"), 8) < 3).withColumn("fingerprint", F.col("fingerprint") + i), base, "decision_id", "decision_id")
    before = written(merged.live(spark, base).groupBy("part").agg(F.count("*").alias("runs_before")), "before")
    merged.compact(spark, base, "decision_id", 3)
    now = merged.live(spark, base)
    after = now.groupBy("part").agg(F.count("*").alias("runs_after"), (F.max("run") > 3).alias("rewritten"))
    held = merged.current(spark, base, "decision_id").groupBy(merged.part_of(F.col("decision_id"), 8).alias("part")).agg(F.count("*").alias("n_rows"), F.sum("fingerprint").alias("fingerprints"))
    return before.hint("merge").join(after, "part").hint("merge").join(held, "part")


QUERIES = {f.__name__: f for f in (acting_builds, incremental_imports, incremental_changes, merged_ledger, compacted_parts)}

_N = "len(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> ''))"
ORACLE_SQL = {
    "acting_builds": f"""WITH a AS (SELECT coalesce(lang, 'none') corpus, doc_id, CASE WHEN lang = 'fr' THEN text || chr(10) || 'changed' ELSE text END t FROM documents WHERE coalesce(lang, '') <> 'es' UNION ALL SELECT 'more', doc_id, text FROM documents WHERE lang = 'de' AND doc_id % 2 = 0)
        SELECT corpus, CASE corpus WHEN 'fr' THEN 'refreshed' WHEN 'more' THEN 'built' ELSE 'reused' END "action", CAST(sum(coalesce({_N}, 0)) AS BIGINT) n_lines, corpus IN ('fr', 'more') rewritten FROM a GROUP BY corpus""",
    "incremental_imports": f"""WITH {_TREE} SELECT path, unnest(CASE WHEN s % 10 = 0 THEN ['changed'] ELSE ['os', 'pkgs.n' || k || '.mod' || (s + 1), '.mod' || (s + 2), 'n' || ((k + 1) % 25) || '.mod' || (s + 5), 'pkgs.n' || ((k + 2) % 25)] END) "module" FROM s WHERE s % 10 <> 1
        UNION ALL SELECT path, unnest(['./item' || (c + 1), '../../kit' || k || '/src/item' || (c + 2), '@org/kit' || ((k + 1) % 25), 'lib' || ((k + 1) % 25) || '/item' || (c + 3)]) FROM c UNION ALL SELECT 'pkgs/new.py', unnest(['os', 'pkgs.n1'])""",
    "incremental_changes": """WITH n AS (SELECT (SELECT count(*) FROM supplier) s, (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 0) c, (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 1) r, (SELECT count(*) FROM customer) u, (SELECT count(*) FROM nation) k, (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) e)
        SELECT change, n_files FROM (SELECT unnest(['added', 'changed', 'removed', 'kept']) change, unnest([1, c, r, 3 * s - c - r + 2 * u + 2 * k + e]) n_files FROM n) WHERE n_files > 0""",
    "merged_ledger": f"""WITH {LEDGER_SQL}, t AS (SELECT *, decision_id % 6 r, decision_id % 6 < 5 AND decision_id % 4 = 0 changed FROM ledger WHERE decision_id % 10 <> 0)
        SELECT decision_id, CASE WHEN changed THEN -fingerprint - 1 ELSE fingerprint END fingerprint, blocked, CAST(CASE WHEN changed THEN r + 1 ELSE r END AS INTEGER) batch FROM t""",
    "compacted_parts": f"""WITH {LEDGER_SQL}, t AS (SELECT *, CAST(CAST('0x' || md5(CAST(decision_id AS VARCHAR))[:8] AS BIGINT) % 8 AS INTEGER) part FROM ledger)
        SELECT part, CAST(CASE WHEN part < 3 THEN 3 ELSE 1 END AS BIGINT) runs_before, CAST(1 AS BIGINT) runs_after, part < 3 rewritten, count(*) n_rows, CAST(sum(fingerprint + CASE WHEN part < 3 THEN 1 ELSE 0 END) AS BIGINT) fingerprints FROM t GROUP BY part""",
}
