"""Queries that write tables as export files and read them back as documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import fixed, text
from assay.sources import exports
from assay.sources.shared import folder, once, written
from assay.sources.tables import CORPUS_SQL, EDGES_SQL, corpus, edges, table

#: Rows of one export file, at most.
FILE_ROWS = 500
#: Files that one task writes, about.
TASK_FILES = 2000


def _files(rows: DataFrame, key: str, record) -> str:
    """Folder of export files, each a JSON array of the records of some keys; rows of a key stay together."""
    path = f"{folder(rows.sparkSession)}/assay-export-{uuid.uuid4().hex}"
    n = max(1, -(-rows.count() // FILE_ROWS))
    arrays = rows.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("file"), record.alias("r")).groupBy("file").agg(F.to_json(F.collect_list("r")).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return path


def export_wiki(spark, d):
    """Pages as a wiki export."""
    p = table(spark, d, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    record = F.struct(
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body"), F.struct(host.alias("key")).alias("space"),
        F.struct(F.lit("https://wiki/").alias("base"), F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("webui")).alias("_links"),
    )
    found = exports.wiki_pages(spark, _files(p, "page_id", record))
    return found.select("path", "source_type", "external_url", F.md5("content").alias("content_md5"))


def export_tickets(spark, d):
    """Conversations' turns as a ticket export, with nested status and labels of two kinds."""
    c = table(spark, d, "conversations")
    key = F.concat(F.lit("C-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    record = F.struct(key.alias("key"), F.col("text").alias("summary"), F.struct(F.col("role").alias("name")).alias("status"), F.array(F.lit("a"), F.col("role")).alias("labels"), F.lit("2025-01-02T03:04:05Z").alias("updated"))
    found = exports.tickets(spark, _files(c, "conv_id", record))
    return found.select("path", F.md5("content").alias("content_md5"), F.year("time").alias("year"))


def export_pulls(spark, d):
    """Orders as pull requests by way of API payloads: flattened, written as an export and read; drafts have no body."""
    o = table(spark, d, "orders")
    n = F.col("o_orderkey").cast("string")
    payload = F.struct(
        F.col("o_orderkey").alias("number"), F.concat(F.lit("Order "), n).alias("title"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("<p>Status "), "o_orderstatus", F.lit(" &amp; priority "), "o_orderpriority", F.lit("</p>"))).alias("body"), F.col("o_orderstatus").alias("state"),
        F.concat(F.lit("https://host/pull/"), n).alias("html_url"), F.lit("2025-03-04T05:06:07Z").alias("updated_at"), F.struct(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("login")).alias("user"), F.struct(F.lit("main").alias("ref")).alias("base"),
        F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.lit(" ").alias("name"))).alias("labels"), F.lit("left out").alias("extra"),
    )
    flat = exports.flattened_pulls(o.select(F.to_json(payload).alias("record")))
    found = exports.pull_requests(spark, _lines(flat))
    return found.select("path", "author", "external_url", F.md5("content").alias("content_md5"), F.year("time").alias("year"))


def export_pager(spark, d):
    """Error events as pager incidents by way of API payloads."""
    e = table(spark, d, "events").where("event_type = 'error'")
    payload = F.struct(F.col("event_id").alias("id"), F.concat(F.lit("Error of "), F.col("user_id").cast("string")).alias("summary"), F.struct(F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("name")).alias("service"), F.lit("open").alias("status"), F.lit("high").alias("severity"), F.lit("1700000000").alias("created_at"))
    found = exports.pager_incidents(spark, _lines(exports.flattened_incidents(e.select(F.to_json(payload).alias("record")))))
    return found.select("path", "source_type", F.col("content"), F.year("time").alias("year"))


def _rich_payloads(spark, d):
    """Parts as issues whose descriptions are nested document trees of unequal depth."""
    p = table(spark, d, "part")
    leaf = lambda c: F.to_json(F.struct(F.lit("text").alias("type"), c.alias("text")))
    node = lambda kind, *inner: F.concat(F.lit('{"type": "' + kind + '", "attrs": {"text": "none"}, "content": ['), F.concat_ws(",", *inner), F.lit("]}"))
    first = node("paragraph", leaf(F.col("p_name")), leaf(F.concat(F.lit('a "'), "p_brand", F.lit('"'))))
    deep = node("bulletList", node("listItem", node("paragraph", leaf(F.col("p_type")), F.lit('{"type": "hardBreak"}'), leaf(F.lit(" end ")))), node("listItem"))
    tree = node("doc", first, F.when(F.col("p_partkey") % 2 == 0, deep))
    fields = F.struct(F.col("p_type").alias("summary"), F.lit("@tree@").alias("description"), F.struct(F.lit("Done").alias("name")).alias("status"), F.struct(F.lit("Kim").alias("name")).alias("reporter"), F.array(F.lit("x")).alias("labels"))
    payload = F.to_json(F.struct(F.when(F.col("p_partkey") % 10 > 0, F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))).alias("key"), fields.alias("fields")))
    record = F.replace(payload, F.lit('"@tree@"'), tree)
    return exports.flattened_tickets(p.select(record.alias("record")), "https://host/")


def rich_text_walk(spark, d):
    """The plain text of the trees, with the separators of paragraphs and breaks."""
    one = lambda name: F.get_json_object("record", f"$.{name}").alias(name)
    return _rich_payloads(spark, d).select(one("key"), one("description"))


def export_rich_tickets(spark, d):
    """The same by way of export files."""
    found = exports.tickets(spark, _lines(_rich_payloads(spark, d)))
    return found.select("path", "author", "external_url", F.md5("content").alias("content_md5"))


def export_notes(spark, d):
    """Suppliers as incident notes: those of even keys as JSON, the others as text in markdown."""
    s = table(spark, d, "supplier")
    base, k = f"{folder(spark)}/assay-notes-{uuid.uuid4().hex}", F.col("s_suppkey").alias("k")
    note = [F.col("s_name").alias("title"), F.concat(F.lit("Balance of nation "), F.col("s_nationkey").cast("string")).alias("body"), F.lit("ops").alias("owner")]
    # both writers name their files so that the reader takes them, so nothing is renamed afterwards
    _one_each(s.where("s_suppkey % 2 = 0").select(*note, k)).json(f"{base}/notes/json", compression="none")
    _one_each(s.where("s_suppkey % 2 = 1").select(F.concat(F.lit("# "), "s_name", F.lit("\n\nPlain.")).alias("value"), k)).text(f"{base}/notes/text", compression="none")
    found = exports.incident_notes(spark, f"{base}/notes")
    return found.select(F.regexp_extract("path", r"k=(\d+)/", 1).alias("k"), "source_type", "author", F.md5("content").alias("content_md5"))


def _one_each(rows):
    """A writer of a file for each key k: rows are dealt to all tasks, and tasks move their files into place, not the driver."""
    return _by_key(rows).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("k")


def _by_key(rows):
    """Rows by key in tasks of some thousand files."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_FILES))
    return rows.repartition(n, "k")


#: Top folders of the tree that `corpus_scan` reads, and the suppliers (by key modulo 5) whose files lie there.
_FOLDERS = ("src", "tests", "runbooks", "node_modules", "private")


def corpus_scan(spark, d):
    """Suppliers as files of a source tree, written and scanned: skipped folders, an excluded prefix, files over the size limit (keys divisible by 11) and blank ones (by 7) are left out."""
    base, s = f"{folder(spark)}/assay-tree-{uuid.uuid4().hex}", table(spark, d, "supplier")
    body = F.when(F.col("s_suppkey") % 11 == 0, F.repeat("s_name", fixed.MAX_FILE_BYTES // 8)).when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.concat(F.lit("# "), "s_name", F.lit("\nNation "), F.col("s_nationkey").cast("string"), F.lit(" – é")))
    for i, name in enumerate(_FOLDERS):
        _one_each(s.where(F.col("s_suppkey") % len(_FOLDERS) == i).select(body.alias("value"), F.col("s_suppkey").alias("k"))).text(f"{base}/{name}/deep")
    found = exports.repository(spark, base, ("private/",))
    return found.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long").alias("k"), F.split("path", "/")[0].alias("folder"), "source_type", F.md5("content").alias("content_md5"))


def lsif_graph(spark, d):
    """The dependency edges written as a line-delimited graph dump and read back, with the ranges' labels."""
    e = edges(spark, d)
    i, j, u = F.md5("src"), F.md5("dst"), F.md5(F.concat("src", F.lit(">"), "dst"))
    n = lambda p, c: F.concat(F.lit(p), c)
    row = lambda **c: F.to_json(F.struct(*[v.alias(k) if not isinstance(v, str) else F.lit(v).alias(k) for k, v in c.items()]))
    doc = lambda x, c: row(id=n("d", x), type="vertex", label="document", uri=n("file:///repo/", F.col(c)))
    has = lambda x, r: row(id=n("c", r), type="edge", label="contains", outV=n("d", x), inVs=F.array(r))
    lines = F.array(
        doc(i, "src"), doc(j, "dst"), row(id=n("r", u), type="vertex", label="range", tag=F.struct(F.lit("reference").alias("type"), F.concat(F.lit("to "), "dst").alias("text"))), has(i, n("r", u)), has(j, n("t", j)), row(id=n("n", u), type="edge", label="next", outV=n("r", u), inV=n("x", u)),
        row(id=n("m", u), type="edge", label="next", outV=n("x", u), inV=n("y", u)), row(id=n("f", u), type="edge", label="textDocument/definition", outV=n("y", u), inV=n("z", u)), row(id=n("i", u), type="edge", label="item", outV=n("z", u), inVs=F.array(n("t", j))),
    )
    path = f"{folder(spark)}/assay-lsif-{uuid.uuid4().hex}"
    e.select(F.explode(lines).alias("value")).distinct().write.text(path)
    return exports.lsif_edges(spark, path)


def _scip(spark, d):
    c = corpus(spark, d).select("path")
    name = lambda p: F.concat(F.lit("scip . lib/"), p, F.lit("#`run`()."))
    used = edges(spark, d).groupBy(F.col("src").alias("path")).agg(F.collect_list(F.struct(name(F.col("dst")).alias("symbol"))).alias("occurrences"))
    doc = F.struct(F.col("path").alias("relative_path"), "occurrences", F.array(F.struct(name(F.col("path")).alias("symbol"), F.array(F.struct(name(F.lit("src/none.py")).alias("symbol"), F.lit(True).alias("is_reference"))).alias("relationships"))).alias("symbols"))
    rows = c.hint("merge").join(used, "path", "left").withColumn("file", F.pmod(F.xxhash64("path"), F.lit(16)))
    path = f"{folder(spark)}/assay-scip-{uuid.uuid4().hex}"
    rows.groupBy("file").agg(F.to_json(F.struct(F.collect_list(doc).alias("documents"))).alias("value")).write.partitionBy("file").text(path)
    return exports.scip_edges(spark, path)


def scip_graph(spark, d):
    """The dependency edges written as symbol indexes and read back."""
    return _scip(spark, d)


def graph_summaries(spark, d):
    """Summary documents of the graph read from symbol indexes."""
    found = exports.graph_summaries(written(_scip(spark, d)), once(spark, d, "corpus", lambda: corpus(spark, d)), "index.scip")
    return found.select("path", F.md5("content").alias("content_md5"))


def graph_kinds(spark, d):
    """What kind of dump pages would be, by names and heads made of them."""
    p = table(spark, d, "pages")
    k = F.pmod("page_id", F.lit(5)).cast("int")
    name = F.concat(F.lit("dump"), F.element_at(F.array(*[F.lit(x) for x in (".lsif", ".ndjson", ".json", ".scip.json", ".json")]), k + 1))
    head = F.when(k == 4, F.lit('{"other": 1}')).otherwise(F.to_json(F.struct(F.array(F.struct(F.col("url").alias("uri"))).alias("documents"))))
    return p.select("page_id", exports.graph_kind(name, head).alias("kind"))


def _lines(records) -> str:
    """A folder of export files, each a JSON array of records."""
    path = f"{folder(records.sparkSession)}/assay-export-{uuid.uuid4().hex}"
    n = max(1, -(-records.count() // FILE_ROWS))
    arrays = records.select(F.pmod(F.xxhash64("record"), F.lit(n)).alias("file"), "record").groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return path


QUERIES = {f.__name__: f for f in (export_wiki, export_tickets, export_pulls, export_pager, export_rich_tickets, rich_text_walk, export_notes, corpus_scan, lsif_graph, scip_graph, graph_summaries, graph_kinds)}

_BODY = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _name, _char in text.ENTITIES:
    _BODY = "regexp_replace({}, '{}', '{}', 'g')".format(_BODY, _name, _char.replace("'", "''"))
_BODY = f"trim(regexp_replace({_BODY}, '\\s+', ' ', 'g'))"
ORACLE_SQL = {
    "export_wiki": f"""SELECT 'external_confluence/' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/Page-' || page_id || '.md' path, 'doc' source_type, 'https://wiki/p/' || page_id external_url,
        md5(trim('# Page ' || page_id || chr(10) || {_BODY})) content_md5 FROM pages""",
    "export_tickets": """SELECT 'external_jira/C-' || conv_id || '-' || turn || '.md' path, md5(trim('# C-' || conv_id || '-' || turn || ' ' || trim(text) || chr(10) || 'Status: ' || role || chr(10) || 'Labels: a, ' || role || chr(10))) content_md5, 2025 AS year FROM conversations""",
    "export_pulls": """SELECT 'external_github_prs/pr_' || o_orderkey || '.md' path, 'u' || o_custkey author, 'https://host/pull/' || o_orderkey external_url, md5(trim('# PR ' || o_orderkey || ': Order ' || o_orderkey || chr(10) || 'State: ' || o_orderstatus || chr(10) || 'Base: main' || chr(10) || 'Labels: ' || o_orderpriority || chr(10)
        || CASE WHEN o_orderkey % 3 > 0 THEN 'Status ' || o_orderstatus || ' & priority ' || o_orderpriority ELSE '' END, ' ')) content_md5, 2025 AS "year" FROM orders""",
    "export_pager": """SELECT 'external_pagerduty/' || event_id || '.md' path, 'incident' source_type, '# Incident ' || event_id || ': Error of ' || user_id || chr(10) || 'Status: open' || chr(10) || 'Service: s' || (user_id % 7) || chr(10) || 'Urgency: high' || chr(10) || 'No incident body provided.' AS content, 2023 AS "year" FROM events WHERE event_type = 'error'""",
    "export_rich_tickets": """SELECT 'external_jira/P-' || p_partkey || '.md' path, 'Kim' author, 'https://host/browse/P-' || p_partkey external_url, md5('# P-' || p_partkey || ' ' || p_type || chr(10) || 'Status: Done' || chr(10) || 'Labels: x' || chr(10) || p_name || ' a "' || p_brand || '"' || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_type || ' end' ELSE '' END) content_md5 FROM part WHERE p_partkey % 10 > 0""",
    "rich_text_walk": """SELECT 'P-' || p_partkey AS "key", p_name || chr(10) || 'a "' || p_brand || '"' || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_type || chr(10) || chr(10) || chr(10) || 'end' ELSE '' END description FROM part WHERE p_partkey % 10 > 0""",
    "export_notes": """SELECT CAST(s_suppkey AS VARCHAR) k, 'incident' source_type, CASE WHEN s_suppkey % 2 = 0 THEN 'ops' END author, md5(CASE WHEN s_suppkey % 2 = 0 THEN '# Incident: ' || s_name || chr(10) || chr(10) || '- Author: ops' || chr(10) || chr(10) || 'Balance of nation ' || s_nationkey ELSE '# ' || s_name || chr(10) || chr(10) || 'Plain.' || chr(10) END) content_md5 FROM supplier""",
    "corpus_scan": f"""SELECT s_suppkey k, ['src', 'tests', 'runbooks'][s_suppkey % 5 + 1] folder, CASE s_suppkey % 5 WHEN 0 THEN 'doc' WHEN 1 THEN 'test' ELSE 'runbook' END source_type, md5('# ' || s_name || chr(10) || 'Nation ' || s_nationkey || ' – é' || chr(10)) content_md5
        FROM supplier WHERE s_suppkey % 5 < 3 AND s_suppkey % 7 > 0 AND s_suppkey % 11 > 0""",
    "lsif_graph": f"WITH {CORPUS_SQL}, {EDGES_SQL} SELECT src, dst, 'to ' || dst symbol FROM edges",
    "scip_graph": f"WITH {CORPUS_SQL}, {EDGES_SQL} SELECT src, dst, 'run' symbol, 'occurrence' kind FROM edges".replace("'run' symbol", "string_split(dst, '/')[-1] || '#`run' symbol"),
    "graph_summaries": f"""WITH {CORPUS_SQL}, {EDGES_SQL}, e AS (SELECT src, dst, string_split(dst, '/')[-1] || '#`run' symbol FROM edges), n AS (SELECT DISTINCT unnest([src, dst]) path FROM e),
        x AS (SELECT path, (SELECT array_to_string(list_sort(list(DISTINCT symbol))[:12], ', ') FROM e WHERE src = path) sy, (SELECT array_to_string(list_sort(list(DISTINCT dst))[:12], ', ') FROM e WHERE src = path) r, (SELECT array_to_string(list_sort(list(DISTINCT src))[:12], ', ') FROM e WHERE dst = path) b,
          (SELECT array_to_string(list_sort(list('- ' || src || ' -> ' || dst || ' via ' || symbol || ' (occurrence)'))[:16], chr(10)) FROM e WHERE src = path) l, list_filter(list_transform(string_split(regexp_replace(content, '\\n$', ''), chr(10)), lambda x: rtrim(x)), lambda x: trim(x) <> '')[:12] t FROM n JOIN docs USING (path))
        SELECT path, md5(trim(concat_ws(chr(10), '# Native Graph Summary: ' || path, '', '- Graph exports: index.scip', '- Symbols: ' || sy, '- References: ' || r, '- Referenced by: ' || b, CASE WHEN len(t) > 0 THEN chr(10) || '## Source context' || chr(10) || array_to_string(t, chr(10)) END, chr(10) || '## Graph edges', l))) content_md5 FROM x""",
    "graph_kinds": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'lsif' WHEN 1 THEN 'lsif' WHEN 4 THEN NULL ELSE 'scip' END kind FROM pages",
}
