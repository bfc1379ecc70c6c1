"""Export files as documents: pull requests, tickets, pager incidents, wiki pages, chats, incident notes and code graphs.

Every function takes (spark, path) and returns path, source_type, content, author, external_url and time. A file is parsed
once, to VARIANT; its records' fields may be missing or of other kinds, and the first that is not empty counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions import fixed, paths, text
from assay.sources.shared import written

KINDS = {"github": "github", "github_prs": "github", "prs": "github", "jira": "jira", "tickets": "jira", "pagerduty": "pagerduty", "pager": "pagerduty", "confluence": "confluence", "wiki": "confluence", "slack": "slack", "chat": "slack", "incidents": "incidents", "incident": "incidents"}


def files(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Text files under a root: path relative to it, length, changed and content; skipped folders are judged below the root only."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = found.select(_below(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("changed"), "content")
    kept = paths.suffix(F.col("path")).isin(*fixed.TEXT_SUFFIXES) & (F.col("length") <= fixed.MAX_FILE_BYTES) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in fixed.SKIP_FOLDERS]))
    for prefix in excluded:
        kept = kept & ~F.col("path").startswith(prefix)
    return rows.where(kept)


def decoded(rows: DataFrame) -> DataFrame:
    """path and content, bytes read as UTF-8; bytes that are none are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode("utf-8", "ignore") for x in b.column(1).to_pylist()], pa.string())], ["path", "content"])

    return rows.mapInArrow(read, "path string, content string")


def repository(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    rows = decoded(files(spark, root, excluded).select("path", "content")).select("path", paths.source_type(F.col("path")).alias("source_type"), "content")
    return rows.where(F.col("content").rlike(r"\S")).select("*", *_none())


def _none() -> list[Column]:
    return [F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("external_url"), F.lit(None).cast("timestamp").alias("time")]


def parsed(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with a column of JSON text parsed to VARIANT, as `name`; null where it is none. Of repeated keys of an object the last one counts: this is set for the session."""
    rows.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return rows.withColumn(name, F.try_parse_json(column))


def _variants(value: Column, path: str = "$") -> Column:
    """Members of an array; null if it is none."""
    return F.try_variant_get(value, path, "array<variant>")


def _held(value: Column, path: str) -> Column:
    """What lies at a path; null also for a JSON null."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def records(spark: SparkSession, path: str, *keys: str, names: str = "*.{json,txt}") -> DataFrame:
    """file, place and record (VARIANT): of arrays their members, of objects those of the first collection key that they have, else the object.

    A file that is no JSON has no records. An array too large for one VARIANT is taken apart as text, and its members are parsed one by one.
    """
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("j"))
    whole, v = parsed(whole, "j", "v"), F.col("v")
    body = F.when(_variants(v).isNull(), F.coalesce(*[_held(v, f"$.{k}") for k in keys], v)).otherwise(v)
    part = F.coalesce(*[F.get_json_object("j", f"$.{k}") for k in keys], F.col("j")) if keys else F.col("j")
    large = F.transform(F.from_json(F.when(F.col("j").startswith("["), F.col("j")).otherwise(part), "array<string>"), F.try_parse_json)
    # nothing filters on v: such a filter would sink to the scan and parse each file once more
    parts = whole.select("file", body.alias("body"), F.when(v.isNull(), large).alias("large"))
    return parts.select("file", F.posexplode(F.coalesce("large", _variants(F.col("body")), F.array("body"))).alias("place", "record")).where("record IS NOT NULL AND NOT is_variant_null(record)")


def _get(*names: str) -> Column:
    return text.first_text(*[F.try_variant_get("record", f"$.{n}", "string") for n in names])


def _names(field: str, *keys: str) -> Column:
    """Members of an array of strings or of objects with a name, joined."""
    one = lambda x: F.coalesce(*[F.try_variant_get(x, f"$.{k}", "string") for k in keys], F.when(~F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "string")))
    return F.array_join(F.slice(F.filter(F.transform(F.coalesce(_variants(F.col("record"), f"$.{field}"), F.array().cast("array<variant>")), one), lambda x: x.isNotNull()), 1, 25), ", ")


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def _documents(rows: DataFrame, path: Column, kind: str, lines: list[Column], author: Column, url: Column, *times: Column) -> DataFrame:
    out = rows.select(path.alias("path"), F.lit(kind).alias("source_type"), F.trim(F.concat_ws("\n", *lines)).alias("content"), author.alias("author"), url.alias("external_url"), text.timestamp(*times).alias("time"))
    return out.where("content <> ''")


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    r = records(spark, path, "pulls", "pull_requests", "items")
    n = F.coalesce(_get("number", "id"), F.lit("0"))
    lines = [F.concat(F.lit("# PR "), n, F.lit(": "), F.coalesce(_get("title"), F.lit(""))), _line("State", _get("state")), _line("Base", _get("base.ref")), _line("Head", _get("head.ref")), _line("Labels", _names("labels", "name")), _line("Files", _names("files", "filename", "path")), text.stripped_html(F.coalesce(_get("body"), F.lit("")))]
    return _documents(r, F.concat(F.lit("external_github_prs/pr_"), n, F.lit(".md")), "pr", lines, _get("user.login", "author"), _get("html_url", "url"), _get("merged_at"), _get("updated_at"))


def tickets(spark: SparkSession, path: str) -> DataFrame:
    r = records(spark, path, "issues", "tickets", "items")
    key = F.coalesce(_get("key", "id"), F.lit("record"))
    lines = [F.concat(F.lit("# "), key, F.lit(" "), F.coalesce(_get("summary", "fields.summary", "title"), F.lit(""))), _line("Status", _get("status.name", "fields.status.name", "status")), _line("Type", _get("issuetype.name", "fields.issuetype.name", "issuetype", "issue_type")), _line("Epic", _get("epic.key", "epic")), _line("Labels", _names("labels", "name")), text.stripped_html(F.coalesce(_get("description", "fields.description"), F.lit("")))]
    return _documents(r, F.concat(F.lit("external_jira/"), text.slug(key), F.lit(".md")), "doc", lines, _get("creator.displayName", "reporter.displayName", "author"), _get("browse_url", "url"), _get("updated", "updated_at"), _get("created", "created_at"))


def pager_incidents(spark: SparkSession, path: str) -> DataFrame:
    r = records(spark, path, "incidents", "items")
    n = F.coalesce(_get("incident_number", "id"), F.lit("record"))
    lines = [F.concat(F.lit("# Incident "), n, F.lit(": "), F.coalesce(_get("title", "summary"), F.lit(""))), _line("Status", _get("status")), _line("Service", _get("service.summary", "service")), _line("Urgency", _get("urgency")), text.stripped_html(F.coalesce(_get("description", "body.details"), F.lit("")))]
    return _documents(r, F.concat(F.lit("external_pagerduty/"), text.slug(n), F.lit(".md")), "incident", lines, _get("assigned_to_user.summary"), _get("html_url"), _get("created_at"), _get("updated_at"))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    r = records(spark, path, "results", "pages", "items")
    space = F.coalesce(_get("space.key", "space"), F.lit("wiki"))
    lines = [F.concat(F.lit("# "), F.coalesce(_get("title"), F.lit(""))), text.stripped_html(F.coalesce(_get("body.storage.value", "body.view.value", "body"), F.lit("")))]
    url = F.concat(F.rtrim(F.coalesce(_get("_links.base"), F.lit("")), F.lit("/")), F.coalesce(_get("_links.webui"), F.lit("")))
    return _documents(r, F.concat(F.lit("external_confluence/"), text.slug(space), F.lit("/"), text.slug(F.coalesce(_get("title"), F.lit("record"))), F.lit(".md")), "doc", lines, _get("version.by.displayName"), F.nullif(url, F.lit("")), _get("version.when"))


def _below(path: Column, root: str) -> Column:
    """A file's path below a root, schemes apart."""
    whole, prefix = F.regexp_replace(path, "^[a-z]+:/*", "/"), F.lit(re.sub("^[a-z]+:/*", "/", root.rstrip("/")) + "/")
    return F.when(F.startswith(whole, prefix), F.substring(whole, F.length(prefix) + 1, F.length(whole))).otherwise(whole)


def incident_notes(spark: SparkSession, path: str) -> DataFrame:
    """Incident notes: JSON objects as markdown of a title, facts and body; markdown and text files as they are."""
    r = records(spark, path, names="*.json")
    author, url, at = _get("author", "owner", "reporter", "created_by"), _get("external_url", "url", "html_url", "link"), text.timestamp(_get("timestamp"), _get("created_at"), _get("updated_at"), _get("occurred_at"))
    fact = lambda label, v: F.when(v.isNotNull(), F.concat(F.lit(f"- {label}: "), v))
    facts = F.array_compact(F.array(fact("Author", author), fact("External URL", url), fact("Timestamp", at.cast("string"))))
    title = F.coalesce(_get("title", "summary", "name", "key"), paths.stem(F.col("file")))
    body = F.coalesce(_get("body", "description", "content", "details"), F.lit("No incident body provided."))
    whole = F.array_join(F.concat(F.array(F.concat(F.lit("# Incident: "), title), F.lit("")), facts, F.when(F.size(facts) > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), F.array(body)), "\n")
    place = F.concat(F.lit("external_incidents/"), F.regexp_replace(_below(F.col("file"), path), r"\.[^./]*$", ".md"))
    one = r.select(place.alias("path"), F.lit("incident").alias("source_type"), F.trim(whole).alias("content"), author.alias("author"), url.alias("external_url"), at.alias("time"))
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,rst,txt}").load(path).select(_below(F.col("path"), path).alias("path"), "content")
    two = decoded(plain).where(F.col("content").rlike(r"\S")).select(F.concat(F.lit("external_incidents/"), "path").alias("path"), F.lit("incident").alias("source_type"), "content", *_none())
    return one.unionByName(two)


def flattened_pulls(payloads: DataFrame) -> DataFrame:
    """API payloads of pull requests (column record) as export records: the fields that the reader takes, labels with a name only."""
    g, payloads = _get, parsed(payloads, "record", "record")
    named = F.transform(F.coalesce(_variants(F.col("record"), "$.labels"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$.name", "string"))
    labels = F.transform(F.filter(named, lambda x: F.trim(x) != ""), lambda x: F.struct(x.alias("name")))
    ref = lambda side: F.struct(g(f"{side}.ref").alias("ref"), F.struct(g(f"{side}.repo.full_name").alias("full_name")).alias("repo"))
    plain = [g(n).alias(n) for n in ("title", "body", "state", "html_url", "updated_at", "merged_at", "closed_at", "created_at")]
    return payloads.select(F.to_json(F.struct(g("number").cast("long").alias("number"), *plain, F.struct(g("user.login").alias("login")).alias("user"), ref("base").alias("base"), ref("head").alias("head"), labels.alias("labels"))).alias("record"))


def flattened_tickets(payloads: DataFrame, base_url: str) -> DataFrame:
    """API payloads of issues as export records; rich-text descriptions as plain text, records without key left out."""
    key, described = _get("key", "id"), F.try_variant_get("record", "$.fields.description", "string")
    payloads = parsed(payloads, "record", "record")
    tree = F.when(F.schema_of_variant(F.try_variant_get("record", "$.fields.description", "variant")).rlike("^(OBJECT|ARRAY)"), F.sha2(described, 256))
    payloads = written(payloads.select("record", tree.alias("tree")), "payloads")
    trees = payloads.select("tree", described.alias("described")).where("tree IS NOT NULL").dropDuplicates(["tree"])
    payloads = payloads.hint("merge").join(rich_texts(trees, "tree", "described").withColumnRenamed("text", "walked"), "tree", "left")
    plain = F.nullif(F.when(F.col("tree").isNotNull(), F.col("walked")).otherwise(F.trim(described)), F.lit(""))
    labels = F.coalesce(F.try_variant_get("record", "$.fields.labels", "array<string>"), F.array().cast("array<string>"))
    fields = [key.alias("key"), F.coalesce(_get("fields.summary"), key).alias("summary"), F.coalesce(plain, F.lit("No ticket description provided.")).alias("description"), _get("fields.status.name").alias("status"), _get("fields.issuetype.name").alias("issue_type"), labels.alias("labels")]
    who = _get("fields.creator.displayName", "fields.creator.name", "fields.reporter.displayName", "fields.reporter.name")
    fields += [who.alias("author"), F.concat(F.lit(base_url.rstrip("/") + "/browse/"), key).alias("browse_url"), _get("fields.updated").alias("updated_at"), _get("fields.created").alias("created_at")]
    return payloads.where(key.isNotNull()).select(F.to_json(F.struct(*fields)).alias("record"))


def flattened_incidents(payloads: DataFrame) -> DataFrame:
    g, payloads = _get, parsed(payloads, "record", "record")
    fields = [g("incident_number", "id").alias("incident_number"), g("id").alias("id"), g("title", "summary").alias("title"), F.coalesce(g("description", "body", "self"), F.lit("No incident body provided.")).alias("description"), g("status").alias("status")]
    fields += [F.struct(g("service.summary", "service.name").alias("summary")).alias("service"), g("urgency", "severity").alias("urgency"), g("html_url", "self").alias("html_url"), g("created_at").alias("created_at"), g("last_status_change_at", "updated_at").alias("updated_at")]
    return payloads.select(F.to_json(F.struct(*fields)).alias("record"))


def flattened_pages(payloads: DataFrame, public_root: str) -> DataFrame:
    """API payloads of wiki search results as export records; the link's path below the public root."""
    g, payloads = _get, parsed(payloads, "record", "record")
    body = F.coalesce(g("content.body.storage.value", "content.body.view.value", "excerpt"), F.lit("No page body provided."))
    link = g("content._links.webui", "url")
    path = F.when(link.rlike("^[a-z]+://"), F.parse_url(link, F.lit("PATH"))).otherwise(link)
    fields = [g("content.title", "title", "content.id").alias("title"), F.struct(F.struct(body.alias("value")).alias("storage")).alias("body"), F.struct(F.coalesce(g("content.space.key", "content.space.name"), F.lit("space")).alias("key")).alias("space")]
    fields += [F.struct(F.struct(g("content.version.by.displayName", "content.history.createdBy.displayName").alias("displayName")).alias("by"), g("content.version.when", "lastModified").alias("when")).alias("version"), F.struct(F.lit(public_root.rstrip("/")).alias("base"), path.alias("webui")).alias("_links")]
    return payloads.select(F.to_json(F.struct(*fields)).alias("record"))


def graph_kind(name: Column, head: Column) -> Column:
    """lsif, scip or null: what kind of code-graph dump a file is, by its name, and for JSON by its content."""
    n = F.lower(name)
    listed = F.get_json_object(head, "$.documents[*].relative_path").isNotNull() | F.get_json_object(head, "$.documents[*].path").isNotNull() | F.get_json_object(head, "$.documents[*].uri").isNotNull()
    return F.when(n.contains(".lsif") | n.endswith(".ndjson"), "lsif").when(n.rlike(r"\.(json|scip)$|\.scip\.") & listed, "scip")


def merged_messages(history: DataFrame, replies: DataFrame) -> DataFrame:
    """One row for each channel and ts; a reply wins over the history's row."""
    both = history.withColumn("origin", F.lit(0)).unionByName(replies.withColumn("origin", F.lit(1)))
    w = Window.partitionBy("channel", "ts").orderBy(F.desc("origin"))
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "origin")


def threads(messages: DataFrame, keys: list[str], most: int = 25) -> DataFrame:
    """keys, content, author (of the first message) and n_messages; messages: the keys, `at` to order by, author and text, of which empty ones do not count.

    Messages are ranked first, so a long thread never gathers more than it keeps.
    """
    rows = messages.where(F.trim("text") != "").withColumn("author", F.coalesce("author", F.lit("unknown")))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "author", "text"))).where(F.col("n") <= most)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "author", "text"))), lambda x: F.concat(x["author"], F.lit(": "), x["text"])), "\n")
    kept = first.groupBy(*keys).agg(body.alias("content"), F.max(F.when(F.col("n") == 1, F.col("author"))).alias("author"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_messages")).hint("merge").join(kept, keys).select(*keys, "content", "author", "n_messages")


def chat_threads(spark: SparkSession, path: str) -> DataFrame:
    """Threads as documents: messages with text by ts, 25 of them at most, the first one's author; the channel is the folder."""
    r = records(spark, path, "messages")
    m = r.select(F.element_at(F.split("file", "/"), -2).alias("channel"), _get("ts").alias("ts"), F.coalesce(_get("thread_ts"), _get("ts")).alias("thread"), _get("user_profile.display_name", "username", "user").alias("author"), _get("text").alias("text")).where("text IS NOT NULL AND ts IS NOT NULL")
    t = threads(m.withColumn("at", F.col("ts").cast("decimal(20,6)")), ["channel", "thread"])
    return t.select(F.concat(F.lit("external_slack/"), text.slug(F.col("channel")), F.lit("/"), text.slug(F.col("thread")), F.lit(".md")).alias("path"), F.lit("incident").alias("source_type"), "content", "author", F.lit(None).cast("string").alias("external_url"), text.timestamp(F.col("thread")).alias("time"))


def rich_texts(trees: DataFrame, key: str, column: str) -> DataFrame:
    """key and text: the plain text of document trees given as JSON, by rounds of `variant_explode`, one for each depth.

    A node's own text ends its branch; a hard break is a line break; what a paragraph or heading holds, and a bare list's members, are joined by line breaks, the content of
    other nodes by spaces, empty parts left out. Attributes are no content. A JSON string is its own text; what is no JSON has an empty one.
    """
    v = lambda path, kind: F.try_variant_get("v", path, kind)
    stripped = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    own, kind = F.nullif(stripped(v("$.text", "string")), F.lit("")), v("$.type", "string")
    done = F.when(F.schema_of_variant("v") == "STRING", stripped(v("$", "string"))).otherwise(F.coalesce(own, F.when(kind == "hardBreak", F.lit("\n"))))
    apart = F.when(v("$", "array<variant>").isNotNull() | kind.isin("paragraph", "heading"), "\n").otherwise(" ")
    level = trees.select(key, F.array().cast("array<int>").alias("place"), F.try_parse_json(column).alias("v"))
    levels = []
    while True:
        nodes = level.select(key, "place", done.alias("done"), apart.alias("apart"), F.coalesce(v("$", "array<variant>"), v("$.content", "array<variant>")).alias("inner"))
        levels.append(written(nodes.withColumn("inner", F.when(F.col("done").isNull(), F.col("inner"))), "nodes"))
        inner = levels[-1].where("size(inner) > 0")
        if inner.isEmpty():
            break
        level = inner.select(key, "place", F.posexplode("inner").alias("at", "v")).select(key, F.concat("place", F.array("at")).alias("place"), "v")
    below = None
    for nodes in reversed(levels):
        texts = nodes.select(key, "place", "apart", F.coalesce("done", F.lit("")).alias("text"))
        if below is not None:
            up = below.where("text <> ''").select(key, F.slice("place", F.lit(1), F.size("place") - 1).alias("place"), F.element_at("place", -1).alias("at"), "text")
            held = up.groupBy(key, "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("parts"))
            texts = texts.hint("merge").join(held, [key, "place"], "left").select(key, "place", "apart", F.when(F.col("parts").isNull(), F.col("text")).otherwise(stripped(F.array_join("parts", "\u0000"))).alias("text"))
            texts = texts.withColumn("text", F.expr("replace(text, chr(0), apart)"))
        below = texts
    return below.select(key, "text")


def lsif_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst and symbol of line-delimited graph dumps: from a range's document to the document that its definition lies in; symbol is the range's label."""
    schema = "id string, type string, label string, uri string, outV string, inV string, inVs array<string>, property string, tag struct<type string, text string, symbol string, detail string>"
    e = spark.read.schema(schema).json(path)
    to = F.explode(F.array_distinct(F.array_compact(F.concat(F.array("inV"), F.coalesce("inVs", F.array().cast("array<string>"))))))
    docs = e.where("label = 'document'").select(F.col("id").alias("doc"), F.regexp_replace("uri", "^file://(/[^/]*)?/", "").alias("path"))
    edge = written(e.where("type = 'edge'").select("label", "outV", to.alias("inV")), "graph")
    held = edge.where("label = 'contains'").select(F.col("outV").alias("doc"), F.col("inV").alias("range"))
    tag = text.first_text(F.col("tag.text"), F.col("tag.symbol"), F.col("tag.detail"), F.col("tag.type"))
    names = e.where("label = 'range'").select(F.col("id").alias("range"), F.coalesce(tag, F.lit("graph reference")).alias("symbol"))
    owner = written(held.hint("merge").join(docs, "doc").hint("merge").join(names, "range", "left").select("range", "path", F.coalesce("symbol", F.lit("graph reference")).alias("symbol")), "ranges")
    ends = chain_ends(edge.where("label = 'next'").select(F.col("outV").alias("a"), F.col("inV").alias("b")))
    results = edge.where("label IN ('textDocument/definition', 'textDocument/references')").select(F.col("outV").alias("at"), F.col("inV").alias("result"))
    chained = owner.hint("merge").join(ends.withColumnRenamed("a", "range"), "range", "left").select("path", "symbol", F.coalesce("b", "range").alias("at"))
    of_range = chained.unionByName(owner.select("path", "symbol", F.col("range").alias("at"))).distinct()
    target = edge.where("label = 'item'").select(F.col("outV").alias("result"), F.col("inV").alias("range")).hint("merge").join(owner.select("range", F.col("path").alias("dst")), "range").select("result", "dst")
    return of_range.hint("merge").join(results, "at").hint("merge").join(target, "result").select(F.col("path").alias("src"), "dst", "symbol").where("src <> dst").distinct()


def chain_ends(nexts: DataFrame) -> DataFrame:
    """The end of the chain from each node (a to b), by doubling; nodes of a cycle, and of chains into it, end at the cycle's least node.

    A round doubles the steps that a row stands for, and takes along the least node on the way. A node that is the least on its own way has gone round a cycle and is the
    cycle's least; whoever has met it ends there. Rows that have ended are looked up but neither followed nor written again: rounds go by the longest chain or cycle.
    """
    first = written(nexts.groupBy("a").agg(F.min("b").alias("b")), "chain")
    ended, active = first.where("b IS NULL").select("a", F.col("b").alias("end")), first.where("b IS NOT NULL").withColumn("least", F.col("b"))
    while not active.isEmpty():
        roots = written(active.where("least = a").select(F.col("a").alias("least"), F.col("a").alias("end")), "roots")
        met = active.withColumn("end", F.lit(None).cast("string")) if roots.isEmpty() else written(active.hint("merge").join(roots, "least", "left").select("a", "b", "least", "end"), "met")
        ended = ended.unionByName(met.where("end IS NOT NULL").select("a", "end"))
        going = met.where("end IS NULL")
        on = going.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("least").alias("l"), "end")
        on = on.unionByName(ended.select(F.col("a").alias("b"), F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("l"), "end"))
        joined = going.drop("end").hint("merge").join(on, "b", "left")
        now = written(joined.select("a", F.coalesce("c", "b").alias("b"), F.least("least", "l").alias("least"), F.coalesce("end", F.when(F.col("c").isNull(), F.col("b"))).alias("end")), "chain")
        ended, active = ended.unionByName(now.where("end IS NOT NULL").select("a", "end")), now.where("end IS NULL").drop("end")
    return ended.select("a", F.col("end").alias("b"))


def scip_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, symbol and kind: from the documents in which a symbol occurs to the one that defines it, and from those of symbols related to it."""
    kinds = ("is_reference", "is_implementation", "is_type_definition", "is_definition")
    schema = f"documents array<struct<relative_path string, occurrences array<struct<symbol string>>, symbols array<struct<symbol string, relationships array<struct<symbol string, {', '.join(f'{k} boolean' for k in kinds)}>>>>>>"
    d = written(spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).select(F.explode("documents").alias("d")).select("d.*"), "graph")
    defined = d.select(F.col("relative_path").alias("dst"), F.explode("symbols").alias("s")).select("dst", "s.symbol", "s.relationships")
    used = d.select(F.col("relative_path").alias("src"), F.explode("occurrences").alias("o")).select("src", "o.symbol", F.lit("occurrence").alias("kind"))
    related = defined.select(F.col("dst").alias("src"), F.explode("relationships").alias("r")).select("src", "r.symbol", text.relation_kind(*[F.coalesce(F.col(f"r.{k}"), F.lit(False)) for k in kinds]).alias("kind"))
    return used.unionByName(related).hint("merge").join(defined.select("dst", "symbol"), "symbol").where("src <> dst").select("src", "dst", text.symbol_name(F.col("symbol")).alias("symbol"), "kind").distinct()


def graph_summaries(edges: DataFrame, files: DataFrame, exports: str, *, most: int = 12, most_edges: int = 16) -> DataFrame:
    """path and content: for each file of a graph (src, dst, symbol, kind) its symbols, references and referrers, its first lines and its first edges. A hub's are ranked before they are gathered."""

    def first(rows: DataFrame, by: str, n: int, name: str, sep: str) -> DataFrame:
        ranked = rows.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(by))).where(F.col("_n") <= n)
        return ranked.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", by))), lambda x: x[by]), sep).alias(name))

    out, into = edges.select(F.col("src").alias("path"), F.col("dst").alias("x")), edges.select(F.col("dst").alias("path"), F.col("src").alias("x"))
    line = F.concat(F.lit("- "), "src", F.lit(" -> "), "dst", F.lit(" via "), "symbol", F.lit(" ("), "kind", F.lit(")")).alias("x")
    parts = {"symbols": first(edges.select(F.col("src").alias("path"), F.col("symbol").alias("x")), "x", most, "symbols", ", "), "to": first(out, "x", most, "to", ", "), "from": first(into, "x", most, "from", ", "), "lines": first(edges.select(F.col("src").alias("path"), line), "x", most_edges, "lines", "\n")}
    rows = out.select("path").union(into.select("path")).distinct()
    for part in parts.values():
        rows = rows.hint("merge").join(part, "path", "left")
    shown = F.slice(F.filter(F.transform(text.lines(F.col("content")), lambda x: F.rtrim(x)), lambda x: F.trim(x) != ""), 1, 12)
    rows = rows.hint("merge").join(files.select("path", shown.alias("excerpt")), "path", "left")
    body = [F.concat(F.lit("# Native Graph Summary: "), "path"), F.lit(""), F.lit(f"- Graph exports: {exports}"), F.concat(F.lit("- Symbols: "), "symbols"), F.concat(F.lit("- References: "), "to"), F.concat(F.lit("- Referenced by: "), "from")]
    body += [F.when(F.size("excerpt") > 0, F.concat(F.lit("\n## Source context\n"), F.array_join("excerpt", "\n"))), F.lit("\n## Graph edges"), F.col("lines")]
    return rows.select("path", F.trim(F.concat_ws("\n", *body)).alias("content"))


def merged_sources(*lists: DataFrame) -> DataFrame:
    """Source lists (type, path, list, ordinal) as one: of a type (in any case) and path the first list's first row stays."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    w = Window.partitionBy(F.lower("type"), "path").orderBy("list", "ordinal")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


READERS = {"github": pull_requests, "jira": tickets, "pagerduty": pager_incidents, "confluence": wiki_pages, "slack": chat_threads, "incidents": incident_notes}


def sources(spark: SparkSession, specs: list[tuple[str, str]]) -> DataFrame | None:
    """Documents of all (kind, path) specs, each once whatever its alias; unknown kinds are an error."""
    out = None
    for kind, path in dict.fromkeys((KINDS[k.strip().lower()], p) for k, p in specs):
        part = READERS[kind](spark, path)
        out = part if out is None else out.unionByName(part)
    return out
