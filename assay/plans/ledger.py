"""Queries on the ledger and the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.functions import fixed
from assay.operators import catalog, decide
from assay.operators import ledger as ops
from assay.plans import decisions
from assay.sources import exports
from assay.sources.shared import folder, once, written
from assay.sources.tables import CORPUS_SQL, LEDGER_SQL, REQUESTS_SQL, corpus, ledger, requests, sized, table


def healing_sequences(spark, d):
    return ops.sequences(ledger(spark, d)).select("fingerprint", "first_blocked", "latest_blocked", "healed", "blocked_attempts", "minutes")


def healing_summary(spark, d):
    return ops.healing(ops.sequences(ledger(spark, d)))


def recent_heals(spark, d):
    return ops.sequences(ledger(spark, d)).where("healed IS NOT NULL").orderBy(F.desc("healed_at"), F.desc("healed")).limit(5).select("fingerprint", "first_blocked", "healed", "blocked_attempts", "minutes")


def records(spark, d):
    """The ledger with the blast radius and linked incidents of the request that an action is about: that of its fingerprint modulo 40."""

    def make():
        f = decisions.features(spark, d).where("request_id < 40").select(F.col("request_id").alias("about"), F.col("impacted_files").alias("files"), F.col("impacted_tests").alias("tests"), F.col("impacted_docs").alias("docs"), F.col("impacted_runbooks").alias("runbooks"), F.col("incident_twin").alias("linked"))
        out = ledger(spark, d).withColumn("about", F.pmod("fingerprint", F.lit(40))).join(sized(written(f, "about")), "about", "left").drop("about")
        return out.na.fill(0, ["files", "tests", "docs", "runbooks"]).na.fill(False, ["linked"])

    return once(spark, d, "records", make)


def headline_metrics(spark, d):
    return ops.headline(records(spark, d))


def dashboard_overview(spark, d):
    """The latest 250 actions, of those the ones of even fingerprints, in one row."""
    return ops.overview(records(spark, d), only=F.col("fingerprint") % 2 == 0)


def decision_signals(spark, d):
    return ops.signals(decide.split(decisions.ranked(spark, d))).select("request_id", "place", "label", "source", "relation", "title", "summary")


def pr_comments(spark, d):
    return ops.comment(decisions.actions(spark, d)).select("request_id", "policy", F.md5("comment").alias("comment_md5"))


def action_fingerprints(spark, d):
    """Fingerprints of the requests as actions of a repository, and the text that they are decided on."""
    r = requests(spark, d)
    diff = F.when(F.col("request_id") % 2 == 0, F.array_join("changed_paths", ", "))
    return r.select("request_id", F.md5(ops.fingerprint(F.lit("repo"), F.col("query"), F.col("changed_paths"))).alias("fingerprint"), F.md5(decide.query_text(F.col("query"), diff)).alias("query_md5"))


def ledger_lookup(spark, d):
    """The decisions that orders name by their keys."""
    return ops.by_id(ledger(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("decision_id"))).select("decision_id", "fingerprint", "blocked")


def ledger_upsert(spark, d):
    """Purchases come again as changes of their fingerprint's sign, twice over; the later change wins."""
    led = ledger(spark, d).select("decision_id", "fingerprint", "blocked").withColumn("version", F.lit(0))
    c = led.where("NOT blocked")
    changes = c.withColumns({"fingerprint": -F.col("fingerprint"), "version": F.lit(1)}).unionByName(c.withColumns({"fingerprint": -F.col("fingerprint") - 1, "version": F.lit(2)}))
    return ops.upserted(led, changes, "decision_id", F.desc("version"))


def ledger_import(spark, d):
    """The ledger written as JSON lines and, once more with another kind, as a folder of JSON files; the lines win."""
    led = ledger(spark, d).select("decision_id", "fingerprint", F.col("event_type").alias("kind"))
    base = f"{folder(spark)}/assay-import-{uuid.uuid4().hex}"
    led.where("fingerprint % 3 < 2").select(F.to_json(F.struct("*")).alias("value")).write.text(f"{base}/lines")
    led.where("fingerprint % 3 > 0").withColumn("kind", F.lit("file")).select(F.to_json(F.struct("*")).alias("value"), F.pmod("decision_id", F.lit(8)).alias("part")).groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).write.partitionBy("part").text(f"{base}/files")
    return ops.imported(spark, f"{base}/lines", f"{base}/files", "decision_id long, fingerprint long, kind string")


def lookback_clauses(spark, d):
    """For each event type, clauses for the time since each user's last event of it."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("now"))
    each = e.groupBy("event_type", "user_id").agg(F.max("ts").alias("at")).join(F.broadcast(last), how="cross")
    seconds = F.floor((F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6)
    return each.select("event_type", "user_id", ops.lookback(seconds, 7).alias("clause"))


def merged_sources(spark, d):
    """Explicit and live source lists made of suppliers and customers; of a type and path the explicit one stays."""
    s = table(spark, d, "supplier").select(F.lit("Jira").alias("type"), F.format_string("exports/%d", F.col("s_suppkey") % 50).alias("path"), F.lit(0).alias("list"), F.col("s_suppkey").alias("ordinal"))
    c = table(spark, d, "customer").select(F.lit("jira").alias("type"), F.format_string("exports/%d", F.col("c_custkey") % 90).alias("path"), F.lit(1).alias("list"), F.col("c_custkey").alias("ordinal"))
    return exports.merged_sources(s, c).select("type", "path", "list", "ordinal")


def risk_feed(spark, d):
    led = ledger(spark, d)
    return ops.feed(ops.sequences(led), led, 12).select("decision_id", "status", "healed_decision_id", "signal")


def recent_then_filter(spark, d):
    """The latest 250 decisions, then those of one user: the limit comes first."""
    return ops.latest(ledger(spark, d), 250).where("fingerprint < 20").select("decision_id", "fingerprint", "blocked")


def ledger_jsonl(spark, d):
    """The ledger as JSON lines in the order of its ids, written and read back; place is a line's number in the file."""
    path = f"{folder(spark)}/assay-jsonl-{uuid.uuid4().hex}"
    ops.as_lines(ledger(spark, d).select("decision_id", "fingerprint", "blocked", "event_type"), path)
    lines = ops.numbered_lines(spark, path)
    return lines.select(F.from_json("line", "decision_id long, fingerprint long, blocked boolean, event_type string").alias("r"), "line", "place").select("r.*", F.length("line").alias("n_chars"), "place")


def ledger_dedupe(spark, d):
    """Two imports of overlapping events; the first import's row of an id wins."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    both = e.where("event_type <> 'error'").withColumn("origin", F.lit(1)).unionByName(e.withColumn("origin", F.lit(2)))
    return ops.first_wins(both, "event_id", "origin").select("event_id", "user_id", "origin")


def lookback_filter(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last.limit(1)), F.col("ts") >= F.col("last") - F.expr("INTERVAL 36 HOURS")).select("event_id", "event_type")


def signal_classes(spark, d):
    c = corpus(spark, d)
    return c.groupBy(F.coalesce(ops.signal_kind(F.col("path")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def fingerprint_snapshot(spark, d):
    c = corpus(spark, d)
    files = c.select(F.col("source").alias("corpus"), "path", F.length("content").cast("long").alias("size"), F.pmod("doc_id", F.lit(97)).alias("changed"))
    return catalog.snapshot(files)


def changed_files(spark, d):
    c = corpus(spark, d)
    now = c.select(F.col("source").alias("corpus"), "path", F.length("content").cast("long").alias("size"), F.pmod("doc_id", F.lit(97)).alias("changed"))
    before = now.where("changed <> 5").withColumn("size", F.when(F.col("changed") == 7, F.col("size") + 1).otherwise(F.col("size")))
    return catalog.delta(now, before).select("corpus", "path", "changed")


def _manifests(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'signup'").select(F.col("user_id").alias("corpus"), F.col("event_id").alias("build_id"), F.col("ts").alias("built_at"), F.when(F.col("value") < 10, "stale").otherwise("ready").alias("status"))


def corpus_list(spark, d):
    """In order: place is that of a corpus in the list."""
    listed = catalog.listed(_manifests(spark, d))
    ready = F.when(F.col("status") == "ready", 0).otherwise(1)
    return listed.select("corpus", "build_id", "status", ready.alias("group"))


def superseded(spark, d):
    return catalog.newest(_manifests(spark, d)).where("n > 1").groupBy("corpus").agg(F.count("*").alias("n_builds"), F.max("build_id").alias("last_build"))


def freshness_status(spark, d):
    m = _manifests(spark, d)
    kept = catalog.newest(m).where("n = 1").select("corpus", F.pmod("build_id", F.lit(5)).alias("fingerprint"))
    now = table(spark, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("corpus")).agg(F.pmod(F.max("event_id"), F.lit(5)).alias("fingerprint"))
    return catalog.freshness(kept, now)


def retention_plan(spark, d):
    m = catalog.newest(_manifests(spark, d)).where("n = 1").drop("n")
    last = table(spark, d, "events").agg(F.max("ts")).first()[0]
    return catalog.retention(m, F.lit(last), 48, 20).select("corpus", "build_id", "reason")


def build_plan(spark, d):
    """Corpora wanted by users who viewed, against the builds of those who signed up; settings change for odd users."""
    sign = F.when(F.col("corpus") % 2 == 1, catalog.settings_signature(window=96, stride=48)).otherwise(catalog.settings_signature(window=96, stride=32))
    wanted = table(spark, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("corpus")).agg(F.pmod(F.max("event_id"), F.lit(5)).alias("fingerprint")).withColumn("signature", catalog.settings_signature(stride=48, window=96))
    m = _manifests(spark, d).withColumn("fingerprint", F.pmod("build_id", F.lit(5))).withColumn("signature", sign)
    return catalog.build_plan(wanted, m)


def deletion_plan(spark, d):
    wanted = table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("corpus"))
    return catalog.deletion(_manifests(spark, d), wanted, dry_run=True)


def prune_plan(spark, d):
    return catalog.pruned(_manifests(spark, d), stale_only=True)


def corpus_keys(spark, d):
    c = corpus(spark, d).groupBy("source").agg(F.collect_set("source_type").alias("kinds"))
    return c.select("source", catalog.corpus_key(F.col("source"), F.col("kinds"), catalog.settings_signature(window=96, stride=48)).alias("corpus_key"))


def persisted_corpus(spark, d):
    """Each language as a corpus: written twice (the second time only English, one document less), one deleted, and read back."""
    base = f"{folder(spark)}/assay-builds-{uuid.uuid4().hex}"
    docs = corpus(spark, d).select(F.col("lang").alias("corpus"), "path", "content")
    manifest = lambda rows: rows.groupBy("corpus").agg(F.count("*").alias("n_documents"))
    catalog.persist({"documents": docs}, manifest(docs), base)
    again = docs.where("corpus = 'en' AND path NOT LIKE 'incidents/%'")
    catalog.persist({"documents": again}, manifest(again), base)
    catalog.drop(spark, base, ["documents", "manifests"], ["fr", "none"])
    read = lambda name: catalog.read(spark, base, name)
    return read("documents").groupBy("corpus").agg(F.count("*").alias("n")).join(read("manifests"), "corpus").select("corpus", "n", "n_documents")


def retention_counts(spark, d):
    return retention_plan(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def policy_labels(spark, d):
    """Labels of the policies that nations choose (even keys strict, odd ones agile), each with its own limit on files, its key, over the preset's."""
    n = table(spark, d, "nation").select("n_name", "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "strict").otherwise("agile").alias("policy"))
    own = n.join(decide.policies(spark).hint("broadcast"), "policy").withColumn("max_files", F.col("n_nationkey").cast("int"))
    return own.select("n_name", F.col("policy").alias("preset"), F.array_join(ops.labels(own), "|").alias("labels"))


QUERIES = {
    f.__name__: f
    for f in (healing_sequences, healing_summary, recent_heals, headline_metrics, risk_feed, recent_then_filter, ledger_jsonl, ledger_dedupe, lookback_filter, signal_classes, fingerprint_snapshot, changed_files, corpus_list, superseded, freshness_status, retention_plan, retention_counts, policy_labels,
              dashboard_overview, decision_signals, pr_comments, action_fingerprints, ledger_lookup, ledger_upsert, ledger_import, lookback_clauses, merged_sources, build_plan, deletion_plan, prune_plan, corpus_keys, persisted_corpus)
}

_SEQ = f"""WITH {LEDGER_SQL}, s AS (SELECT *, coalesce(sum(CASE WHEN blocked THEN 0 ELSE 1 END) OVER (PARTITION BY fingerprint ORDER BY created_at, decision_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) seq FROM ledger),
q AS (SELECT fingerprint, seq, count(*) FILTER (WHERE blocked) blocked_attempts, arg_min(decision_id, (created_at, -decision_id)) FILTER (WHERE blocked) first_blocked, arg_max(decision_id, (created_at, -decision_id)) FILTER (WHERE blocked) latest_blocked,
  max(decision_id) FILTER (WHERE NOT blocked) healed, max(created_at) FILTER (WHERE NOT blocked) healed_at, round((epoch_us(max(created_at) FILTER (WHERE NOT blocked)) - epoch_us(min(created_at) FILTER (WHERE blocked))) / 6e7, 4) AS minutes FROM s GROUP BY ALL HAVING count(*) FILTER (WHERE blocked) > 0)"""
_M = "m AS (SELECT user_id corpus, event_id build_id, ts built_at, CASE WHEN value < 10 THEN 'stale' ELSE 'ready' END status FROM events WHERE event_type = 'signup'), nm AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY built_at DESC, build_id DESC) n FROM m)"
_RET = f"""WITH {_M}, r AS (SELECT corpus, build_id, row_number() OVER (ORDER BY built_at DESC, build_id DESC) rank, status, (SELECT epoch_us(max(ts)) FROM events) - epoch_us(built_at) age FROM nm WHERE n = 1),
p AS (SELECT corpus, build_id, CASE WHEN status = 'stale' THEN 'stale' WHEN age / 3.6e9 >= 48 THEN 'expired' WHEN rank > 20 THEN 'overflow' END reason FROM r)"""
_PRESETS = {p[0]: dict(zip([c.split()[0] for c in decide.POLICY_SCHEMA.split(", ")], p, strict=True)) for p in fixed.POLICIES}
_LABELS = {name: "|".join(label + ("" if p[c] is True else ": ' || n_nationkey || '" if c == "max_files" else f": {p[c]}") for c, label in fixed.POLICY_LABELS.items() if p[c] not in (None, False)) for name, p in _PRESETS.items()}
_RECORDS = f"{decisions._FEATURES}, {LEDGER_SQL}, rec AS (SELECT ledger.*, coalesce(files, 0) files, coalesce(tests, 0) tests, coalesce(docs, 0) docs, coalesce(runbooks, 0) runbooks, coalesce(incident_twin, FALSE) linked FROM ledger LEFT JOIN (SELECT request_id, fe.files, fe.tests, im.docs, im.runbooks, incident_twin FROM fe LEFT JOIN im USING (request_id)) f ON f.request_id = fingerprint % 40)"
_HEADLINE = "count(*) FILTER (WHERE blocked) blocked_actions, count(*) FILTER (WHERE blocked AND linked) incident_linked, " + ", ".join(f"CAST(coalesce(sum({c}) FILTER (WHERE blocked), 0) AS BIGINT) protected_{c}" for c in ("files", "tests", "docs", "runbooks")) + ", count(*) actions"
ORACLE_SQL = {
    "healing_sequences": f"{_SEQ} SELECT fingerprint, first_blocked, latest_blocked, healed, blocked_attempts, minutes FROM q",
    "healing_summary": f"{_SEQ} SELECT count(*) blocked_sequences, count(healed) healed_sequences, count(*) - count(healed) unresolved_sequences, round(count(healed) / greatest(1, count(*)), 6) healing_rate, round(avg(blocked_attempts) FILTER (WHERE healed IS NOT NULL), 4) average_retries, round(median(minutes) + 1e-7, 4) median_minutes FROM q",
    "recent_heals": f"{_SEQ} SELECT fingerprint, first_blocked, healed, blocked_attempts, minutes FROM q WHERE healed IS NOT NULL ORDER BY healed_at DESC, healed DESC LIMIT 5",
    "headline_metrics": f"{_RECORDS} SELECT {_HEADLINE} FROM rec",
    "dashboard_overview": f"""{_RECORDS}, r250 AS (SELECT * FROM (SELECT * FROM rec ORDER BY decision_id DESC LIMIT 250) WHERE fingerprint % 2 = 0),
        sx AS (SELECT *, coalesce(sum(CASE WHEN blocked THEN 0 ELSE 1 END) OVER (PARTITION BY fingerprint ORDER BY created_at, decision_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) seq FROM r250),
        qx AS (SELECT fingerprint, seq, count(*) FILTER (WHERE blocked) blocked_attempts, arg_min(decision_id, (created_at, -decision_id)) FILTER (WHERE blocked) first_blocked, arg_max(decision_id, (created_at, -decision_id)) FILTER (WHERE blocked) latest_blocked, max(decision_id) FILTER (WHERE NOT blocked) healed, max(created_at) FILTER (WHERE NOT blocked) healed_at,
          round((epoch_us(max(created_at) FILTER (WHERE NOT blocked)) - epoch_us(min(created_at) FILTER (WHERE blocked))) / 6e7, 4) AS minutes FROM sx GROUP BY ALL HAVING count(*) FILTER (WHERE blocked) > 0),
        fx AS (SELECT first_blocked decision_id, 'healed_on_retry' status FROM qx WHERE healed IS NOT NULL UNION ALL SELECT latest_blocked, 'still_blocked' FROM qx WHERE healed IS NULL), gx AS (SELECT decision_id, status, linked, created_at FROM fx JOIN r250 USING (decision_id) ORDER BY linked DESC, created_at DESC, decision_id LIMIT 12)
        SELECT * FROM (SELECT {_HEADLINE} FROM r250), (SELECT count(*) blocked_sequences, count(healed) healed_sequences, count(*) - count(healed) unresolved_sequences, round(count(healed) / greatest(1, count(*)), 6) healing_rate, round(avg(blocked_attempts) FILTER (WHERE healed IS NOT NULL), 4) average_retries, round(median(minutes) + 1e-7, 4) median_minutes FROM qx),
          (SELECT coalesce(string_agg(first_blocked || '>' || healed, '|' ORDER BY healed_at DESC, healed DESC), '') recent_heals FROM (SELECT * FROM qx WHERE healed IS NOT NULL ORDER BY healed_at DESC, healed DESC LIMIT 5)), (SELECT coalesce(string_agg(decision_id || ':' || status, '|' ORDER BY linked DESC, created_at DESC, decision_id), '') risk_feed FROM gx)""",
    "decision_signals": f"""{decisions._FEATURES}, sg2 AS (SELECT DISTINCT request_id, path source, CASE WHEN twin THEN 'twin_case' ELSE 'evidence_span' END relation, CASE WHEN path LIKE 'incidents/%' THEN 'Incident' ELSE 'GitHub PR' END AS label, CASE WHEN length(snippet) <= 180 THEN snippet ELSE rtrim(snippet[:179]) || '…' END summary FROM parts WHERE path LIKE 'incidents/%' OR path LIKE 'prs/%')
        SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY label, source, relation) AS INTEGER) place, label, source, relation, split_part(summary, '. ', 1)[:96] title, summary FROM sg2""",
    "pr_comments": f"""{decisions._ACTIONS} SELECT request_id, policy, md5(concat_ws(chr(10), '## Decision: ' || decision || CASE WHEN decision = 'admit' THEN ' (allowed)' ELSE ' (blocked)' END, format('Hazard {{:.2f}}, confidence {{:.2f}}, {{}} files affected.', hazard, confidence, files),
        CASE WHEN len(missing) > 0 THEN chr(10) || '### Missing evidence' || chr(10) || '- ' || array_to_string(missing, chr(10) || '- ') END, CASE WHEN len(violations) > 0 THEN chr(10) || '### Policy violations' || chr(10) || '- ' || array_to_string(violations, chr(10) || '- ') END,
        CASE WHEN decision <> 'admit' THEN 'Blocked: ' || decision || '. Resolve: ' || array_to_string(missing[:3], '; ') END)) comment_md5 FROM ac""",
    "action_fingerprints": f"WITH {CORPUS_SQL}, {REQUESTS_SQL} SELECT request_id, md5('repo::' || lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) || '::' || array_to_string(list_sort(changed_paths), '|')) fingerprint, md5(query || CASE WHEN request_id % 2 = 0 THEN chr(10) || chr(10) || 'Diff summary:' || chr(10) || array_to_string(changed_paths, ', ') ELSE '' END) query_md5 FROM reqs",
    "ledger_lookup": f"WITH {LEDGER_SQL} SELECT decision_id, fingerprint, blocked FROM ledger WHERE decision_id IN (SELECT o_orderkey FROM orders)",
    "ledger_upsert": f"WITH {LEDGER_SQL} SELECT decision_id, CASE WHEN blocked THEN fingerprint ELSE -fingerprint - 1 END fingerprint, blocked, CASE WHEN blocked THEN 0 ELSE 2 END AS version FROM ledger",
    "ledger_import": f"WITH {LEDGER_SQL} SELECT decision_id, fingerprint, CASE WHEN fingerprint % 3 < 2 THEN event_type ELSE 'file' END kind FROM ledger",
    "lookback_clauses": """WITH s AS (SELECT event_type, user_id, greatest(60, CAST(floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 1e6) AS BIGINT)) s FROM events GROUP BY ALL)
        SELECT event_type, user_id, CASE WHEN ceil(s / 60) < 60 THEN '-' || CAST(ceil(s / 60) AS BIGINT) || 'm' WHEN ceil(s / 60) < 1440 THEN '-' || CAST(ceil(s / 3600) AS BIGINT) || 'h' ELSE '-' || CAST(ceil(s / 86400) AS BIGINT) || 'd' END clause FROM s""",
    "merged_sources": """SELECT "type", path, "list", ordinal FROM (SELECT *, row_number() OVER (PARTITION BY lower("type"), path ORDER BY "list", ordinal) n FROM (SELECT 'Jira' "type", 'exports/' || (s_suppkey % 50) path, 0 AS "list", s_suppkey ordinal FROM supplier UNION ALL SELECT 'jira', 'exports/' || (c_custkey % 90), 1, c_custkey FROM customer)) WHERE n = 1""",
    "build_plan": f"""WITH {_M}, w AS (SELECT user_id corpus, max(event_id) % 5 fingerprint FROM events WHERE event_type = 'view' GROUP BY ALL)
        SELECT corpus, CASE WHEN build_id IS NULL THEN 'built' WHEN build_id % 5 = fingerprint AND corpus % 2 = 1 THEN 'reused' ELSE 'refreshed' END "action" FROM w LEFT JOIN (SELECT * FROM nm WHERE n = 1) USING (corpus)""",
    "deletion_plan": "SELECT DISTINCT user_id corpus, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') THEN 'would_delete' ELSE 'missing' END outcome FROM events WHERE event_type = 'view'",
    "prune_plan": f"WITH {_M} SELECT corpus, build_id FROM nm WHERE n = 1 AND status = 'stale'",
    "corpus_keys": f"WITH {CORPUS_SQL} SELECT source, sha256(source || chr(10) || string_agg(DISTINCT source_type, chr(10) ORDER BY source_type) || chr(10) || sha256('stride=48|window=96'))[:24] corpus_key FROM docs GROUP BY source",
    "persisted_corpus": f"WITH {CORPUS_SQL} SELECT lang corpus, count(*) n, count(*) n_documents FROM docs WHERE lang <> 'fr' AND (lang <> 'en' OR path NOT LIKE 'incidents/%') GROUP BY lang",
    "risk_feed": f"""{_SEQ}, f AS (SELECT first_blocked decision_id, 'healed_on_retry' status, healed healed_decision_id FROM q WHERE healed IS NOT NULL UNION ALL SELECT latest_blocked, 'still_blocked', NULL FROM q WHERE healed IS NULL)
        SELECT decision_id, status, healed_decision_id, value >= 50 signal FROM f JOIN ledger USING (decision_id) ORDER BY signal DESC, created_at DESC, decision_id LIMIT 12""",
    "recent_then_filter": f"WITH {LEDGER_SQL} SELECT decision_id, fingerprint, blocked FROM (SELECT * FROM ledger ORDER BY decision_id DESC LIMIT 250) WHERE fingerprint < 20",
    "ledger_jsonl": f"WITH {LEDGER_SQL} SELECT decision_id, fingerprint, blocked, event_type, CAST(length('{{\"decision_id\":' || decision_id || ',\"fingerprint\":' || fingerprint || ',\"blocked\":' || blocked || ',\"event_type\":\"' || event_type || '\"}}') AS INTEGER) n_chars, row_number() OVER (ORDER BY decision_id) - 1 place FROM ledger",
    "ledger_dedupe": "SELECT event_id, user_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY origin) n FROM (SELECT event_id, user_id, 1 origin FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, user_id, 2 FROM events)) WHERE n = 1",
    "lookback_filter": "SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOURS",
    "signal_classes": f"WITH {CORPUS_SQL} SELECT CASE WHEN path LIKE 'incidents/%' THEN 'incident' WHEN path LIKE 'prs/%' THEN 'github' ELSE 'none' END kind, count(*) n, min(path) first_path FROM docs GROUP BY ALL",
    "fingerprint_snapshot": f"WITH {CORPUS_SQL} SELECT source corpus, bit_xor(CAST('0x' || md5(path || '|' || length(content) || '|' || doc_id % 97)[1:8] AS BIGINT)) fingerprint, count(*) n_files, CAST(sum(length(content)) AS BIGINT) bytes FROM docs GROUP BY ALL",
    "changed_files": f"WITH {CORPUS_SQL} SELECT source corpus, path, doc_id % 97 changed FROM docs WHERE doc_id % 97 IN (5, 7)",
    "corpus_list": f"WITH {_M} SELECT corpus, build_id, status, CASE WHEN status = 'ready' THEN 0 ELSE 1 END AS \"group\" FROM nm WHERE n = 1",
    "superseded": f"WITH {_M} SELECT corpus, count(*) n_builds, max(build_id) last_build FROM nm WHERE n > 1 GROUP BY corpus",
    "freshness_status": f"""WITH {_M}, k AS (SELECT corpus, build_id % 5 fingerprint FROM nm WHERE n = 1), s AS (SELECT user_id corpus, max(event_id) % 5 now FROM events WHERE event_type = 'view' GROUP BY ALL)
        SELECT corpus, CASE WHEN fingerprint IS NULL THEN 'missing' WHEN now IS NULL OR fingerprint <> now THEN 'stale' ELSE 'ready' END status FROM k FULL JOIN s USING (corpus)""",
    "retention_plan": f"{_RET} SELECT * FROM p",
    "retention_counts": f"{_RET} SELECT coalesce(reason, 'kept') reason, count(*) n FROM p GROUP BY ALL",
    "policy_labels": f"SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'strict' ELSE 'agile' END preset, CASE WHEN n_nationkey % 2 = 0 THEN '{_LABELS['strict']}' ELSE '{_LABELS['agile']}' END labels FROM nation",
}
