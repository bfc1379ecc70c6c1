"""Queries on hybrid search and decisions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import fixed, paths
from assay.operators import decide, fusion, graph, hybrid, lexical, span_scan, span_search
from assay.plans import rules
from assay.plans.lexical import distinct, texts
from assay.plans.lexical import ranked as by_words
from assay.sources.shared import made, once, written
from assay.sources.tables import corpus, corpus_paths, edges, requests, small

KEYS = ("request_id", "plan")


def _index(spark, d):
    return once(spark, d, "span-index", lambda: hybrid.indexed(once(spark, d, "corpus", lambda: corpus(spark, d))))


#: Tables of requests by kind: a function of (spark, folder) to request_id, query and changed_paths. Other modules add theirs.
REQUESTS = {"change": requests, "query": lambda spark, d: requests(spark, d).withColumn("changed_paths", F.array().cast("array<string>"))}


def asked(spark, d, kind="change"):
    return once(spark, d, f"requests-{kind}", lambda: REQUESTS[kind](spark, d))


def _planned(spark, d, kind="change"):
    return once(spark, d, f"planned-{kind}", lambda: fusion.planned_queries(asked(spark, d, kind)))


def _best(spark, d, planned):
    """The best spans of planned queries: by a reading of the texts if the queries are few, else by an index of blocks of spans."""
    if distinct(spark, d) and small(planned, span_scan.MOST_QUERIES):
        c = texts(spark, d)
        return span_scan.best(c, once(spark, d, "span-facts", lambda: span_scan.facts(c)), planned, rules.MATCH)
    blocks = once(spark, d, "span-blocks", lambda: span_search.blocks(_index(spark, d)), span_search.ROW_GROUP)
    lists = once(spark, d, "span-lists", lambda: span_search.lists(blocks))
    return span_search.best(_index(spark, d), blocks, lists, planned, rules.MATCH)


def _spans(spark, d, kind="change"):
    return once(spark, d, f"best-spans-{kind}", lambda: hybrid.evaluated(_best(spark, d, _planned(spark, d, kind))))


def words(spark, d, kind="change"):
    """The best documents of all planned queries by their words, with their rank."""
    return once(spark, d, f"lexical-{kind}", lambda: by_words(spark, d, _planned(spark, d, kind), rules.MATCH, KEYS))


def own_words(spark, d, k, kind="change"):
    """The k best documents by the words of each request's own query: plan 0 has it unchanged."""
    return words(spark, d, kind).where(F.col("plan") == 0).where(F.col("rank") <= k).select("request_id", "path", "score", "rank")


#: Plans of the kinds that are searched together lie so far apart.
_APART = 100


def together(spark, d, *kinds):
    """Makes the spans and documents of several kinds' planned queries by one reading of the texts, those that are there already left out."""
    for name, make in (("best-spans", lambda planned: hybrid.evaluated(_best(spark, d, planned))), ("lexical", lambda planned: by_words(spark, d, planned, rules.MATCH, KEYS))):
        new = [k for k in kinds if not made(spark, d, f"{name}-{k}")]
        if len(new) < 2:
            continue
        every = [_planned(spark, d, k).withColumn("plan", F.col("plan") + i * _APART) for i, k in enumerate(new)]
        found = written(make(written(functools.reduce(DataFrame.unionByName, every), "planned")), name)
        for i, k in enumerate(new):
            mine = found.where((F.col("plan") >= i * _APART) & (F.col("plan") < (i + 1) * _APART))
            once(spark, d, f"{name}-{k}", lambda mine=mine, i=i: mine.withColumn("plan", F.col("plan") - i * _APART))


def _lexical(spark, d, kind="change"):
    """Lexical hits of all planned queries, with their best lines."""

    def make():
        planned, hits = _planned(spark, d, kind), words(spark, d, kind)
        lines = lexical.best_lines(texts(spark, d), planned, hits, KEYS)
        out = hits.hint("merge").join(lines, [*KEYS, "path"])
        return out.select(*KEYS, "path", paths.source_type(F.col("path")).alias("source_type"), "score", F.lit(False).alias("verified"), "snippet", "line_number")

    return once(spark, d, f"lexical-hits-{kind}", make)


def _support(spark, d, kind="change"):
    names = []

    def make(i):
        def run():
            if not names:
                names.extend(graph.support(edges(spark, d), asked(spark, d, kind), corpus_paths(spark, d)))
            return names[i]

        return run

    return once(spark, d, f"support-{kind}", make(0)), once(spark, d, f"boosts-{kind}", make(1))


def ranked(spark, d, kind="change"):
    """The hits of hybrid search."""
    support, boosts = _support(spark, d, kind)
    return once(spark, d, f"hits-{kind}", lambda: hybrid.search(_spans(spark, d, kind), _lexical(spark, d, kind), _planned(spark, d, kind), support, boosts, rules.FINAL))


_hits = ranked


def _reached(spark, d, kind="change", hits=None):
    """Files that each request reaches: from its changed paths, or else from its first code evidence."""
    make = lambda: graph.closure(edges(spark, d), decide.focus(asked(spark, d, kind), decide.split(hits if hits is not None else ranked(spark, d, kind))))
    return make() if hits is not None else once(spark, d, f"reached-{kind}", make)


def features(spark, d, kind="change", hits=None):
    """Features of the requests' evidence; hits: other hits than those of the whole search."""

    def make():
        r, found = asked(spark, d, kind), ranked(spark, d, kind) if hits is None else hits
        f = decide.features(decide.split(found), r).hint("merge").join(decide.alignment(r, found), "request_id")
        reach = graph.impact(_reached(spark, d, kind, hits))
        return f.hint("merge").join(reach, "request_id", "left").na.fill(0, ["impacted_files", "impacted_tests", "impacted_docs", "impacted_runbooks", "max_depth"])

    return make() if hits is not None else once(spark, d, f"features-{kind}", make)


_features = features


def decisions(spark, d, kind="change", hits=None):
    return decide.explained(decide.decided(decide.missing(features(spark, d, kind, hits))))


_decisions = decisions


def actions(spark, d, kind="change", hits=None):
    """Decisions under each policy."""
    both = decisions(spark, d, kind, hits).join(F.broadcast(decide.policies(spark)), how="cross")  # policies are a handful of presets
    return decide.retry_text(decide.acted(decide.violations(decide.recalibrated(both))))


_actions = actions


def span_index(spark, d):
    return _index(spark, d).select("path", "kind", "line_number", F.md5("text").alias("text_md5"), "occurrences", "hazard", "coverage", "calm")


def hashed_cosine_topk(spark, d):
    """The best spans of each request's own query, by final score; cosine is that of the hashed vectors."""
    return _spans(spark, d).where("plan = 0").select("request_id", "path", "kind", "line_number", "cosine", "rank")


def structural_score(spark, d):
    return _spans(spark, d).select("request_id", "plan", "path", "kind", "line_number", "structural", "final", "score", "verified", "rank")


def best_span_snippets(spark, d):
    return _spans(spark, d).where("rank <= 3").select("request_id", "plan", "rank", "path", "line_number", "snippet")


def query_plan_expansion(spark, d):
    return _planned(spark, d)


def support_candidates(spark, d):
    """Paths that may support a request: neighbours of its changed paths, and linked tests of both."""
    return _support(spark, d)[0].select("request_id", "path")


def support_boosts(spark, d):
    return _support(spark, d)[1].select("request_id", "path", F.round("boost", 6).alias("boost"))


def rank_fusion(spark, d):
    return _hits(spark, d).select("request_id", "path", "source_type", "score", "verified", "line_number", "snippet", "rank")


def evidence_twin_split(spark, d):
    return decide.split(_hits(spark, d)).select("request_id", "path", "twin", "place", "score", "verified")


def support_score(spark, d):
    f = _features(spark, d)
    return f.select("request_id", "n_evidence", "n_twins", "support", "any_verified", "test_support", "runbook_support", "incident_twin")


def alignment_gap(spark, d):
    return decide.alignment(asked(spark, d), _hits(spark, d))


def warning_evidence(spark, d):
    return _features(spark, d).select("request_id", "warning", "changes_test", "changes_frontend")


def impact_summary(spark, d):
    """Files that each request reaches, by kind, with the greatest depth."""
    return graph.impact(_reached(spark, d))


def impacted_paths(spark, d):
    return _reached(spark, d).select("request_id", F.col("node").alias("path"), "depth")


def missing_evidence(spark, d):
    return decide.missing(_features(spark, d)).select("request_id", F.array_join("missing", "|").alias("missing"))


def hazard_confidence(spark, d):
    return _decisions(spark, d).select("request_id", "hazard", "confidence", "recurrence")


def decide_requests(spark, d):
    return _decisions(spark, d).select("request_id", "decision", "explanation")


def decide_queries(spark, d):
    """The requests as plain queries: no changed paths, the blast radius of their first code evidence."""
    return _decisions(spark, d, "query").select("request_id", "decision", "hazard", "confidence", "impacted_files", F.array_join("missing", "|").alias("missing"))


def decision_records(spark, d):
    """Whole records: decision, evidence and twins with snippets and lines, blast radius and notes, as one row for each request."""
    parts = decide.split(_hits(spark, d)).withColumn("cell", F.concat_ws(":", "place", "path", F.col("line_number").cast("string"), F.md5("snippet")))
    cells = lambda twin: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("twin") == twin, F.struct("place", "cell")))), lambda x: x["cell"]), "|")
    spans = parts.groupBy("request_id").agg(cells(False).alias("evidence"), cells(True).alias("twins"))
    return _decisions(spark, d).hint("merge").join(spans, "request_id", "left").select("request_id", "decision", "evidence", "twins", "impacted_files", "impacted_tests", "max_depth", F.array_join("missing", "|").alias("missing"))


def policy_violations(spark, d):
    return _actions(spark, d).select("request_id", "policy", F.array_join("violations", "|").alias("violations"))


def action_decisions(spark, d):
    return _actions(spark, d).select("request_id", "policy", "decision", "allowed", F.size("missing").alias("n_missing"))


def healing_prompt(spark, d):
    return _actions(spark, d).where("NOT allowed").select("request_id", "policy", "prompt")


def healing_loop(spark, d):
    """The next step of each request under each policy, with its strongest evidence and twins."""
    done = decide.healing_step(_actions(spark, d), decide.split(_hits(spark, d)))
    return done.select("request_id", "policy", "next_step", F.array_join("strongest_evidence", "|").alias("evidence"), F.array_join("strongest_twins", "|").alias("twins"))


QUERIES = {
    f.__name__: f
    for f in (
        span_index, hashed_cosine_topk, structural_score, best_span_snippets, query_plan_expansion, support_candidates, support_boosts, rank_fusion, evidence_twin_split, support_score, alignment_gap, warning_evidence,
        impact_summary, impacted_paths, missing_evidence, hazard_confidence, decide_requests, decide_queries, decision_records, policy_violations, action_decisions, healing_prompt, healing_loop,
    )
}

_ST, _HITS = rules.STRUCTURAL_SQL, rules.HITS_SQL
def features_sql(base: str, hits: str = "hits", n: str = "") -> str:
    """Parts, features, notes and decisions over a table of hits; n is put after the names."""
    changed = "changed_paths"
    some = lambda pattern: f"len(list_filter({changed}, lambda x: {pattern})) > 0"
    test, front = "contains('/' || x, '/tests/') OR contains(x, '.test.')", "regexp_matches(x, '\\.(tsx|jsx)$') OR (regexp_matches(x, '\\.(js|ts|mjs|cjs|mts|cts)$') AND regexp_matches('/' || x, '/(app|apps|components|pages|routes|web|ui)/'))"
    return f"""{base},
tw{n} AS (SELECT *, source_type IN ('pr', 'incident') twin FROM {hits}), pl{n} AS (SELECT *, row_number() OVER (PARTITION BY request_id, twin ORDER BY rank) place, count(*) FILTER (WHERE NOT twin) OVER (PARTITION BY request_id) plain FROM tw{n}),
parts{n} AS (SELECT request_id, path, source_type, twin, place, score, verified, snippet, line_number FROM pl{n} WHERE place <= CASE WHEN twin THEN 3 ELSE 5 END UNION ALL SELECT request_id, path, source_type, FALSE, rank, score, verified, snippet, line_number FROM pl{n} WHERE plain = 0 AND rank <= 5),
bp{n} AS (SELECT *, row_number() OVER (PARTITION BY request_id, twin ORDER BY score DESC, path) best FROM parts{n}),
ft{n} AS (SELECT request_id, count(*) FILTER (WHERE NOT twin) n_evidence, count(*) FILTER (WHERE twin) n_twins, round(coalesce(avg(score) FILTER (WHERE NOT twin AND best <= 3), 0) + 1e-9, 6) support, bool_or(NOT twin AND verified) any_verified,
  bool_or(NOT twin AND source_type = 'test') test_support, bool_or(NOT twin AND source_type = 'runbook') runbook_support, bool_or(NOT twin AND verified AND source_type IN ('code', 'test', 'runbook')) vcl, bool_or(NOT twin AND verified AND source_type = 'code') vc,
  bool_or(NOT twin AND verified AND source_type IN ('doc', 'test')) v2, bool_or(twin AND source_type = 'incident') incident_twin, bool_or(NOT twin AND place <= 3 AND regexp_matches(lower(path || ' ' || snippet), '{"|".join(fixed.WARNING_TERMS)}')) warning FROM bp{n} GROUP BY request_id),
ga{n} AS (SELECT request_id, len({changed}) > 0 AND NOT EXISTS (SELECT 1 FROM {hits} h, (SELECT request_id r, unnest({changed}) p FROM reqs) c WHERE h.request_id = reqs.request_id AND c.r = reqs.request_id AND (path = p OR {rules.stem_sql('path')} = {rules.stem_sql('p')})) gap FROM reqs),
fo{n} AS (SELECT request_id, unnest({changed}) node FROM reqs UNION SELECT request_id, path FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY place) k FROM parts{n} JOIN reqs USING (request_id) WHERE NOT twin AND source_type = 'code' AND len({changed}) = 0) WHERE k <= 2),
wa{n} AS (SELECT request_id, node, 0 depth FROM fo{n} UNION SELECT request_id, src, depth + 1 FROM wa{n} JOIN edges ON dst = node WHERE depth < 20), re{n} AS (SELECT request_id, node, min(depth) depth FROM wa{n} GROUP BY ALL),
im{n} AS (SELECT request_id, count(*) files, count(*) FILTER (WHERE contains('/' || node, '/tests/') OR contains(node, '.test.')) tests, count(*) FILTER (WHERE node LIKE 'docs/%') docs, count(*) FILTER (WHERE node LIKE 'runbooks/%') runbooks, max(depth) max_depth FROM re{n} GROUP BY request_id),
fe{n} AS (SELECT request_id, coalesce(n_evidence, 0) n_evidence, coalesce(n_twins, 0) n_twins, coalesce(support, 0) support, coalesce(any_verified, FALSE) any_verified, coalesce(test_support, FALSE) test_support, coalesce(runbook_support, FALSE) runbook_support,
  coalesce(vcl, FALSE) vcl, coalesce(vc, FALSE) vc, coalesce(v2, FALSE) v2, coalesce(incident_twin, FALSE) incident_twin, coalesce(warning, FALSE) warning, gap, coalesce(files, 0) files, coalesce(tests, 0) tests, coalesce(max_depth, 0) max_depth,
  {some(test)} changes_test, {some("contains(x, 'runbook')")} changes_runbook, {some(front)} changes_frontend FROM reqs LEFT JOIN ft{n} USING (request_id) JOIN ga{n} USING (request_id) LEFT JOIN im{n} USING (request_id)),
mi{n} AS (SELECT *, list_filter([CASE WHEN n_evidence = 0 THEN '{fixed.NOTE_NO_EVIDENCE}' END, CASE WHEN n_evidence > 0 AND NOT any_verified THEN '{fixed.NOTE_UNVERIFIED}' END, CASE WHEN gap THEN '{fixed.NOTE_GAP}' END, CASE WHEN warning THEN '{fixed.NOTE_WARNING}' END,
  CASE WHEN test_support OR changes_test THEN NULL WHEN changes_frontend AND tests > 0 THEN '{fixed.NOTE_NO_FRONTEND_TEST}' ELSE '{fixed.NOTE_NO_TEST}' END, CASE WHEN NOT runbook_support AND NOT changes_runbook THEN '{fixed.NOTE_NO_RUNBOOK}' END, CASE WHEN n_twins = 0 THEN '{fixed.NOTE_NO_PRECEDENT}' END], lambda x: x IS NOT NULL) missing FROM fe{n}),
de{n} AS (SELECT *, round(least(1.0, greatest(0.0, 0.65 - support + 0.08 * len(missing) + 0.02 * greatest(0, files - 5))) + 1e-9, 6) hazard,
  round(least(1.0, greatest(0.0, support + CASE WHEN n_twins > 0 THEN 0.05 ELSE 0 END + CASE WHEN test_support THEN 0.05 ELSE 0 END + CASE WHEN runbook_support THEN 0.05 ELSE 0 END - 0.03 * greatest(0, files - 4))) + 1e-9, 6) confidence,
  CASE WHEN gap THEN 'escalate' WHEN warning AND NOT (vcl AND test_support AND n_twins > 0) THEN 'escalate' WHEN n_evidence >= 2 AND support >= 0.25 AND (n_twins > 0 OR (test_support AND runbook_support)) AND len(missing) <= 1 THEN 'admit'
  WHEN n_evidence >= 1 AND support >= 0.12 THEN 'escalate' ELSE 'abstain' END decision FROM mi{n})"""


_FEATURES = features_sql(_HITS)
_QUERY = features_sql(rules.hits_sql(rules.QUERY_REQUESTS_SQL))
_lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_format = lambda t: t.replace("%d", "{}").replace("%.2f", "{:.2f}")
PO = f"""po(policy, profile, max_files, max_hazard, min_confidence, need_test, need_runbook, need_precedent, need_incident, block_incident) AS (VALUES {", ".join("(" + ", ".join(map(_lit, p)) + ")" for p in fixed.POLICIES)})"""


def actions_sql(n: str = "") -> str:
    """Decisions under each policy, over de and po."""
    return f"""rc{n} AS (SELECT * EXCLUDE (missing), CASE WHEN profile = 'open_source' THEN list_filter(missing, lambda x: x NOT IN ('{fixed.NOTE_NO_RUNBOOK}', '{fixed.NOTE_NO_PRECEDENT}')) ELSE missing END missing FROM de{n} CROSS JOIN po),
ad{n} AS (SELECT * EXCLUDE (decision), CASE WHEN profile = 'open_source' AND NOT gap AND NOT warning AND NOT list_contains(missing, '{fixed.NOTE_NO_FRONTEND_TEST}') AND n_evidence >= 2 AND support >= 0.25 AND vc AND v2 AND (NOT need_test OR test_support OR changes_test) THEN 'admit' ELSE decision END decision FROM rc{n}),
vi{n} AS (SELECT *, list_filter([CASE WHEN files > max_files THEN format('{_format(fixed.BREACH_FILES)}', files, max_files) END, CASE WHEN hazard > max_hazard THEN format('{_format(fixed.BREACH_HAZARD)}', hazard, CAST(max_hazard AS DOUBLE)) END,
  CASE WHEN confidence < min_confidence THEN format('{_format(fixed.BREACH_CONFIDENCE)}', confidence, CAST(min_confidence AS DOUBLE)) END, CASE WHEN need_test AND NOT test_support AND NOT changes_test THEN '{fixed.BREACH_TEST}' END,
  CASE WHEN need_runbook AND NOT runbook_support AND NOT changes_runbook THEN '{fixed.BREACH_RUNBOOK}' END, CASE WHEN need_precedent AND n_twins = 0 THEN '{fixed.BREACH_PRECEDENT}' END, CASE WHEN need_incident AND NOT incident_twin THEN '{fixed.BREACH_NO_INCIDENT}' END,
  CASE WHEN block_incident AND incident_twin THEN '{fixed.BREACH_INCIDENT}' END], lambda x: x IS NOT NULL) violations FROM ad{n}),
ac{n} AS (SELECT * EXCLUDE (decision, missing), CASE WHEN len(violations) > 0 THEN 'escalate' ELSE decision END decision, list_concat(missing, list_transform(violations, lambda x: 'Safety policy violation: ' || x)) missing FROM vi{n})"""


_ACTIONS = f"{_FEATURES}, {PO}, {actions_sql()}"
_CELLS = lambda twin: f"coalesce(string_agg(place || ':' || path || ':' || line_number || ':' || md5(snippet), '|' ORDER BY place) FILTER (WHERE {twin}), '')"
ORACLE_SQL = {
    "span_index": f"{_ST} SELECT path, kind, CAST(line_number AS INTEGER) line_number, md5(text) text_md5, CAST(occurrences AS INTEGER) occurrences, coalesce(hazard, 1) hazard, coalesce(coverage, 0) coverage, coalesce(hazard, 1) <= greatest(0.75, (SELECT threshold FROM lim)) calm FROM sp LEFT JOIN fa USING (span)",
    "hashed_cosine_topk": f"{_ST} SELECT request_id, path, kind, CAST(line_number AS INTEGER) line_number, cosine, CAST(rank AS INTEGER) rank FROM sm WHERE plan = 0",
    "structural_score": f"{_ST} SELECT request_id, plan, path, kind, CAST(line_number AS INTEGER) line_number, structural, final, score, verified, CAST(rank AS INTEGER) rank FROM ss",
    "best_span_snippets": f"{_ST} SELECT request_id, plan, CAST(rank AS INTEGER) rank, path, CAST(line_number AS INTEGER) line_number, snippet FROM ss WHERE rank <= 3",
    "query_plan_expansion": f"WITH {rules.CORPUS_SQL}, {rules.REQUESTS_SQL}, {rules.PLANNED_SQL} SELECT request_id, plan, query, weight, support_only FROM pq",
    "support_candidates": f"WITH {rules.CORPUS_SQL}, {rules.EDGES_SQL}, {rules.REQUESTS_SQL}, {rules.SUPPORT_SQL} SELECT request_id, path FROM sup",
    "support_boosts": f"WITH {rules.CORPUS_SQL}, {rules.EDGES_SQL}, {rules.REQUESTS_SQL}, {rules.SUPPORT_SQL} SELECT request_id, path, CAST(round(boost, 6) AS DOUBLE) boost FROM bst",
    "rank_fusion": f"{_HITS} SELECT request_id, path, source_type, score, verified, CAST(line_number AS INTEGER) line_number, snippet, CAST(rank AS INTEGER) rank FROM hits",
    "evidence_twin_split": f"{_FEATURES} SELECT request_id, path, twin, CAST(place AS INTEGER) place, score, verified FROM parts",
    "support_score": f"{_FEATURES} SELECT request_id, n_evidence, n_twins, support, any_verified, test_support, runbook_support, incident_twin FROM fe",
    "alignment_gap": f"{_FEATURES} SELECT request_id, gap FROM ga",
    "warning_evidence": f"{_FEATURES} SELECT request_id, warning, changes_test, changes_frontend FROM fe",
    "impact_summary": f"{_FEATURES} SELECT request_id, CAST(files AS INTEGER) impacted_files, CAST(tests AS INTEGER) impacted_tests, CAST(docs AS INTEGER) impacted_docs, CAST(runbooks AS INTEGER) impacted_runbooks, CAST(max_depth AS INTEGER) max_depth FROM im",
    "impacted_paths": f"{_FEATURES} SELECT request_id, node path, CAST(depth AS INTEGER) depth FROM re",
    "missing_evidence": f"{_FEATURES} SELECT request_id, array_to_string(missing, '|') missing FROM mi",
    "hazard_confidence": f"{_FEATURES} SELECT request_id, hazard, confidence, n_evidence + n_twins recurrence FROM de",
    "decide_requests": f"{_FEATURES} SELECT request_id, decision, format('Decision {{}} based on support score {{:.2f}}, blast radius of {{}} files, and {{}} missing evidence flags.', decision, support, files, len(missing)) explanation FROM de",
    "decide_queries": f"{_QUERY} SELECT request_id, decision, hazard, confidence, CAST(files AS INTEGER) impacted_files, array_to_string(missing, '|') missing FROM de",
    "decision_records": f"{_FEATURES}, ev AS (SELECT request_id, {_CELLS('NOT twin')} evidence, {_CELLS('twin')} twins FROM parts GROUP BY request_id) SELECT request_id, decision, evidence, twins, CAST(files AS INTEGER) impacted_files, CAST(tests AS INTEGER) impacted_tests, CAST(max_depth AS INTEGER) max_depth, array_to_string(missing, '|') missing FROM de LEFT JOIN ev USING (request_id)",
    "policy_violations": f"{_ACTIONS} SELECT request_id, policy, array_to_string(violations, '|') violations FROM ac",
    "action_decisions": f"{_ACTIONS} SELECT request_id, policy, decision, decision = 'admit' allowed, CAST(len(missing) AS INTEGER) n_missing FROM ac",
    "healing_loop": f"""{_ACTIONS}, strongest AS (SELECT request_id, coalesce(string_agg(path, '|' ORDER BY place) FILTER (WHERE NOT twin), '') evidence, coalesce(string_agg(path, '|' ORDER BY place) FILTER (WHERE twin), '') twins FROM parts WHERE place <= 3 GROUP BY request_id)
        SELECT request_id, policy, CASE WHEN decision = 'admit' THEN 'proceed' WHEN len(missing) > 0 THEN 'repair_and_retry' ELSE 'inspect_evidence' END next_step, coalesce(evidence, '') evidence, coalesce(twins, '') twins FROM ac LEFT JOIN strongest USING (request_id)""",
    "healing_prompt": f"{_ACTIONS} SELECT request_id, policy, 'Blocked: ' || decision || '. Resolve: ' || array_to_string(missing[:3], '; ') prompt FROM ac WHERE decision <> 'admit'",
}
