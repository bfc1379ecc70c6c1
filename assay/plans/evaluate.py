"""Queries on evaluation, healing replay and extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.functions import fixed, paths, text
from assay.operators import decide, evaluate, lexical
from assay.plans import decisions, rules
from assay.plans.lexical import SCORES_SQL, lexical_topk
from assay.sources import exports
from assay.sources.shared import once, written
from assay.sources.tables import CORPUS_SQL, REQUESTS_SQL, corpus, requests, table


def cases(spark, d):
    """Two cases for each benchmark item: its text, which is to be admitted, and a question on something that is not there."""
    b = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("topic-"), F.pmod("item_id", F.lit(5)).cast("string")).alias("topic"), F.coalesce("text", F.lit("")).alias("text"))
    gone = F.concat(F.lit("If we change the deprecated legacy_"), F.col("item_id").cast("string"), F.lit(" path, what code, tests and precedent PRs are implicated?"))
    each = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("query"), F.lit(True).alias("should_admit")), F.struct(F.lit(1).alias("k"), gone.alias("query"), F.lit(False).alias("should_admit"))))
    rows = b.select("item_id", "topic", each.alias("c")).select((F.col("item_id") * 2 + F.col("c.k")).alias("request_id"), "topic", "c.query", "c.should_admit", F.array(F.concat(F.lit("/src"), F.pmod("item_id", F.lit(20)).cast("string"), F.lit("/"))).alias("hints"))
    return rows.withColumn("case_id", F.format_string("case-%05d", "request_id"))


decisions.REQUESTS["cases"] = lambda spark, d: cases(spark, d).select("request_id", "query", F.array().cast("array<string>").alias("changed_paths"))


def _results(spark, d):
    """Both back-ends' answers to every case: the structural rule over hybrid hits, the baseline over lexical ones."""

    def make():
        c, hits = written(cases(spark, d), "cases"), decisions.ranked(spark, d, "cases")
        lex = decisions.own_words(spark, d, 12, "cases")
        s = evaluate.focused(hits, c).select("request_id", F.col("admit").alias("structural"), F.col("support").alias("structural_support"))
        b = lexical.baseline(lex).select("request_id", (F.col("decision") == "admit").alias("baseline"), F.col("support").alias("baseline_support"))
        rank = lambda h, name: evaluate.expected_rank(h.select("request_id", "path", "rank"), c.select("request_id", "hints")).withColumnRenamed("rank", name)
        out = c.drop("hints", "query")
        for part in (s, b, rank(hits, "structural_rank"), rank(lex, "baseline_rank")):
            out = out.hint("merge").join(part, "request_id", "left")
        return out.na.fill(False, ["structural", "baseline"]).na.fill(0, ["structural_support", "baseline_support"])

    return once(spark, d, "case-results", make)


def evaluation_cases(spark, d):
    return cases(spark, d).select("case_id", "topic", "query", "should_admit")


def evaluation_results(spark, d):
    return _results(spark, d).select("case_id", "topic", "should_admit", "structural", "structural_support", "structural_rank", "baseline", "baseline_support", "baseline_rank")


def confusion_metrics(spark, d):
    r = _results(spark, d)
    return evaluate.confusion(r.withColumns({f"{n}_hit": F.col(f"{n}_rank") > 0 for n in ("structural", "baseline")}), "structural", "baseline")


def evaluation_wins(spark, d):
    return evaluate.wins(_results(spark, d), "structural", "baseline")


def focus_decision(spark, d):
    return evaluate.focused(decisions.ranked(spark, d), decisions.asked(spark, d))


def poisoned_metrics(spark, d):
    """Whole decisions on the cases against the baseline."""
    admitted = decisions.decisions(spark, d, "cases").select("request_id", (F.col("decision") == "admit").alias("decided"))
    return evaluate.confusion(_results(spark, d).hint("merge").join(admitted, "request_id"), "decided", "baseline")


def incident_results(spark, d):
    """Each request's action under the strict policy with the repository alone, and with incidents as a further source."""

    def make():
        hits = decisions.ranked(spark, d)
        w = Window.partitionBy("request_id").orderBy("rank")
        alone = written(hits.where("source_type <> 'incident'").withColumn("rank", F.row_number().over(w)), "repository-hits")
        allowed = lambda name, h: decisions.actions(spark, d, "change", h).where("policy = 'strict'").select("request_id", F.col("allowed").alias(name))
        twins = decide.split(hits).where("twin AND source_type = 'incident'").groupBy("request_id").agg(F.count("*").alias("n_incidents"))
        out = allowed("repository_allowed", alone).hint("merge").join(allowed("mixed_allowed", None), "request_id").hint("merge").join(twins, "request_id", "left")
        return out.na.fill(0, ["n_incidents"])

    return once(spark, d, "incident-results", make)


def incident_rates(spark, d):
    r = incident_results(spark, d)
    alone, mixed = F.col("repository_allowed"), F.col("mixed_allowed")
    return r.agg(F.count("*").alias("n"), evaluate.rate(~alone).alias("repository_block_rate"), evaluate.rate(~mixed).alias("mixed_block_rate"), evaluate.rate(F.col("n_incidents") > 0).alias("incident_hit_rate"), evaluate.rate(alone & ~mixed).alias("incremental_block_rate"))


def _places(rows):
    """Distinct paths with their place in order: places inside ranges of paths, after the sizes of the ranges before."""
    ranges = written(rows.distinct().repartitionByRange("path").withColumn("part", F.spark_partition_id()), "paths")
    sizes, before, upto = ranges.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect(), [], 0
    for r in sizes:
        before.append((r.part, upto))
        upto += r.n
    inside = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    starts = rows.sparkSession.createDataFrame(before, "part int, before long")
    return ranges.withColumn("i", inside).join(F.broadcast(starts), "part").select("path", (F.col("i") + F.col("before")).alias("place"))


def decoy_selection(spark, d):
    """For each request the first path that shares no token with its query and is not its own."""

    def make():
        c = corpus(spark, d).where("path NOT LIKE 'tests/%' AND path NOT LIKE 'docs/%'").select("path")
        return evaluate.decoys(requests(spark, d), written(_places(c), "places"))

    return once(spark, d, "decoys", make)


#: Requests of the replay whose gold paths have tests: every third.
_GOLD_TESTS = "request_id % 3 = 0"


def retry_tests(spark, d):
    """Up to two tests for each request's retry: its gold tests (linked tests of its paths, where it has some), else the first lexical test hits among twenty that it does not change yet."""

    def make():
        support, _ = decisions._support(spark, d)
        gold = support.where(_GOLD_TESTS).where(paths.is_test(F.col("path"))).withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("path"))).where("rank <= 2").select("request_id", "path", "rank")
        r = requests(spark, d)
        lex = decisions.own_words(spark, d, 20)
        own = r.select("request_id", F.explode("changed_paths").alias("path"))
        other = lex.where(paths.is_test(F.col("path"))).hint("merge").join(own, ["request_id", "path"], "left_anti").hint("merge").join(gold.select("request_id").distinct(), "request_id", "left_anti")
        other = other.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("rank"))).where("rank <= 2").select("request_id", "path", "rank")
        return gold.unionByName(other)

    return once(spark, d, "retry-tests", make)


def _agile(spark, d, kind):
    return decisions.actions(spark, d, kind).where("policy = 'agile'")


def _retries(spark, d):
    """Requests that are tried again: blocked, with missing test evidence, and with tests to add."""
    first = _agile(spark, d, "change").where("NOT allowed").where(F.exists("missing", lambda m: F.contains(F.lower(m), F.lit("test evidence"))))
    guidance = F.coalesce(F.nullif(F.array_join(F.slice("missing", 1, 3), "; "), F.lit("")), F.lit(fixed.NO_GUIDANCE))
    tests = retry_tests(spark, d).groupBy("request_id").agg(F.array_sort(F.collect_list("path")).alias("tests"))
    rows = first.select("request_id", guidance.alias("guidance")).hint("merge").join(tests, "request_id").hint("merge").join(requests(spark, d), "request_id")
    before, after = fixed.HEALING_PROMPT
    return rows.select("request_id", F.concat(text.summary(F.col("query")), F.lit(before), "guidance", F.lit(after)).alias("query"), F.array_distinct(F.concat("changed_paths", "tests")).alias("changed_paths"))


decisions.REQUESTS["retry"] = _retries
decisions.REQUESTS["decoy"] = lambda spark, d: requests(spark, d).drop("changed_paths").hint("merge").join(decoy_selection(spark, d).where("path IS NOT NULL"), "request_id").select("request_id", "query", F.array("path").alias("changed_paths"))


def healing_requests(spark, d):
    return decisions.asked(spark, d, "retry").select("request_id", F.md5("query").alias("query_md5"), F.array_join("changed_paths", "|").alias("changed_paths"))


def replay_results(spark, d):
    """Each request's first action, its retry with tests where it is blocked for want of them, and a decoy, under the agile policy."""

    def make():
        decisions.together(spark, d, "change", "decoy")
        of = lambda kind, name: _agile(spark, d, kind).select("request_id", F.col("allowed").alias(f"{name}_allowed"), F.col("decision").alias(f"{name}_decision"))
        first = _agile(spark, d, "change").select("request_id", F.col("allowed").alias("initial_allowed"), F.exists("missing", lambda m: F.contains(F.lower(m), F.lit("test evidence"))).alias("test_gap"))
        gap = _agile(spark, d, "decoy").select("request_id", F.array_contains("missing", fixed.NOTE_GAP).alias("alignment_gap"))
        base = lexical.baseline(decisions.own_words(spark, d, 12)).select("request_id", (F.col("decision") == "admit").alias("baseline_allowed"))
        out = first
        for part in (of("retry", "retry"), of("decoy", "decoy"), gap, base):
            out = out.hint("merge").join(part, "request_id", "left")
        out = out.withColumn("retried", F.col("retry_decision").isNotNull()).withColumn("healed_allowed", F.coalesce("retry_allowed", "initial_allowed"))
        return out.na.fill(False).select("request_id", F.pmod("request_id", F.lit(5)).alias("repo"), "initial_allowed", "test_gap", "retried", "healed_allowed", "decoy_allowed", "alignment_gap", "baseline_allowed")

    return once(spark, d, "replay", make)


_REPLAY = (("initial_allow_rate", "initial_allowed", None), ("healed_allow_rate", "healed_allowed", None), ("retry_rate", "retried", None), ("healing_success_rate", "healed_allowed", "retried"), ("test_gap_rate", "test_gap", None), ("decoy_false_allow_rate", "decoy_allowed", None), ("baseline_allow_rate", "baseline_allowed", None), ("alignment_gap_rate", "alignment_gap", None))


def replay_rates(spark, d):
    return replay_results(spark, d).agg(F.count("*").alias("n"), F.count_distinct("repo").alias("n_repos"), *[evaluate.rate(F.col(c), F.col(of) if of else None).alias(name) for name, c, of in _REPLAY])


def group_rates_rollup(spark, d):
    """Rates of the replay by repository and over all: allowed, decoys allowed, and evidence on a changed path and on a test."""
    replayed = replay_results(spark, d)
    evidence = decide.split(decisions.ranked(spark, d)).where("NOT twin")
    own = requests(spark, d).select("request_id", F.explode("changed_paths").alias("path"))
    source = evidence.hint("merge").join(own, ["request_id", "path"], "left_semi").select("request_id").distinct().withColumn("source_hit", F.lit(True))
    tested = evidence.hint("merge").join(retry_tests(spark, d), ["request_id", "path"], "left_semi").select("request_id").distinct().withColumn("test_hit", F.lit(True))
    r = replayed.hint("merge").join(source, "request_id", "left").hint("merge").join(tested, "request_id", "left").na.fill(False)
    return r.rollup("repo").agg(F.count("*").alias("n"), *[evaluate.rate(F.col(c)).alias(f"{c}_rate") for c in ("initial_allowed", "decoy_allowed", "source_hit", "test_hit")], F.grouping("repo").cast("int").alias("is_total"))


def top2_concentration(spark, d):
    return evaluate.concentration(table(spark, d, "documents"), "source")


def stratified_sample(spark, d):
    """Documents as instances of their source: in repository order, items with tests and short ones first, until there are 150."""
    i = corpus(spark, d).select(F.coalesce("source", F.lit("none")).alias("repo"), F.col("doc_id").alias("instance_id"), (F.col("source_type") == "test").alias("has_test"), F.pmod("doc_id", F.lit(3)).alias("n_paths"))
    return evaluate.selected(i, _PREFERRED, pilot=False, most=150)


def pilot_sample(spark, d):
    i = corpus(spark, d).select(F.coalesce("source", F.lit("none")).alias("repo"), F.col("doc_id").alias("instance_id"), (F.col("source_type") == "test").alias("has_test"), F.pmod("doc_id", F.lit(3)).alias("n_paths"))
    return evaluate.selected(i, _PREFERRED, pilot=True, repos=12)


_PREFERRED = ("src7", "src3")


def patch_paths(spark, d):
    """Diffs made of each page's url, read back."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("--- a/x\n+++ b/src/"), F.col("page_id").cast("string"), F.lit(".py\n@@\n+++ b/src/"), F.col("page_id").cast("string"), F.lit(".py\n+++ /dev/null\n+++ b/"), F.regexp_extract("url", r"^https?://([^/]+)", 1), F.lit("\n+x")).alias("patch"))
    return p.select("page_id", F.array_join(text.patch_paths(F.col("patch")), ",").alias("paths"))


def expected_rank(spark, d):
    hints = requests(spark, d).select("request_id", F.array(F.lit("tests/"), F.concat(F.lit("/src"), (F.col("request_id") % 20).cast("string"), F.lit("/"))).alias("hints"))
    return evaluate.expected_rank(lexical_topk(spark, d), hints)


def precedents(spark, d):
    """Release notes made of orders, a line for each, with translations among them; the first pull requests of each priority."""
    o = table(spark, d, "orders")
    k = F.pmod("o_orderkey", F.lit(7))
    number = F.floor(F.col("o_orderkey") / 2).cast("string")
    body = F.concat(F.lit("* "), F.when(k == 0, "Update translations of ").when(k == 1, "Update docs/de/docs/ on ").otherwise("Fix "), "o_orderpriority", F.when(k == 2, ".").otherwise(F.concat(F.lit(". PR [#"), number, F.lit("](https://host/pull/"), number, F.lit(").")))).alias("text")
    topics = o.select(F.col("o_orderpriority").alias("term")).distinct().select(F.lower("term").alias("topic"), "term")
    return evaluate.precedents(o.select(F.col("o_orderkey").alias("line"), body), written(topics, "topics")).select("topic", "number", "line", "url", "rank")


def chat_threads(spark, d):
    """Conversations as thread documents: root author, the first 25 messages and how many there are."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.struct("turn", "role", "text").alias("at"), F.col("role").alias("author"), "text")
    t = exports.threads(c, ["thread"])
    return t.select(F.col("thread").alias("conv_id"), "author", "n_messages", F.md5("content").alias("content_md5"))


def corpus_union(spark, d):
    """All sources as documents of one schema."""
    docs = corpus(spark, d).select("path", "source_type", "content")
    page = table(spark, d, "pages").select(F.concat(F.lit("external/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.lit("doc").alias("source_type"), F.col("html").alias("content"))
    chat = table(spark, d, "conversations").select(F.concat(F.lit("incidents/chat_"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.lit("incident").alias("source_type"), F.col("text").alias("content"))
    every = docs.unionByName(page).unionByName(chat).where(F.trim("content") != "")
    return every.groupBy("source_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        evaluation_cases, evaluation_results, confusion_metrics, evaluation_wins, focus_decision, poisoned_metrics, incident_results, incident_rates, decoy_selection, retry_tests, healing_requests, replay_results, replay_rates, group_rates_rollup,
        top2_concentration, stratified_sample, pilot_sample, patch_paths, expected_rank, precedents, chat_threads, corpus_union,
    )
}

_CASES = """cases AS (SELECT item_id * 2 + k request_id, 'topic-' || (item_id % 5) topic, CASE WHEN k = 0 THEN coalesce(text, '') ELSE 'If we change the deprecated legacy_' || item_id || ' path, what code, tests and precedent PRs are implicated?' END query, k = 0 should_admit, '/src' || (item_id % 20) || '/' hint,
  'case-' || lpad(CAST(item_id * 2 + k AS VARCHAR), 5, '0') case_id FROM benchmark, (SELECT unnest([0, 1]) k))"""
_CASE_HITS = rules.hits_sql(f"{_CASES}, reqs AS (SELECT request_id, query, CAST([] AS VARCHAR[]) changed_paths FROM cases)")


def _focus_sql(hits: str) -> str:
    return f"""fq AS (SELECT DISTINCT request_id, token FROM qt WHERE plan = 0 AND token NOT IN ({rules.listed(fixed.FOCUS_IGNORE)})), {rules.tokens_sql('fh', f'(SELECT request_id, path, path || chr(32) || snippet t FROM {hits})', 't', 'request_id, path')},
fm AS (SELECT request_id, path, bool_or(token NOT IN ({rules.listed(fixed.SIGNATURE_IGNORE)})) sig FROM fh JOIN fq USING (request_id, token) GROUP BY ALL),
fr AS (SELECT *, source_type = 'pr' pr, row_number() OVER (PARTITION BY request_id, source_type = 'pr' ORDER BY rank) place FROM {hits} JOIN fm USING (request_id, path)),
fg AS (SELECT request_id, round(coalesce(avg(score) FILTER (WHERE NOT pr AND place <= 3), 0) + 1e-9, 6) support, count(*) FILTER (WHERE NOT pr AND verified) n_verified, count(*) FILTER (WHERE NOT pr AND verified AND source_type IN ('code', 'test', 'runbook')) n_code, bool_or(pr) any_pr, bool_or(NOT pr AND sig) sig FROM fr GROUP BY request_id),
fd AS (SELECT request_id, coalesce(support, 0) support, coalesce(n_verified, 0) n_verified, coalesce(n_code, 0) n_code, coalesce((n_verified > 0 AND any_pr AND n_code > 0 AND support >= 0.38) OR (n_code >= 2 AND any_pr AND support >= 0.42) OR (sig AND n_verified >= 2 AND support >= 0.45), FALSE) admit FROM reqs LEFT JOIN fg USING (request_id))"""


_RESULTS = f"""{_CASE_HITS}, {_focus_sql('hits')}, b12 AS (SELECT * FROM lr WHERE plan = 0 AND rank <= 12),
bs AS (SELECT request_id, round(avg(score) FILTER (WHERE rank <= 3), 6) support, count(*) FILTER (WHERE rank <= 5 AND score >= 0.32) strong FROM b12 GROUP BY request_id),
rk AS (SELECT request_id, min(rank) FILTER (WHERE contains(path, hint)) rank FROM cases JOIN hits USING (request_id) GROUP BY ALL), rb AS (SELECT request_id, min(rank) FILTER (WHERE contains(path, hint)) rank FROM cases JOIN b12 USING (request_id) GROUP BY ALL),
res AS (SELECT request_id, case_id, topic, should_admit, admit structural, fd.support structural_support, CAST(coalesce(rk.rank, -1) AS INTEGER) structural_rank, coalesce(bs.support >= 0.32 AND strong >= 2, FALSE) baseline, coalesce(bs.support, 0) baseline_support, CAST(coalesce(rb.rank, -1) AS INTEGER) baseline_rank
  FROM cases JOIN fd USING (request_id) LEFT JOIN bs USING (request_id) LEFT JOIN rk USING (request_id) LEFT JOIN rb USING (request_id))"""


def _rate_sql(c: str, of: str = "TRUE") -> str:
    return f"round(count(*) FILTER (WHERE ({c}) AND ({of})) / greatest(1, count(*) FILTER (WHERE {of})), 4)"


def _confusion_sql(*names: str, hit: bool = True) -> str:
    of = lambda n: ", ".join([f"{_rate_sql(f'{n} = should_admit')} {n}_accuracy", f"{_rate_sql(n, 'should_admit')} {n}_true_admit", f"{_rate_sql(n, 'NOT should_admit')} {n}_false_admit", *([f"{_rate_sql(f'{n}_rank > 0', 'should_admit')} {n}_path_hit"] if hit else [])])
    return f"count(*) n, count(*) FILTER (WHERE should_admit) positives, {', '.join(map(of, names))}"


_STRICT = f"""{decisions._FEATURES}, hr AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY request_id ORDER BY rank) rank FROM hits WHERE source_type <> 'incident'), {decisions.PO}, {decisions.actions_sql()}"""
_INCIDENTS = decisions.features_sql(_STRICT, "hr", "_r") + f", {decisions.actions_sql('_r')}, inc AS (SELECT a.request_id, b.decision = 'admit' repository_allowed, a.decision = 'admit' mixed_allowed, (SELECT count(*) FROM parts p WHERE p.request_id = a.request_id AND twin AND source_type = 'incident') n_incidents FROM ac a JOIN ac_r b USING (request_id, policy) WHERE policy = 'strict')"
_DECOY = f"""dt AS (SELECT DISTINCT request_id, path FROM (SELECT path, lower(unnest(regexp_extract_all(path, '[A-Za-z0-9_]+'))) token FROM docs) JOIN (SELECT request_id, lower(unnest(regexp_extract_all(query, '[A-Za-z0-9_]+'))) token FROM reqs) USING (token) WHERE length(token) > 1 AND token NOT IN ({rules.STOP})),
dy AS (SELECT request_id, min(path) path FROM reqs, (SELECT path FROM docs WHERE path NOT LIKE 'tests/%' AND path NOT LIKE 'docs/%') p WHERE NOT list_contains(changed_paths, path) AND NOT EXISTS (SELECT 1 FROM dt WHERE dt.request_id = reqs.request_id AND dt.path = p.path) GROUP BY request_id)"""
_TESTED = f"""go AS (SELECT request_id, path, row_number() OVER (PARTITION BY request_id ORDER BY path) rank FROM sup WHERE {_GOLD_TESTS} AND (contains('/' || path, '/tests/') OR contains(path, '.test.'))),
lz AS (SELECT request_id, path, row_number() OVER (PARTITION BY request_id ORDER BY rank) rank FROM lr JOIN docs USING (path) JOIN reqs USING (request_id) WHERE plan = 0 AND lr.rank <= 20 AND source_type = 'test' AND NOT list_contains(changed_paths, path) AND request_id NOT IN (SELECT request_id FROM go)),
rt AS (SELECT * FROM go WHERE rank <= 2 UNION ALL SELECT * FROM lz WHERE rank <= 2)"""
_ALL = "TRUE"
_before, _after = (x.replace("\n", "' || chr(10) || '") for x in fixed.HEALING_PROMPT)
_RETRY = f"""SELECT request_id, trim(regexp_replace(split_part(trim(query), chr(10) || chr(10), 1), '\\s+', ' ', 'g'))[:600] || '{_before}' || coalesce(nullif(array_to_string(missing[:3], '; '), ''), '{fixed.NO_GUIDANCE}') || '{_after}' query, list_concat(changed_paths, list_filter(added, lambda x: NOT list_contains(changed_paths, x))) changed_paths
  FROM ac JOIN reqs USING (request_id) JOIN (SELECT request_id, list_sort(list(path)) added FROM rt GROUP BY request_id) USING (request_id) WHERE policy = 'agile' AND decision <> 'admit' AND len(list_filter(missing, lambda m: contains(lower(m), 'test evidence'))) > 0"""
_FIRST = f"{decisions._ACTIONS}, {_TESTED}"
_nested = lambda reqs: f"SELECT request_id, decision, missing FROM ({decisions.features_sql(rules.hits_sql(f'reqs AS ({reqs})'))}, {decisions.PO}, {decisions.actions_sql()} SELECT * FROM ac WHERE policy = 'agile')"
_DECOYED = f"SELECT request_id, query, [path] changed_paths FROM (WITH {CORPUS_SQL}, {REQUESTS_SQL}, {_DECOY} SELECT request_id, query, path FROM reqs JOIN dy USING (request_id))"
_REPLAYED = f"""{_FIRST}, again AS ({_nested(_FIRST + ' ' + _RETRY)}), decoyed AS ({_nested(_DECOYED)}), bs AS (SELECT request_id, avg(score) FILTER (WHERE rank <= 3) base_support, count(*) FILTER (WHERE rank <= 5 AND score >= 0.32) strong FROM lr WHERE plan = 0 AND rank <= 12 GROUP BY request_id),
rp AS (SELECT request_id, request_id % 5 repo, a.decision = 'admit' initial_allowed, len(list_filter(a.missing, lambda m: contains(lower(m), 'test evidence'))) > 0 test_gap, g.decision IS NOT NULL retried, coalesce(g.decision = 'admit', a.decision = 'admit') healed_allowed, coalesce(y.decision = 'admit', FALSE) decoy_allowed,
  coalesce(list_contains(y.missing, '{fixed.NOTE_GAP}'), FALSE) alignment_gap, coalesce(round(base_support, 6) >= 0.32 AND strong >= 2, FALSE) baseline_allowed FROM (SELECT * FROM ac WHERE policy = 'agile') a LEFT JOIN again g USING (request_id) LEFT JOIN decoyed y USING (request_id) LEFT JOIN bs USING (request_id))"""
_ORDERED = f"""WITH i AS (SELECT coalesce(source, 'none') repo, doc_id instance_id, doc_id % 8 IN (1, 7) has_test, doc_id % 3 n_paths FROM documents), z AS (SELECT repo, count(*) size, CASE repo WHEN 'src7' THEN 0 WHEN 'src3' THEN 1 ELSE 2 END p FROM i GROUP BY repo),
r AS (SELECT *, row_number() OVER (ORDER BY p, size, repo) rr FROM z), y AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY has_test DESC, n_paths, instance_id) item FROM i JOIN r USING (repo))"""
ORACLE_SQL = {
    "evaluation_cases": f"WITH {_CASES} SELECT case_id, topic, query, should_admit FROM cases",
    "evaluation_results": f"{_RESULTS} SELECT * EXCLUDE (request_id) FROM res",
    "confusion_metrics": f"{_RESULTS} SELECT {_confusion_sql('structural', 'baseline')} FROM res",
    "evaluation_wins": f"{_RESULTS} SELECT case_id, CASE WHEN structural = should_admit THEN 'structural' ELSE 'baseline' END winner FROM res WHERE structural <> baseline",
    "focus_decision": f"{rules.HITS_SQL}, {_focus_sql('hits')} SELECT * FROM fd",
    "poisoned_metrics": f"{decisions.features_sql(_RESULTS)} SELECT {_confusion_sql('decided', 'baseline', hit=False)} FROM (SELECT should_admit, baseline, decision = 'admit' decided FROM res JOIN de USING (request_id))",
    "incident_results": f"{_INCIDENTS} SELECT * FROM inc",
    "incident_rates": f"{_INCIDENTS} SELECT count(*) n, {_rate_sql('NOT repository_allowed')} repository_block_rate, {_rate_sql('NOT mixed_allowed')} mixed_block_rate, {_rate_sql('n_incidents > 0')} incident_hit_rate, {_rate_sql('repository_allowed AND NOT mixed_allowed')} incremental_block_rate FROM inc",
    "decoy_selection": f"WITH {CORPUS_SQL}, {REQUESTS_SQL}, {_DECOY} SELECT request_id, path FROM reqs LEFT JOIN dy USING (request_id)",
    "retry_tests": f"{rules.HITS_SQL}, {_TESTED} SELECT request_id, path, CAST(rank AS INTEGER) rank FROM rt",
    "healing_requests": f"SELECT request_id, md5(query) query_md5, array_to_string(changed_paths, '|') changed_paths FROM ({_FIRST} {_RETRY})",
    "replay_results": f"{_REPLAYED} SELECT * FROM rp",
    "replay_rates": f"{_REPLAYED} SELECT count(*) n, count(DISTINCT repo) n_repos, {', '.join(f'{_rate_sql(c, of or _ALL)} {name}' for name, c, of in _REPLAY)} FROM rp",
    "group_rates_rollup": f"""{_REPLAYED}, gh AS (SELECT *, EXISTS (SELECT 1 FROM parts p JOIN reqs q USING (request_id) WHERE p.request_id = rp.request_id AND NOT twin AND list_contains(changed_paths, path)) source_hit, EXISTS (SELECT 1 FROM parts p JOIN rt USING (request_id, path) WHERE p.request_id = rp.request_id AND NOT twin) test_hit FROM rp)
        SELECT repo, count(*) n, {', '.join(f'{_rate_sql(c)} {c}_rate' for c in ('initial_allowed', 'decoy_allowed', 'source_hit', 'test_hit'))}, CAST(grouping(repo) AS INTEGER) is_total FROM gh GROUP BY ROLLUP (repo)""",
    "top2_concentration": "WITH n AS (SELECT source, count(*) n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) rank FROM n) SELECT source, n, round(n / sum(n) OVER (), 6) share, CAST(rank AS INTEGER) rank, round(sum(CASE WHEN rank <= 2 THEN n END) OVER () / sum(n) OVER (), 6) top2 FROM r",
    "stratified_sample": f"{_ORDERED} SELECT repo, instance_id, CAST(place AS INTEGER) place FROM (SELECT *, row_number() OVER (ORDER BY rr, item) place FROM y) WHERE place <= 150",
    "pilot_sample": f"{_ORDERED} SELECT repo, instance_id, CAST(rr AS INTEGER) place FROM y WHERE item = 1 AND rr <= 12",
    "patch_paths": "SELECT page_id, 'src/' || page_id || '.py,' || regexp_extract(url, '^https?://([^/]+)', 1) paths FROM pages",
    "expected_rank": f"WITH {SCORES_SQL} SELECT request_id, CAST(coalesce(min(rank) FILTER (WHERE contains(path, 'tests/') OR contains(path, '/src' || (request_id % 20) || '/')), -1) AS INTEGER) rank FROM reqs LEFT JOIN ranked USING (request_id) GROUP BY request_id",
    "precedents": """WITH n AS (SELECT o_orderkey line, o_orderkey // 2 number, lower(o_orderpriority) topic FROM orders WHERE o_orderkey % 7 > 2), f AS (SELECT topic, number, min(line) line FROM n GROUP BY ALL)
        SELECT topic, number, line, 'https://host/pull/' || number url, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY line, number) rank FROM f) WHERE rank <= 3""",
    "chat_threads": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) k FROM conversations WHERE trim(text) <> '') SELECT conv_id, max(role) FILTER (WHERE k = 1) author, count(*) n_messages, md5(string_agg(role || ': ' || text, chr(10) ORDER BY k) FILTER (WHERE k <= 25)) content_md5 FROM r GROUP BY conv_id",
    "corpus_union": f"WITH {CORPUS_SQL} SELECT source_type, count(*) n, CAST(sum(length(content)) AS BIGINT) chars FROM (SELECT source_type, content FROM docs UNION ALL SELECT 'doc', html FROM pages UNION ALL SELECT 'incident', text FROM conversations) WHERE trim(content) <> '' GROUP BY ALL",
}
