"""SQL texts of the rules on paths, spans and hybrid search that the queries' SQL shares."""

from __future__ import annotations

from assay.functions import fixed
from assay.plans.spans import windows_sql
from assay.sources.tables import CORPUS_SQL, EDGES_SQL, REQUESTS_SQL


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_GENERIC, _STEMS = listed(fixed.GENERIC_PATH_WORDS), listed(fixed.GENERIC_STEMS)


def stem_sql(p: str) -> str:
    return f"regexp_replace(string_split({p}, '/')[-1], '(.)\\.[^.]*$', '\\1')"


def words_sql(p: str) -> str:
    """Sorted distinct anchor words of a path."""
    one = "list_transform(regexp_extract_all(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda y: lower(y))"
    extra = f"CASE WHEN lower({stem_sql(p)}) IN ({_STEMS}) AND len(string_split({p}, '/')) > 1 THEN string_split({p}, '/')[-2] ELSE {stem_sql(p)} END"
    bare = f"list_filter(list_transform(list_concat(string_split({p}, '/')[-4:], [{extra}]), lambda x: regexp_replace(x, '(.)\\.[^.]*$', '\\1')), lambda x: lower(x) NOT IN ({_GENERIC}))"
    return f"list_sort(list_distinct(list_filter(flatten(list_transform({bare}, lambda x: list_concat({one}, [array_to_string({one}, '')]))), lambda w: length(w) >= 3 AND w NOT IN ({_GENERIC}))))"


def link_sql(source: str, test: str, source_words: str, test_words: str) -> str:
    """How well a test path fits a source path."""
    folders = lambda p: f"list_distinct(list_filter(list_transform(string_split({p}, '/')[:-2], lambda x: lower(x)), lambda x: x NOT IN ({_GENERIC})))"
    generic = f"(lower({stem_sql(source)}) IN ({_STEMS}) AND len(string_split({source}, '/')) > 1)"
    parent = f"lower(string_split({source}, '/')[-2])"
    overlap = f"len(list_intersect({source_words}, {test_words}))"
    score = f"""least(1.0, 0.25 + 0.45 * {overlap} / greatest(len({source_words}), 1) + CASE WHEN list_contains({test_words}, CASE WHEN {generic} THEN {parent} ELSE lower({stem_sql(source)}) END) THEN 0.2 ELSE 0 END
      + least(0.15, 0.05 * len(list_intersect({folders(source)}, {folders(test)}))) + CASE WHEN {generic} AND list_contains({test_words}, {parent}) THEN 0.15 ELSE 0 END)"""
    return f"CASE WHEN {overlap} > 0 THEN {score} ELSE 0 END"


STOP = listed(fixed.STOP_WORDS)


def tokens_sql(name: str, source: str, column: str, keys: str) -> str:
    return f"{name} AS (SELECT {keys}, token FROM (SELECT {keys}, lower(unnest(regexp_extract_all({column}, '[A-Za-z0-9_]+'))) token FROM {source}) WHERE length(token) > 1 AND token NOT IN ({STOP}))"


_NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_GRAMS = "unnest(list_distinct(list_transform(generate_series(1, greatest(length({0}) - 2, 1)), lambda i: {0}[i:i + 2])))"
MATCH, FINAL = 20, 10

SPANS_SQL = f"""ln AS (SELECT path, source_type, unnest(string_split(c, chr(10))) raw, unnest(generate_series(1, len(string_split(c, chr(10))))) line FROM (SELECT path, source_type, regexp_replace(content, '\\n$', '') c FROM docs)),
il AS (SELECT *, sum(CASE WHEN trim(raw) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) island FROM ln),
pa AS (SELECT path, source_type, min(line) line_number, string_agg(CASE WHEN source_type IN ('code', 'test') THEN rtrim(raw) ELSE trim(raw) END, chr(10) ORDER BY line) text FROM il WHERE trim(raw) <> '' GROUP BY path, source_type, island),
su AS (SELECT path, source_type, min(line) line_number, path || chr(10) || source_type || chr(10) || string_agg(trim(raw), chr(10) ORDER BY line) text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) k FROM ln WHERE trim(raw) <> '') WHERE k <= 8 GROUP BY path, source_type),
sp AS (SELECT path || '#' || kind || '#' || line_number span, *, path || ' ' || source_type || ' ' || text search_text, count(*) OVER (PARTITION BY {_NORM.format('text')}) occurrences FROM (SELECT *, 1 kind FROM pa UNION ALL SELECT *, 0 FROM su))"""

PLANNED_SQL = f"""pw AS (SELECT request_id, query, changed_paths, {words_sql('changed_paths[1]')} a, CASE WHEN len(changed_paths) > 1 THEN {words_sql('changed_paths[2]')} ELSE [] END b FROM reqs),
wd AS (SELECT request_id, query, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x)))[:8] words, len(list_filter(changed_paths, lambda x: regexp_matches(x, '\\.(jsx|tsx)$'))) > 0 front FROM pw),
pq AS (SELECT request_id, 0 plan, query, 1.0::DOUBLE weight, FALSE support_only FROM wd UNION ALL SELECT request_id, 1, array_to_string(list_concat(words, ['test', 'regression', 'spec']), ' '), 0.75, TRUE FROM wd WHERE len(words) > 0
  UNION ALL SELECT request_id, 2, array_to_string(list_concat(words, ['component', 'render', 'test']), ' '), 0.65, TRUE FROM wd WHERE len(words) > 0 AND front)"""

#: Spans of the planned queries: sm (request_id, plan, span, structural, cosine, final), ss (with score, verified and snippet).
def structural_sql(requests: str = REQUESTS_SQL) -> str:
    return f"""WITH RECURSIVE {CORPUS_SQL}, {EDGES_SQL}, {requests}, {PLANNED_SQL}, {SPANS_SQL}, {windows_sql('w', 'sp', 'span', 'text')},
lim AS (SELECT round(list_sort(list(hazard))[CAST(floor(0.8 * (count(*) - 1)) AS BIGINT) + 1], 6) threshold FROM w),
fa AS (SELECT span, round(avg(hazard), 6) hazard, round(avg(CASE WHEN round(hazard, 6) <= (SELECT threshold FROM lim) THEN 1.0 ELSE 0.0 END), 6) coverage FROM w GROUP BY span),
{tokens_sql('qt', 'pq', 'query', 'request_id, plan')}, {tokens_sql('st', 'sp', 'search_text', 'span')},
sv AS (SELECT span, CAST('0x' || md5(token)[1:2] AS INTEGER) b, count(*) c FROM st GROUP BY ALL), qv AS (SELECT request_id, plan, CAST('0x' || md5(token)[1:2] AS INTEGER) b, count(*) c FROM qt GROUP BY ALL),
sn AS (SELECT span, sqrt(sum(c * c)) n FROM sv GROUP BY span), qn AS (SELECT request_id, plan, sqrt(sum(c * c)) n FROM qv GROUP BY ALL),
cs AS (SELECT request_id, plan, span, round(least(1.0, sum(sv.c * qv.c) / max(sn.n) / max(qn.n)), 6) cosine FROM sv JOIN sn USING (span) JOIN qv USING (b) JOIN qn USING (request_id, plan) GROUP BY ALL),
sg AS (SELECT span, {_GRAMS.format('s')} g FROM (SELECT span, ' ' || {_NORM.format('search_text')} || ' ' s FROM sp)), qg AS (SELECT request_id, plan, {_GRAMS.format('s')} g FROM (SELECT request_id, plan, ' ' || {_NORM.format('query')} || ' ' s FROM pq WHERE trim(query) <> '')),
qs AS (SELECT request_id, plan, count(*) n FROM qg GROUP BY ALL), ov AS (SELECT request_id, plan, span, count(*) c FROM qg JOIN sg USING (g) GROUP BY ALL),
ca AS (SELECT DISTINCT request_id, plan, span FROM qt JOIN st USING (token) UNION ALL SELECT request_id, plan, span FROM pq, sp WHERE trim(query) <> '' AND NOT EXISTS (SELECT 1 FROM qt JOIN st USING (token) WHERE qt.request_id = pq.request_id AND qt.plan = pq.plan)),
bo AS (SELECT DISTINCT request_id, plan, path FROM docs, (SELECT DISTINCT request_id, plan, token FROM qt) WHERE contains(lower(path), token)),
sc AS (SELECT request_id, plan, span, round(coalesce(c, 0) / n, 6) structural, coalesce(cosine, 0) cosine FROM ca JOIN qs USING (request_id, plan) LEFT JOIN ov USING (request_id, plan, span) LEFT JOIN cs USING (request_id, plan, span)),
sf AS (SELECT request_id, plan, structural, cosine, sp.*, round(least(1.0, 0.45 * structural + 0.47 * cosine + CASE WHEN bo.path IS NOT NULL THEN 0.08 ELSE 0 END) + 1e-9, 6) final FROM sc JOIN sp USING (span) LEFT JOIN bo USING (request_id, plan, path)),
sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, plan ORDER BY final DESC, cosine DESC, structural DESC, occurrences DESC, path, line_number, kind) rank FROM sf WHERE final > 0) WHERE rank <= {MATCH}),
ss AS (SELECT sm.*, round(least(1.0, 0.45 * final + 0.25 * coalesce(coverage, 0) + 0.15 * (1 - coalesce(hazard, 1)) + 0.15 * cosine) + 1e-9, 6) score,
  coalesce(coverage, 0) >= 0.5 AND coalesce(hazard, 1) <= greatest(0.75, (SELECT threshold FROM lim)) AND (cosine >= 0.08 OR 1 - coalesce(hazard, 1) >= 0.08) verified, trim(regexp_replace(text, '\\s+', ' ', 'g'))[:240] snippet FROM sm LEFT JOIN fa USING (span))"""

#: Support paths of requests: sup (request_id, path) and bst (request_id, path, boost).
SUPPORT_SQL = f"""nb AS (SELECT DISTINCT request_id, node, other FROM (SELECT request_id, unnest(changed_paths) node FROM reqs) JOIN (SELECT src node, dst other FROM edges UNION SELECT dst, src FROM edges) USING (node)),
so AS (SELECT DISTINCT source FROM (SELECT unnest(changed_paths) source FROM reqs UNION ALL SELECT other FROM nb)), sow AS (SELECT source, {words_sql('source')} sw FROM so), te AS (SELECT path test, {words_sql('path')} tw FROM docs WHERE source_type = 'test'),
li AS (SELECT source, test, round(greatest(CASE WHEN e THEN 0.8 ELSE 0 END, {link_sql('source', 'test', 'sw', 'tw')}), 6) score FROM (SELECT source, test, sw, tw, EXISTS (SELECT 1 FROM edges WHERE (src = source AND dst = test) OR (src = test AND dst = source)) e FROM sow, te)),
lt AS (SELECT source, test, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, test) rank FROM li WHERE score >= 0.4) WHERE rank <= 5),
ch AS (SELECT request_id, unnest(changed_paths) node FROM reqs),
sup AS (SELECT DISTINCT request_id, other path FROM nb UNION SELECT request_id, test FROM ch JOIN lt ON source = node UNION SELECT request_id, test FROM nb JOIN lt ON source = other),
bst AS (SELECT request_id, path, max(boost) boost FROM (SELECT request_id, path, CASE WHEN contains('/' || path, '/tests/') OR contains(path, '.test.') THEN 0.16 ELSE 0.1 END boost FROM sup UNION ALL SELECT request_id, test, 0.12 + 0.18 * score FROM ch JOIN lt ON source = node) GROUP BY ALL)"""

#: Lexical hits of the planned queries: lh (request_id, plan, path, source_type, score, snippet, line_number).
LEXICAL_SQL = f"""{tokens_sql('ct', 'docs', 'content', 'path')}, {tokens_sql('pt', 'docs', "replace(path, '/', ' ')", 'path')},
post AS (SELECT path, token, sum(c) tf, sum(p) path_tf FROM (SELECT path, token, 1 c, 0 p FROM ct UNION ALL SELECT path, token, 0, 1 FROM pt) GROUP BY ALL), dfs AS (SELECT token, count(*) FILTER (WHERE tf > 0) df FROM post GROUP BY token),
lc AS (SELECT request_id, plan, token, count(*) q FROM qt GROUP BY ALL), lw AS (SELECT lc.*, ln(((SELECT count(*) FROM docs) + 1) / (1 + coalesce(df, 0))) + 1.0 idf FROM lc LEFT JOIN dfs USING (token)), lm AS (SELECT request_id, plan, sum(idf * q) most, count(*) n FROM lw GROUP BY ALL),
lx AS (SELECT request_id, plan, path, round(least(1.0, 0.6 * count(*) / max(n) + 0.4 * least(1.0, sum(least(q, greatest(tf, path_tf)) * idf) / max(most))), 6) score FROM post JOIN lw USING (token) JOIN lm USING (request_id, plan) GROUP BY ALL),
lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, plan ORDER BY score DESC, path) rank FROM lx) WHERE rank <= {MATCH}),
ll AS (SELECT request_id, plan, path, line, trim(regexp_replace(raw, '\\s+', ' ', 'g')) clean FROM lr JOIN ln USING (path)),
ls AS (SELECT request_id, plan, path, line, clean, (SELECT count(DISTINCT token) FROM qt WHERE qt.request_id = ll.request_id AND qt.plan = ll.plan AND contains(lower(clean), token)) n FROM ll WHERE clean <> ''),
lh AS (SELECT request_id, plan, path, source_type, score, clean[:240] snippet, line line_number FROM (SELECT *, row_number() OVER (PARTITION BY request_id, plan, path ORDER BY n DESC, line) k FROM ls) JOIN lr USING (request_id, plan, path) JOIN docs USING (path) WHERE k = 1)"""

#: Ranked hits: hits (request_id, path, source_type, score, verified, snippet, line_number, rank).
def hits_sql(requests: str = REQUESTS_SQL) -> str:
    return f"""{structural_sql(requests)}, {SUPPORT_SQL}, {LEXICAL_SQL},
al AS (SELECT * FROM (SELECT request_id, plan, path, source_type, score, verified, snippet, line_number, 1.0 most FROM ss UNION ALL SELECT request_id, plan, path, source_type, score, FALSE, snippet, line_number, 0.75 FROM lh) JOIN pq USING (request_id, plan)
  WHERE snippet <> ''),
aw AS (SELECT *, round(least(1.0, score * least(weight, most)) + 1e-9, 6) w FROM al WHERE NOT support_only OR (request_id, path) IN (SELECT (request_id, path) FROM sup)),
fu AS (SELECT request_id, path, source_type, round(1 - product(1 - w) + 1e-9, 6) score, bool_or(verified) verified, max((verified, w, -plan, -line_number, snippet)) b FROM aw GROUP BY ALL),
fb AS (SELECT request_id, path, source_type, CASE WHEN boost IS NULL THEN score ELSE round(least(1.0, score + boost), 6) END score, verified, b[5] snippet, -b[4] line_number FROM fu LEFT JOIN bst USING (request_id, path)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY verified DESC, score DESC, path) rank FROM fb) WHERE rank <= {FINAL})"""


STRUCTURAL_SQL, HITS_SQL = structural_sql(), hits_sql()
#: The requests as plain queries.
QUERY_REQUESTS_SQL = "reqs AS (SELECT item_id request_id, coalesce(text, '') query, CAST([] AS VARCHAR[]) changed_paths FROM benchmark)"
