"""Queries on text, paths and lexical ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import fixed, paths, text
from assay.operators import lexical
from assay.plans.rules import stem_sql, tokens_sql, words_sql
from assay.sources.shared import once, written
from assay.sources.tables import CORPUS_SQL, REQUESTS_SQL, corpus, corpus_paths, requests, sized, table

POSTINGS_SQL = f"""{CORPUS_SQL}, {tokens_sql("ct", "docs", "content", "path")}, {tokens_sql("pt", "docs", "replace(path, '/', ' ')", "path")},
post AS (SELECT path, token, sum(c) tf, sum(p) path_tf FROM (SELECT path, token, 1 c, 0 p FROM ct UNION ALL SELECT path, token, 0, 1 FROM pt) GROUP BY ALL),
dfs AS (SELECT token, count(*) FILTER (WHERE tf > 0) df FROM post GROUP BY token)"""
SCORES_SQL = f"""{POSTINGS_SQL}, {REQUESTS_SQL}, {tokens_sql("qt", "reqs", "query", "request_id")}, qc AS (SELECT request_id, token, count(*) q FROM qt GROUP BY ALL),
qw AS (SELECT qc.*, ln(((SELECT count(*) FROM docs) + 1) / (1 + coalesce(df, 0))) + 1.0 idf FROM qc LEFT JOIN dfs USING (token)),
most AS (SELECT request_id, sum(idf * q) most, count(*) n FROM qw GROUP BY ALL),
scored AS (SELECT request_id, path, round(least(1.0, 0.6 * count(*) / max(n) + 0.4 * least(1.0, sum(least(q, greatest(tf, path_tf)) * idf) / max(most))), 6) score FROM post JOIN qw USING (token) JOIN most USING (request_id) GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, path) rank FROM scored) WHERE rank <= 12)"""


def classify_source(spark, d):
    c = corpus(spark, d)
    return c.groupBy("source_type", paths.is_test(F.col("path")).alias("is_test")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def frontend_paths(spark, d):
    u = F.concat(F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), r"^https?://[^/]*/", ""), F.when(F.pmod("page_id", F.lit(2)) == 0, "/app/Page.tsx").otherwise("/lib/index.js"))
    p = table(spark, d, "pages").select("page_id", paths.normalized(u).alias("path"))
    return p.select("page_id", "path", paths.is_script(F.col("path")).alias("is_script"), paths.is_frontend(F.col("path")).alias("is_frontend"), paths.suffix(F.col("path")).alias("suffix"))


def postings(spark, d):
    """The corpus's postings, written once."""
    return once(spark, d, "postings", lambda: lexical.postings(corpus(spark, d)))


def texts(spark, d):
    """The corpus where it is read time and again: written once if its splits have to be dealt out to the cores, else read from its table, so that no copy of it is written."""
    few = table(spark, d, "documents").rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    return once(spark, d, "corpus", lambda: corpus(spark, d)) if few else corpus(spark, d)


def distinct(spark, d):
    """Whether each path is that of one document; the texts of one path are else taken together, by operators that shuffle them."""
    again = once(spark, d, "repeated", lambda: corpus_paths(spark, d).groupBy("path").agg(F.count("*").alias("n")).where("n > 1 OR path IS NULL").select("path"))
    return again.isEmpty()


def ranked(spark, d, asked, k, keys=("request_id",)):
    """The k best documents of each request: by a reading of the texts if the requests are few, else by postings."""
    n, found = table(spark, d, "documents").count(), None
    if distinct(spark, d):
        c = texts(spark, d)
        found = lexical.scanned(c, once(spark, d, "word-counts", lambda: lexical.word_counts(c)), n, asked, k, keys)
    return lexical.top(lexical.scores(postings(spark, d), n, asked, keys), k, keys) if found is None else found


def tokenize_tf(spark, d):
    return postings(spark, d).where("tf > 0").select("path", "token", "tf")


def doc_frequency(spark, d):
    return lexical.document_frequency(postings(spark, d))


def idf(spark, d):
    df = lexical.document_frequency(postings(spark, d))
    return df.select("token", F.round(lexical.idf(F.col("df"), F.lit(table(spark, d, "documents").count())), 6).alias("idf"))


def lexical_topk(spark, d):
    return ranked(spark, d, requests(spark, d), 12)


def baseline_decision(spark, d):
    return lexical.baseline(lexical_topk(spark, d))


def best_snippets(spark, d):
    hits = lexical_topk(spark, d).where("rank <= 3")
    return lexical.best_lines(texts(spark, d), requests(spark, d), hits)


def path_anchor_tokens(spark, d):
    c = corpus(spark, d)
    return c.select("doc_id", F.array_join(paths.anchor_words(F.col("path")), ",").alias("words"), paths.label(F.col("path")).alias("label"), paths.module_name(F.col("path")).alias("module"))


def qgram_overlap(spark, d):
    """Share of a request's 3-grams that each of its lexical hits has in its whole text."""
    hits = written(lexical_topk(spark, d).select("request_id", "path"), "hits")
    r = requests(spark, d).select("request_id", text.qgrams(F.col("query")).alias("q"))
    found = corpus(spark, d).select("path", "content").join(sized(hits), "path").select("request_id", "path", F.concat(F.lit(" "), text.normalized(F.col("content")), F.lit(" ")).alias("s"))
    both = written(found, "texts").hint("merge").join(r, "request_id")
    # a text has a 3-gram if it contains it: its own grams need not be made
    return both.select("request_id", "path", F.round(F.size(F.filter("q", lambda g: F.contains(F.col("s"), g))) / F.greatest(F.lit(1), F.size("q")), 6).alias("structural"))


def html_pages(spark, d):
    p = table(spark, d, "pages")
    body = text.stripped_html(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "))
    host = F.parse_url("url", F.lit("HOST"))
    return p.select("page_id", host.alias("host"), F.parse_url("url", F.lit("PATH")).alias("url_path"), text.slug(host).alias("slug"), F.md5(body).alias("text_md5"), text.trimmed(body).alias("trimmed"), text.title(body).alias("title"))


def sections(spark, d):
    c = corpus(spark, d)
    return c.select("path", F.md5(text.summary(F.col("content"))).alias("summary_md5"), F.size(text.lines(F.col("content"))).alias("n_lines"), text.decision_name(F.concat(F.lit("Decision."), F.upper("source_type"))).alias("kind"))


QUERIES = {
    f.__name__: f for f in (classify_source, frontend_paths, tokenize_tf, doc_frequency, idf, lexical_topk, baseline_decision, best_snippets, path_anchor_tokens, qgram_overlap, html_pages, sections)
}

_UNTAG = "regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _name, _char in text.ENTITIES:
    _UNTAG = "regexp_replace({}, '{}', '{}', 'g')".format(_UNTAG, _name, _char.replace("'", "''"))
_UNTAG = f"trim(regexp_replace({_UNTAG}, '\\s+', ' ', 'g'))"
ORACLE_SQL = {
    "classify_source": f"WITH {CORPUS_SQL} SELECT source_type, source_type = 'test' is_test, count(*) n, CAST(sum(length(content)) AS BIGINT) chars FROM docs GROUP BY ALL",
    "frontend_paths": """WITH p AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '^https?://[^/]*/', '') || CASE WHEN page_id % 2 = 0 THEN '/app/Page.tsx' ELSE '/lib/index.js' END path FROM pages)
        SELECT page_id, path, TRUE is_script, path LIKE '%.tsx' OR regexp_matches(path, '(^|/)(app|apps|components|pages|routes|web)/') OR regexp_matches(lower(path), '/(components|pages|routes|app|ui)/') is_frontend, CASE WHEN path LIKE '%.tsx' THEN '.tsx' ELSE '.js' END suffix FROM p""",
    "tokenize_tf": f"WITH {CORPUS_SQL}, {tokens_sql('ct', 'docs', 'content', 'path')} SELECT path, token, count(*) tf FROM ct GROUP BY ALL",
    "doc_frequency": f"WITH {POSTINGS_SQL} SELECT token, df FROM dfs",
    "idf": f"WITH {POSTINGS_SQL} SELECT token, round(ln(((SELECT count(*) FROM docs) + 1) / (1 + df)) + 1.0, 6) idf FROM dfs",
    "lexical_topk": f"WITH {SCORES_SQL} SELECT request_id, path, score, CAST(rank AS INTEGER) rank FROM ranked",
    "baseline_decision": f"""WITH {SCORES_SQL} SELECT request_id, support, n_strong, CASE WHEN support >= 0.32 AND n_strong >= 2 THEN 'admit' ELSE 'abstain' END decision
        FROM (SELECT request_id, round(avg(score) FILTER (WHERE rank <= 3), 6) support, count(*) FILTER (WHERE rank <= 5 AND score >= 0.32) n_strong FROM ranked GROUP BY ALL)""",
    "best_snippets": f"""WITH {SCORES_SQL}, ls AS (SELECT request_id, path, unnest(string_split(rtrim(content, chr(10)), chr(10))) l, unnest(generate_series(1, len(string_split(rtrim(content, chr(10)), chr(10))))) line_number FROM ranked JOIN docs USING (path) WHERE rank <= 3),
        c AS (SELECT request_id, path, line_number, trim(regexp_replace(l, '\\s+', ' ', 'g')) clean FROM ls), n AS (SELECT request_id, path, line_number, clean, count(token) n FROM c LEFT JOIN (SELECT DISTINCT request_id, token FROM qt) USING (request_id) WHERE contains(lower(clean), token) OR token IS NULL GROUP BY ALL),
        z AS (SELECT c.*, coalesce(n, 0) n FROM c LEFT JOIN n USING (request_id, path, line_number, clean) WHERE clean <> '')
        SELECT request_id, path, CAST(line_number AS INTEGER) line_number, clean[:240] snippet FROM (SELECT *, row_number() OVER (PARTITION BY request_id, path ORDER BY n DESC, line_number) k FROM z) WHERE k = 1""",
    "path_anchor_tokens": f"""WITH {CORPUS_SQL} SELECT doc_id, array_to_string({words_sql('path')}, ',') words, lower({stem_sql('path')}) AS label, replace(regexp_replace(path, '\\.py$', ''), '/', '.') module FROM docs""",
    "qgram_overlap": f"""WITH {SCORES_SQL}, n AS (SELECT request_id, path, ' ' || lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) || ' ' q, ' ' || lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) || ' ' s FROM ranked JOIN docs USING (path) JOIN reqs USING (request_id)),
        g AS (SELECT request_id, path, s, list_distinct(list_transform(generate_series(1, greatest(length(q) - 2, 1)), lambda i: q[i:i + 2])) q FROM n)
        SELECT request_id, path, round(len(list_filter(q, lambda x: contains(s, x))) / greatest(1, len(q)), 6) structural FROM g""",
    "html_pages": f"""WITH b AS (SELECT page_id, url, {_UNTAG} body FROM pages), h AS (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) host FROM b)
        SELECT page_id, host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) url_path, regexp_replace(host, '[^A-Za-z0-9._-]+', '-', 'g') slug, md5(body) text_md5,
        CASE WHEN body = '' THEN NULL WHEN length(body) <= 180 THEN body ELSE rtrim(body[:179]) || '…' END trimmed, split_part(body, '. ', 1)[:96] title FROM h""",
    "sections": f"""WITH {CORPUS_SQL} SELECT path, md5(trim(regexp_replace(split_part(trim(content), chr(10) || chr(10), 1), '\\s+', ' ', 'g'))[:600]) summary_md5, CAST(len(string_split(CASE WHEN content LIKE '%' || chr(10) THEN content[:-2] ELSE content END, chr(10))) AS INTEGER) n_lines, source_type kind FROM docs""",
}
