"""Queries on spans, windows and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import fixed, text
from assay.operators import spans
from assay.sources.tables import CORPUS_SQL, corpus, requests


def _windows(spark, d):
    return spans.windows(corpus(spark, d), "path", "content").withColumn("signature", spans.signature())


def span_segmentation(spark, d):
    return spans.span_ids(spans.segments(corpus(spark, d))).select("path", "line_number", "span_id", F.length("text").alias("n_chars"))


def span_occurrences(spark, d):
    rows = corpus(spark, d).select("path", F.explode(text.lines(F.col("content"))).alias("text"))
    return spans.occurrences(rows).where("occurrences > 1 AND norm <> ''").select(F.md5("norm").alias("text_md5"), "occurrences")


def sliding_windows(spark, d):
    return spans.windows(corpus(spark, d), "path", "content").select("path", "window_index", "byte_start", "byte_end", "char_start", "char_end")


def window_metrics(spark, d):
    r = [F.round(c, 6).alias(c) for c in ("entropy", "coherence", "stability", "hazard")]
    return _windows(spark, d).select("path", "window_index", *r, "signature")


def span_metrics(spark, d):
    return spans.span_metrics(_windows(spark, d), "path", corpus(spark, d))


def signature_index(spark, d):
    return spans.signature_index(_windows(spark, d), "path")


def hazard_threshold(spark, d):
    return spans.hazard_threshold(_windows(spark, d))


def hazard_by_path(spark, d):
    """Each text's own threshold and the windows that pass its gate."""
    return spans.hazard_thresholds(_windows(spark, d), "path")


def span_coverage(spark, d):
    w = _windows(spark, d)
    return spans.coverage(w, spans.hazard_threshold(w), "path")


def verify_external(spark, d):
    w = _windows(spark, d)
    limit = spans.hazard_threshold(w).first()
    index = spans.signature_index(w, "path")
    q = spans.windows(requests(spark, d), "request_id", "query").withColumn("signature", spans.signature())
    return spans.verified(q, index, max(limit.threshold or 0.0, fixed.HAZARD_FLOOR), "request_id")


QUERIES = {f.__name__: f for f in (span_segmentation, span_occurrences, sliding_windows, window_metrics, span_metrics, signature_index, hazard_threshold, hazard_by_path, span_coverage, verify_external)}


def windows_sql(name: str, source: str, key: str, column: str) -> str:
    """Windows and metrics in SQL: `name` has key, window_index, byte_start, byte_end, entropy, coherence, stability, hazard, signature."""
    return f"""{name}_b AS (SELECT {key}, encode({column}) b, octet_length(encode({column})) n FROM {source} WHERE {column} <> ''),
{name}_s AS (SELECT {key}, b, n, unnest(list_distinct(list_concat(generate_series(0, greatest(n - 96, 0), 48), [greatest(n - 96, 0)]))) byte_start FROM {name}_b),
{name}_w AS (SELECT {key}, byte_start, least(byte_start + 96, n) byte_end, row_number() OVER (PARTITION BY {key} ORDER BY byte_start) - 1 window_index, substr(CAST(CAST(b AS BIT) AS VARCHAR), CAST(8 * byte_start + 1 AS BIGINT), CAST(8 * (least(byte_start + 96, n) - byte_start) AS BIGINT)) t FROM {name}_s),
{name}_m AS (SELECT *, length(replace(t, '0', '')) / length(t) p, (len(string_split(t, '01')) + len(string_split(t, '10')) - 2) / (length(t) - 1) hazard FROM {name}_w),
{name}_e AS (SELECT *, CASE WHEN p IN (0, 1) THEN 0 ELSE least(1.0, -(p * log2(p) + (1 - p) * log2(1 - p))) END entropy FROM {name}_m),
{name} AS (SELECT {key}, CAST(window_index AS INTEGER) window_index, CAST(byte_start AS INTEGER) byte_start, CAST(byte_end AS INTEGER) byte_end, entropy, 1 - entropy coherence, 1 - hazard stability, hazard,
  'c' || CAST(round(1 - entropy, 2) AS VARCHAR) || '_s' || CAST(round(1 - hazard, 2) AS VARCHAR) || '_e' || CAST(round(entropy, 2) AS VARCHAR) signature FROM {name}_e)"""


_W = f"WITH {CORPUS_SQL}, {windows_sql('w', 'docs', 'path', 'content')}"
_INDEX = "idx AS (SELECT signature, count(*) occurrences, round(min(hazard), 6) hazard_min, round(max(hazard), 6) hazard_max, round(avg(hazard), 6) hazard_mean, min((path, window_index)) f FROM w GROUP BY ALL)"
_LIMIT = "lim AS (SELECT round(list_sort(list(hazard))[CAST(floor(0.8 * (count(*) - 1)) AS BIGINT) + 1], 6) threshold, count(*) n_windows FROM w)"
_LINED = f"""WITH {CORPUS_SQL}, l AS (SELECT path, source_type, unnest(string_split(c, chr(10))) raw, unnest(generate_series(1, len(string_split(c, chr(10))))) line FROM (SELECT path, source_type, regexp_replace(content, '\\n$', '') c FROM docs)),
i AS (SELECT *, sum(CASE WHEN trim(raw) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) island FROM l),
s AS (SELECT path, min(line) line_number, string_agg(CASE WHEN source_type IN ('code', 'test') THEN rtrim(raw) ELSE trim(raw) END, chr(10) ORDER BY line) text FROM i WHERE trim(raw) <> '' GROUP BY path, island)"""
ORACLE_SQL = {
    "span_segmentation": f"{_LINED} SELECT path, CAST(line_number AS INTEGER) line_number, sha256(path || ':' || line_number || ':' || text) span_id, CAST(length(text) AS INTEGER) n_chars FROM s",
    "span_occurrences": f"WITH {CORPUS_SQL}, l AS (SELECT lower(trim(regexp_replace(unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))), '\\s+', ' ', 'g'))) norm FROM docs) SELECT md5(norm) text_md5, count(*) occurrences FROM l WHERE norm <> '' GROUP BY norm HAVING count(*) > 1",
    "sliding_windows": f"""{_W}, ch AS (SELECT path, unnest(regexp_extract_all(content, '(?s).')) c, unnest(generate_series(1, length(content))) i FROM docs WHERE strlen(content) > length(content)),
        cu AS MATERIALIZED (SELECT path, i, sum(strlen(c)) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) - strlen(c) first FROM ch), ascii AS (SELECT path FROM docs WHERE strlen(content) = length(content))
        SELECT path, window_index, byte_start, byte_end, byte_start char_start, byte_end char_end FROM w JOIN ascii USING (path)
        UNION ALL SELECT w.path, window_index, byte_start, byte_end, CAST(coalesce(a.i, 0) AS INTEGER), CAST(b.i AS INTEGER) FROM (SELECT * FROM w ANTI JOIN ascii USING (path)) w ASOF LEFT JOIN cu a ON a.path = w.path AND w.byte_start > a.first ASOF JOIN cu b ON b.path = w.path AND w.byte_end > b.first""",
    "window_metrics": f"{_W} SELECT path, window_index, round(entropy, 6) entropy, round(coherence, 6) coherence, round(stability, 6) stability, round(hazard, 6) hazard, signature FROM w",
    "span_metrics": f"{_W} SELECT path, coalesce(round(avg(coherence), 6), 0) coherence, coalesce(round(avg(stability), 6), 0) stability, coalesce(round(avg(entropy), 6), 1) entropy, coalesce(round(avg(hazard), 6), 1) hazard, arg_min(signature, window_index) signature, count(window_index) n_windows FROM docs LEFT JOIN w USING (path) GROUP BY path",
    "signature_index": f"{_W}, {_INDEX} SELECT signature, occurrences, hazard_min, hazard_max, hazard_mean, f[1] prototype, f[2] prototype_window FROM idx",
    "hazard_threshold": f"{_W}, {_LIMIT} SELECT * FROM lim",
    "hazard_by_path": f"""{_W}, t AS (SELECT path, list_sort(list(hazard))[CAST(floor(0.8 * (count(*) - 1)) AS BIGINT) + 1] h, count(*) n_windows FROM w GROUP BY path)
        SELECT path, round(any_value(h), 6) threshold, count(*) FILTER (WHERE hazard <= h) n_calm, any_value(n_windows) n_windows FROM t JOIN w USING (path) GROUP BY path""",
    "span_coverage": f"{_W}, {_LIMIT} SELECT path, round(avg(CASE WHEN round(hazard, 6) <= threshold THEN 1.0 ELSE 0.0 END), 6) coverage, count(*) n_windows FROM w, (SELECT threshold FROM lim) GROUP BY path",
    "verify_external": f"""{_W}, {_LIMIT}, {_INDEX}, reqs AS (SELECT item_id request_id, coalesce(text, '') query FROM benchmark), {windows_sql('q', 'reqs', 'request_id', 'query')}
        SELECT request_id, n_windows, match_ratio, coverage, coverage >= 0.5 verified FROM (SELECT request_id, count(*) n_windows, round(avg(CASE WHEN occurrences IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) match_ratio,
        round(avg(CASE WHEN hazard_min <= greatest((SELECT threshold FROM lim), 0.75) THEN 1.0 ELSE 0.0 END), 6) coverage FROM q LEFT JOIN idx USING (signature) GROUP BY request_id)""",
}
