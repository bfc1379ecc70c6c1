"""Lexical ranking: postings, document frequencies and scores of many requests at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions import fixed, text
from assay.sources.shared import written
from assay.sources.tables import sized, small, tasks

_WORD = re.compile(rb"[a-z0-9_]{2,}")
_STOP = frozenset(w.encode() for w in fixed.STOP_WORDS)
#: Rows that a task gathers before it hands them on.
ROWS = 100_000
#: Characters of texts that a task cuts into tokens, and pairs of request and document that it scores.
PART_CHARS = 8_000_000
PART_PAIRS = 1_000_000
#: Documents that a task scores together.
BLOCK_DOCUMENTS = 256


def query_tokens(requests: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """The keys, token and query_tf."""
    return text.token_rows(requests, F.col("query"), *keys).groupBy(*keys, "token").agg(F.count("*").alias("query_tf"))


def collapsed(s: str) -> str:
    """`text.collapsed` of a text: bytes are split at the six white characters that the pattern has, many times faster than by the pattern."""
    return b" ".join(s.encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass")


def _words(s: str | None) -> Counter:
    """How often a text has each token (see `text.token_rows`)."""
    return Counter(_WORD.findall((s or "").encode("utf-8", "surrogatepass").lower()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each path, from rows in order of path."""
    paths: list[str | None] = []
    n: list[int] = []
    tokens: list[bytes] = []
    tf: list[int] = []
    path_tf: list[int] = []
    now, content = None, Counter()

    def end():
        path = _words(now)
        mine = [t for t in content.keys() | path.keys() if t not in _STOP]
        paths.append(now)
        n.append(len(mine))
        tokens.extend(mine)
        tf.extend([content[t] for t in mine])
        path_tf.extend([path[t] for t in mine])

    def out():
        made = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()), pa.array(path_tf, pa.int64())], ["path", "token", "tf", "path_tf"])
        for x in (paths, n, tokens, tf, path_tf):
            x.clear()
        return made

    first = True
    for b in batches:
        for path, body in zip(*b.columns, strict=True):
            path = path.as_py()
            if not first and path == now:
                content.update(_words(body.as_py()))
                continue
            if not first:
                end()
            now, content, first = path, _words(body.as_py()), False
            if len(tokens) > ROWS:
                yield out()
    if not first:
        end()
    if tokens:
        yield out()


def postings(corpus: DataFrame) -> DataFrame:
    """path, token, tf (in the content) and path_tf (in the path).

    Texts are dealt by path into parts of `PART_CHARS` and counted where they lie: a task does not grow with the corpus, and no token is shuffled.
    """
    n = tasks(corpus, (corpus.agg(F.sum(F.length("content"))).first()[0] or 0) / PART_CHARS)
    return corpus.select("path", "content").repartition(n, "path").sortWithinPartitions("path").mapInArrow(_counted, "path string, token string, tf long, path_tf long")


def document_frequency(post: DataFrame) -> DataFrame:
    """token and df: documents whose content has it; a token of paths alone has df 0."""
    return post.groupBy("token").agg(F.count_if(F.col("tf") > 0).alias("df"))


def word_counts(corpus: DataFrame) -> DataFrame:
    """token and n, partly summed: documents of a corpus of distinct paths whose content has it. Texts stay where they lie, and no postings are made."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])
            found.clear()
            return made

        for b in batches:
            for body in b.column(0):
                found.update(set(_WORD.findall((body.as_py() or "").encode("utf-8", "surrogatepass").lower())) - _STOP)
                if len(found) > ROWS:
                    yield out()
        if found:
            yield out()

    return corpus.select("content").mapInArrow(count, "token string, n long")


def idf(df, n):
    return F.log((n + 1) / (1 + df)) + 1.0


def scores(post: DataFrame, n_documents: int, requests: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """The keys, path and score of every document that shares a token with a request; post: the written postings.

    The requests' vocabulary prunes the postings; it is broadcast only when it is small. Postings are then dealt by path, so that all of a document's scores come about in one task:
    with `PART_PAIRS` pairs of request and document in a task at most, its memory does not grow with the corpus, and `top` sends its best few only.
    """
    q = written(query_tokens(requests, keys), "query-tokens")
    vocabulary = sized(written(q.select("token").distinct(), "vocabulary"))
    df = written(document_frequency(post.join(vocabulary, "token", "left_semi")), "frequencies")
    weighted = written(q.hint("merge").join(df, "token", "left").withColumn("idf", idf(F.coalesce("df", F.lit(0)), F.lit(n_documents))), "weights")
    most = weighted.groupBy(*keys).agg(F.sum(F.col("idf") * F.col("query_tf")).alias("most"), F.count("*").alias("n_tokens"))
    wanted = written(weighted.hint("merge").join(most, list(keys)), "wanted")
    n = tasks(post, most.count() * n_documents / PART_PAIRS)
    if small(wanted):
        hits = post.join(vocabulary, "token", "left_semi").repartition(n, "path").join(F.broadcast(wanted), "token")
    else:
        hits = post.hint("merge").join(wanted, "token").repartition(n, "path")
    overlap = F.least("query_tf", F.greatest("tf", "path_tf")) * F.col("idf")
    grouped = hits.groupBy(*keys, "path").agg(F.sum(overlap).alias("overlap"), F.count("*").alias("matched"), F.max("most").alias("most"), F.max("n_tokens").alias("n_tokens"))
    score = F.least(F.lit(1.0), 0.6 * F.col("matched") / F.col("n_tokens") + 0.4 * F.least(F.lit(1.0), F.col("overlap") / F.col("most")))
    return grouped.where("overlap > 0").select(*keys, "path", F.round(score, 6).alias("score"))


def top(scored: DataFrame, k: int, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scanned(corpus: DataFrame, counts: DataFrame, n_documents: int, requests: DataFrame, k: int, keys: tuple[str, ...] = ("request_id",)) -> DataFrame | None:
    """`top` of `scores` by one reading of a corpus of distinct paths, without postings; none if the requests' words are too many for every task to have them.

    counts: the corpus's written `word_counts`. Texts stay where they lie, and a task sends its best few of each request.
    """
    spark, q = corpus.sparkSession, written(query_tokens(requests, keys), "query-tokens")
    if not small(q):
        return None
    df = counts.join(F.broadcast(q.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("df"))
    rows = q.join(df.hint("merge"), "token", "left").select(*keys, "token", "query_tf", idf(F.coalesce("df", F.lit(0)), F.lit(n_documents)).alias("idf")).collect()
    by_key: dict[tuple, list[tuple]] = {}
    for *key, token, tf, weight in rows:
        by_key.setdefault(tuple(key), []).append((token.encode(), tf, weight))
    shared, types = spark.sparkContext.broadcast(by_key), [q.schema[c] for c in keys]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in types), "path string", "score double"])
    kinds = [*(pa.int32() if f.dataType.simpleString() == "int" else pa.int64() for f in types), pa.string(), pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[bytes, int] = {}
        asked = []
        for words in shared.value.values():
            at = np.array([vocabulary.setdefault(w, len(vocabulary)) for w, _, _ in words])
            tf, weight = np.array([x[1] for x in words], np.int64), np.array([x[2] for x in words])
            again = np.flatnonzero(tf > 1)  # words that a request has once count where they stand; the others as often as in both
            asked.append((at, np.stack([weight, np.ones(len(words))]), at[again], (tf[again] - 1)[:, None], weight[again], float((weight * tf).sum()), len(words)))
        best: list[list[tuple]] = [[] for _ in asked]
        floor = [0.0] * len(asked)
        block: list[tuple[str, str]] = []

        def held(texts: list[str | None]) -> np.ndarray:
            flat: list[int] = []
            ends = []
            for s in texts:
                flat.extend([c for c in map(vocabulary.get, _WORD.findall((s or "").encode("utf-8", "surrogatepass").lower())) if c is not None])
                ends.append(len(flat))
            of, n = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0)), len(texts)
            return np.bincount(np.array(flat, np.int64) * n + of, minlength=len(vocabulary) * n).reshape(-1, n)

        def visit():
            tf = np.maximum(held([x[1] for x in block]), held([x[0] for x in block]))
            here, more = (tf > 0).astype(np.float64), np.maximum(tf - 1, 0)
            for i, (at, sums, again, query_tf, weight, most, n) in enumerate(asked):
                overlap, matched = sums @ here.take(at, 0)
                if len(again):
                    overlap += weight @ np.minimum(query_tf, more.take(again, 0))
                raw = np.minimum(1.0, 0.6 * matched / n + 0.4 * np.minimum(1.0, overlap / most))
                if raw.max() < floor[i] - 2e-6:
                    continue
                score = np.floor(raw * 1e6 + 0.5) / 1e6
                good = np.flatnonzero((overlap > 0) & (score >= floor[i]))
                if len(good):
                    new = best[i] = sorted(best[i] + [(-score[j], block[j][0]) for j in good.tolist()])[:k]
                    if len(new) == k:
                        floor[i] = -new[-1][0]
            block.clear()

        for b in batches:
            for path, body in zip(*b.columns, strict=True):
                block.append((path.as_py(), body.as_py()))
                if len(block) == BLOCK_DOCUMENTS:
                    visit()
        if block:
            visit()
        out = [(*key, path, -score) for key, found in zip(shared.value, best, strict=True) for score, path in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*keys, "path", "score"])

    return top(corpus.select("path", "content").mapInArrow(scan, schema), k, keys)


def baseline(ranked: DataFrame, least: float = 0.32) -> DataFrame:
    """Per request: the mean of the first three scores, how many of the first five reach the limit, and whether both suffice."""
    first = F.avg(F.when(F.col("rank") <= 3, F.col("score")))
    return ranked.groupBy("request_id").agg(F.round(first, 6).alias("support"), F.count_if((F.col("rank") <= 5) & (F.col("score") >= least)).alias("n_strong")).withColumn(
        "decision", F.when((F.col("support") >= least) & (F.col("n_strong") >= 2), "admit").otherwise("abstain")
    )


def best_lines(corpus: DataFrame, requests: DataFrame, hits: DataFrame, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """For each hit the line with the most of the request's tokens as substrings; the first such line, 240 characters of it.

    Only the lines of documents that are hits are cut, and a document's lines travel once for all its hits.
    """
    hits = written(hits.select(*keys, "path").distinct(), "hits")
    q = written(query_tokens(requests, keys).groupBy(*keys).agg(F.collect_set("token").alias("tokens")), "tokens")
    if small(hits) and small(q):
        return _scanned_lines(corpus, q, hits, keys)
    found = corpus.select("path", "content").join(sized(hits), "path").join(sized(q), list(keys))
    rows = found.select(*keys, "path", "tokens", F.posexplode(text.lines(F.col("content"))).alias("line", "text")).withColumn("clean", text.collapsed(F.col("text"))).where("clean <> ''")
    n = F.size(F.filter("tokens", lambda t: F.contains(F.lower("clean"), t)))
    best = rows.groupBy(*keys, "path").agg(F.max_by(F.struct("line", "clean"), F.struct(n.alias("n"), (-F.col("line")).alias("l"))).alias("b"))
    return best.select(*keys, "path", (F.col("b.line") + 1).alias("line_number"), F.left("b.clean", F.lit(240)).alias("snippet"))


def _scanned_lines(corpus: DataFrame, queries: DataFrame, hits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """`best_lines` of few hits and queries (written tables), which every task has: a document's lines are searched once for the words of all its hits."""
    tokens = {tuple(r[:-1]): [t.encode() for t in r[-1]] for r in queries.select(*keys, "tokens").collect()}
    wanted: dict[str, list[tuple]] = {}
    for *key, path in hits.select(*keys, "path").collect():
        if tuple(key) in tokens:
            wanted.setdefault(path, []).append(tuple(key))
    shared, types = corpus.sparkSession.sparkContext.broadcast((tokens, wanted)), [hits.schema[c] for c in keys]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in types), "path string", "n int", "line_number int", "snippet string"])
    kinds = [*(pa.int32() if f.dataType.simpleString() == "int" else pa.int64() for f in types), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, wanted = shared.value
        for b in batches:
            out = []
            for path, body in zip(*b.columns, strict=True):
                path = path.as_py()
                asked = wanted.get(path, ())
                lines = [(i, s) for i, s in enumerate(map(collapsed, (body.as_py() or "").splitlines()), 1) if s] if asked else []
                if not lines:
                    continue
                words = {t: k for k, t in enumerate(dict.fromkeys(t for key in asked for t in tokens[key]))}
                names = ahocorasick.Automaton()
                for t, k in words.items():
                    names.add_word(t.decode(), k)
                names.make_automaton()
                held = np.zeros((len(words), len(lines)), bool)
                for at, (_, s) in enumerate(lines):
                    held[[k for _, k in names.iter(s.lower())], at] = True
                for key in asked:
                    n = held[[words[t] for t in tokens[key]]].sum(0)
                    i, s = lines[int(n.argmax())]  # the first of the best
                    out.append((*key, path, int(n.max()), i, s[:240]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*keys, "path", "n", "line_number", "snippet"])

    paths = F.broadcast(hits.select("path").distinct())
    found = corpus.select("path", "content").join(paths, "path", "left_semi").mapInArrow(search, schema)
    best = found.groupBy(*keys, "path").agg(F.max_by(F.struct("line_number", "snippet"), F.struct("n", -F.col("line_number"))).alias("b"))
    return best.select(*keys, "path", "b.line_number", "b.snippet")
