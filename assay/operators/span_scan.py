"""Exact best spans of planned queries by one reading of the corpus, and what is counted over all its spans: no span or index is written.

The queries are few (a written table whose rows and size have been looked at) and go to all tasks; texts stay where they lie. A task cuts its texts into spans and takes them in
blocks of `BLOCK_SPANS`: a block's 3-grams and tokens that a query has are rows of bits, a query's shared 3-grams the sum of its rows. Queries whose k-th score a block's spans cannot
reach by their cosine (an exact bound) are left out. A sixteenth of the documents goes first, in few tasks, and its k-th scores prune the others.

`facts` are counted once: how often each hazard and each normalized text (64 bits of its MD5; they order ties only) occurs, partly summed.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.operators import fusion, lexical, span_search, spans
from assay.operators.span_search import BUCKETS, _counts, _vectors
from assay.sources.shared import written
from assay.sources.tables import sized

BLOCK_SPANS = 256
#: Queries that a task has at most, some 20 MB for each `span_search.TASK_QUERIES` of them; more are for the index.
MOST_QUERIES = 4096
#: One document in so many goes first.
FIRST = 16
#: Distinct facts that a task gathers before it hands them on, and cells of the table from three characters to a 3-gram's number.
FACTS = 200_000
TABLE_CELLS = 1 << 22


def cut(path: str | None, source_type: str | None, content: str) -> list[tuple[int, int, str]]:
    """kind (0 for the summary), line_number and text of a document's spans, as `hybrid.span_table` has them."""
    out, now, head, at, first, code = [], [], [], 0, 0, source_type in ("code", "test")
    for i, raw in enumerate(content.splitlines(), 1):
        t = raw.strip(" ")
        if t:
            if len(head) < 8:
                first = first or i
                head.append(t)
            if not now:
                at = i
            now.append(raw.rstrip(" ") if code else t)
        elif now:
            out.append((1, at, "\n".join(now)))
            now = []
    if now:
        out.append((1, at, "\n".join(now)))
    if head:
        out.append((0, first, "\n".join([x for x in (path, source_type) if x is not None] + ["\n".join(head)])))
    return out


def normal(s: str) -> str:
    return lexical.collapsed(s).lower()


def norm(s: str) -> int:
    return int.from_bytes(hashlib.md5(normal(s).encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for row in zip(*b.columns, strict=True):
            yield tuple(x.as_py() for x in row)


def facts(corpus: DataFrame) -> DataFrame:
    """Counts n, partly summed: of hazard (windows of spans), and of norm with whether the span is a summary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hazards, norms, texts, size = Counter(), Counter(), [], 0

        def measure():
            for _, _, at, raw in spans._slices(pa.array(texts, pa.string())):
                values, n = np.unique(spans._cut(at, raw, spans.fixed.WINDOW_BYTES, spans.fixed.STRIDE_BYTES)[4], return_counts=True)
                for v, c in zip(values.tolist(), n.tolist(), strict=True):
                    hazards[v] += c
            texts.clear()

        def out():
            rows = [*((v, None, None, n) for v, n in hazards.items()), *((None, v, s, n) for (v, s), n in norms.items())]
            hazards.clear()
            norms.clear()
            kinds = (pa.float64(), pa.int64(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["hazard", "norm", "summary", "n"])

        for path, kind, content in _rows(batches):
            for k, _, s in cut(path, kind, content):
                norms[norm(s), k == 0] += 1
                texts.append(s)
                size += len(s)
            if size > spans.SLICE_BYTES:
                measure()
                size = 0
            if len(norms) + len(hazards) > FACTS:
                yield out()
        measure()
        if hazards or norms:
            yield out()

    return corpus.select("path", "source_type", "content").mapInArrow(count, "hazard double, norm long, summary boolean, n long")


def threshold(found: DataFrame) -> float:
    """The hazard threshold over all spans, from written facts."""
    return spans.hazard_threshold(found.where("hazard IS NOT NULL"), n=F.sum("n")).first().threshold or 0.0


def single(found: DataFrame) -> bool:
    """Whether no summary's normalized text occurs a second time, as it holds the path."""
    norms = found.where("norm IS NOT NULL").groupBy("norm").agg(F.sum("n").alias("n"), F.bool_or("summary").alias("summary"))
    return norms.where("summary AND n > 1").isEmpty()


class _Known(dict):
    """Of each word as it stands: its bucket, and above that the number of the query token that it is (from 1); -1 of what is no token."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= span_search.KNOWN_TOKENS:
            self.clear()
        t = word.lower()
        got = self[word] = -1 if len(t) < 2 or t in span_search._STOP else hashlib.md5(t.encode()).digest()[0] | (self.vocabulary.get(t, -1) + 1) << 8
        return got


class Asked:
    """Planned queries, and the best spans found for each: (-final, -cosine, -structural, norm, path, line, kind), sorted."""

    def __init__(self, rows: list[tuple], most: int, alone: bool):
        self.rows, self.most, self.alone, n = rows, most, alone, len(rows)
        words = [span_search.tokens(r[2]) for r in rows]
        by_word: dict[str, list[int]] = {}
        for q, w in enumerate(words):
            for t in set(w):
                by_word.setdefault(t, []).append(q)
        self.vocabulary = {t: i for i, t in enumerate(by_word)}
        self.known = _Known(self.vocabulary)
        self.tokens = [np.array(sorted({self.vocabulary[t] for t in w}), np.int64) for w in words]
        self.weights = _vectors(_counts([[hashlib.md5(t.encode()).digest()[0] for t in w] for w in words])) if n else np.zeros((0, BUCKETS))
        held = [span_search.grams(r[2]) if r[2].strip() else np.empty(0, np.int64) for r in rows]
        self.gram_vocabulary = np.unique(np.concatenate(held)) if n else np.empty(0, np.int64)
        self.grams = [np.searchsorted(self.gram_vocabulary, g) for g in held]
        self.sizes = np.array([max(1, len(g)) for g in held], np.float64)
        mask = (1 << 21) - 1
        letters = np.unique(np.concatenate([self.gram_vocabulary >> 42, self.gram_vocabulary >> 21 & mask, self.gram_vocabulary & mask]))
        self.base, self.table = len(letters) + 1, None
        if self.base**3 <= TABLE_CELLS:
            self.letters = np.zeros(0x110000, np.int32)
            self.letters[letters] = np.arange(1, self.base)
            self.table = np.full(self.base**3, -1, np.int32)
            at = self.letters[self.gram_vocabulary >> 42], self.letters[self.gram_vocabulary >> 21 & mask], self.letters[self.gram_vocabulary & mask]
            self.table[(at[0] * self.base + at[1]) * self.base + at[2]] = np.arange(len(self.gram_vocabulary))
        # met: a span shares a token with the query; until one does, all are candidates
        self.met, self.given = np.zeros(n, bool), np.array([-1.0 if r[3] is None else r[3] for r in rows])
        self.met |= self.given >= 0
        self.floor = self.given.copy()
        self.best: list[list[tuple]] = [[] for _ in rows]
        self.automaton = ahocorasick.Automaton()
        for t, qs in by_word.items():
            self.automaton.add_word(t, np.array(qs))
        if by_word:
            self.automaton.make_automaton()

    def named(self, path: str | None) -> np.ndarray:
        """The queries one of whose tokens stands in a path."""
        got = np.zeros(len(self.rows), bool)
        if path and len(self.automaton):
            for _, qs in self.automaton.iter(path.lower()):
                got[qs] = True
        return got

    def gram_numbers(self, points: np.ndarray) -> np.ndarray:
        """Which of the queries' 3-grams begins at each code point but the last two; -1: none."""
        if self.table is not None:
            p = self.letters[points]
            return self.table[(p[:-2] * self.base + p[1:-1]) * self.base + p[2:]]
        p = points.astype(np.int64)
        g = p[:-2] << 42 | p[1:-1] << 21 | p[2:]
        if not len(self.gram_vocabulary):
            return np.full(len(g), -1)
        at = np.minimum(np.searchsorted(self.gram_vocabulary, g), len(self.gram_vocabulary) - 1)
        return np.where(self.gram_vocabulary[at] == g, at, -1)

    def visit(self, block: list[tuple]) -> None:
        """Scores spans: (path, source_type, the queries that the path names, kind, line, text)."""
        n, texts = len(block), [" ".join([x for x in (b[0], b[1], b[5]) if x is not None]) for b in block]
        flat: list[int] = []
        ends, find, get = [], span_search._TOKEN.findall, self.known.__getitem__
        for s in texts:
            flat.extend(map(get, find(s)))
            ends.append(len(flat))
        code, of = np.array(flat, np.int64), np.repeat(np.arange(n), np.diff(ends, prepend=0))
        code, of = code[code >= 0], of[code >= 0]
        weights = _vectors(np.bincount(of * BUCKETS + (code & 255), minlength=n * BUCKETS).reshape(n, BUCKETS))
        held = code >= BUCKETS
        tokens = np.zeros((len(self.vocabulary), n), bool)
        tokens[(code[held] >> 8) - 1, of[held]] = True
        padded = [f" {normal(s)} " for s in texts]
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(p) for p in padded])
        whole = np.ones(len(points), bool)  # 3-grams that lie in one span
        end = np.cumsum(size)
        whole[end - 1] = whole[end - 2] = False
        number, owner = self.gram_numbers(points), np.repeat(np.arange(n), size)[:-2]
        hit = whole[:-2] & (number >= 0)
        grams = np.zeros((len(self.gram_vocabulary), n), np.uint8)
        grams[number[hit], owner[hit]] = 1
        # by query and span: what a score has without its 3-grams, which add 0.45 at most; 4e-6 for all that is rounded
        dots, bonus = self.weights @ weights.T, np.stack([b[2] for b in block], 1)
        part = 0.47 * dots + 0.08 * bonus + 4e-6
        places: dict[int, tuple] = {}

        def place(i: int) -> tuple:
            if i not in places:
                path, _, _, kind, line, text = block[i]
                places[i] = 0 if self.alone and kind == 0 else norm(text), path or "", line, kind
            return places[i]

        can = np.flatnonzero((part.max(1) + 0.45 >= self.floor) | ~self.met)
        shared = np.zeros((len(can), n), np.uint32)
        for i, q in enumerate(can.tolist()):
            for a in range(0, len(self.grams[q]), 255):
                shared[i] += np.add.reduce(grams.take(self.grams[q][a : a + 255], 0), 0, dtype=np.uint8)
        most = 0.45 * shared / self.sizes[can, None] + part[can]
        good = most >= self.floor[can, None]
        for i in np.flatnonzero(good.any(1) | ~self.met[can]).tolist():
            q, rows = can[i], np.flatnonzero(good[i])
            if not self.met[q] and (near := tokens[self.tokens[q]].any(0)).any():
                self.met[q], self.best[q], self.floor[q] = True, [], self.given[q]
                rows = np.flatnonzero(near & (most[i] >= self.floor[q]))
            elif self.met[q]:
                rows = rows[tokens[self.tokens[q][:, None], rows].any(0)]
            if not len(rows):
                continue
            structural, cosine = np.round(shared[i, rows] / self.sizes[q], 6), np.round(np.clip(dots[q, rows], 0, 1), 6)
            final = np.round(np.minimum(1.0, 0.45 * structural + 0.47 * cosine + 0.08 * bonus[q, rows]) + fusion.TIE, 6)
            at = np.flatnonzero((final > 0) & (final >= self.floor[q]))
            if len(at) > self.most:
                at = at[final[at] >= np.partition(final[at], -self.most)[-self.most]]
            if len(at):
                self._keep(q, [(-float(final[k]), -float(cosine[k]), -float(structural[k]), *place(int(rows[k]))) for k in at.tolist()])

    def _keep(self, q: int, new: list[tuple]) -> None:
        """The best spans by score with all their ties, as occurrences order those; spans of one norm occur equally often, so most of them are enough."""
        best = sorted(self.best[q] + new)
        if len(best) > self.most:
            kth, seen, kept = best[self.most - 1][:3], Counter(), []
            for i, x in enumerate(best):
                if i >= self.most and x[:3] != kth:
                    break
                seen[x[:4]] += 1
                if seen[x[:4]] <= self.most:
                    kept.append(x)
            best = kept
        self.best[q] = best
        if len(best) >= self.most:
            self.floor[q] = max(self.floor[q], -best[self.most - 1][0])


_FOUND = "request_id long, plan int, path string, kind int, line_number int, norm long, structural double, cosine double, final double, near boolean"


def _scan(corpus: DataFrame, rows: list[tuple], most: int, alone: bool) -> DataFrame:
    """Each task's best spans of the queries (request_id, plan, query, floor); a row without path says that a query has met one of its tokens."""
    shared = corpus.sparkSession.sparkContext.broadcast(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [Asked(shared.value[a : a + span_search.TASK_QUERIES], most, alone) for a in range(0, len(shared.value), span_search.TASK_QUERIES)]
        block: list[tuple] = []

        def visit():
            for k, q in enumerate(asked):
                q.visit([(p, t, named[k], *s) for p, t, named, *s in block])
            block.clear()

        for path, kind, content in _rows(batches):
            found = cut(path, kind, content)
            named = [q.named(path) for q in asked] if found else []
            for s in found:
                block.append((path, kind, named, *s))
                if len(block) == BLOCK_SPANS:
                    visit()
        if block:
            visit()
        for q in asked:
            out = []
            for (request, plan, *_), best, met in zip(q.rows, q.best, q.met.tolist(), strict=True):
                out += [(request, plan, x[4], x[6], x[5], None if alone and x[6] == 0 else x[3], -x[2], -x[1], -x[0], met) for x in best] or ([(request, plan, *[None] * 7, True)] if met else [])
            if out:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return corpus.select("path", "source_type", "content").mapInArrow(scan, _FOUND)


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, source, content in _rows(batches):
        if out := [(path, source, *s) for s in cut(path, source, content)]:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "source_type", "kind", "line_number", "text"])


def best(corpus: DataFrame, found: DataFrame, planned: DataFrame, most: int) -> DataFrame:
    """request_id, plan, structural, cosine, final, rank and the span's columns, as `span_search.best` has them over all spans of a corpus of distinct paths.

    found: the corpus's written facts; planned: few queries.
    """
    key, scores = ["request_id", "plan"], ["final", "cosine", "structural"]
    # equal queries are searched once, under their number
    numbers: dict[str, int] = {}
    named = [(numbers.setdefault(q, len(numbers)), r, p) for r, p, q in planned.where("trim(query) <> ''").select(*key, "query").collect()]
    asked = [(i, 0, q, None) for q, i in numbers.items()]
    alone, first = single(found), F.pmod(F.xxhash64("path"), F.lit(FIRST)) == 0
    n = corpus.sparkSession.sparkContext.defaultParallelism
    part = written(_scan(corpus.where(first).coalesce(n), asked, most, alone), "found")
    near = lambda rows: rows.where("near AND path IS NOT NULL").select(*key, "final", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("final"))).alias("n"))
    floors = {(r[0], r[1]): r[2] for r in near(part).where(F.col("n") == most).select(*key, "final").collect()}
    rest = written(_scan(corpus.where(~first), [(r, p, q, floors.get((r, p))) for r, p, q, _ in asked], most, alone), "found")
    every = part.unionByName(rest)
    # a query that meets no span by a token has all spans as candidates
    every = every.withColumn("met", F.bool_or("near").over(Window.partitionBy(*key))).where("near = met AND path IS NOT NULL").drop("near", "met")
    by_score = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in scores])
    tied = written(every.withColumn("nth", F.rank().over(by_score)).where(F.col("nth") <= most).drop("nth"), "tied")
    norms = sized(written(tied.where("norm IS NOT NULL").select("norm").distinct(), "norms"))
    counts = written(found.where("norm IS NOT NULL").join(norms, "norm", "left_semi").groupBy("norm").agg(F.sum("n").cast("int").alias("occurrences")), "occurrences")
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in scores], F.desc("occurrences"), "path", "line_number", "kind")
    ranked = tied.join(sized(counts), "norm", "left").na.fill(1, ["occurrences"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("norm")
    ranked = written(ranked, "ranked")
    where = sized(written(ranked.select("path", "kind", "line_number").distinct(), "where"))
    texts = corpus.join(sized(written(ranked.select("path").distinct(), "paths")), "path", "left_semi").select("path", "source_type", "content").mapInArrow(_cut_rows, "path string, source_type string, kind int, line_number int, text string")
    texts = written(spans.with_hazards(texts.join(where, ["path", "kind", "line_number"], "left_semi"), "text"), "texts")
    out = spans.calmed(texts, threshold(found)).withColumn("span", F.concat_ws("#", "path", "kind", "line_number"))
    names = F.broadcast(corpus.sparkSession.createDataFrame(named, "number long, request_id long, plan int"))
    ranked = ranked.drop("plan").withColumnRenamed("request_id", "number").join(names, "number").drop("number")
    return ranked.hint("merge").join(out, ["path", "kind", "line_number"])
