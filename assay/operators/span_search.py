"""Exact best spans of many planned queries over an index of blocks with score bounds.

Index: spans lie in blocks of `BLOCK_SPANS`, in order of path. A block's row holds, made once, its distinct tokens and 3-grams, and each span's as places
among them, with the token counts of its buckets: some 100 KB a block, which keeps tasks that read, sort and compare blocks small. Opening a block makes the vectors and its bounds:
of each of the 256 buckets the greatest weight that a span has there, and the set of 3-grams that any has. `lists` has a row for each token and block that holds it.

Search: queries meet blocks by a join on tokens; a query none of whose tokens occurs meets all blocks, as every span is its candidate.
Tasks take a group of blocks and the queries that met one of them, as rows; blocks go by falling bound. A query leaves out a block whose bound
(0.45 times the share of its grams that the block has, 0.47 times its vector against the greatest weights, 0.08 for a path that holds a token) is
under its current k-th score, and then single spans by the same bound from their exact cosine. 3-grams are compared for what is left.
Two rounds: the k-th scores of a first share of the groups (the square root of their number) prune the others. Nothing depends on bounds but the work.

Scale: no table of pairs of query and span; a task sends its best few of each query. The plan has two rounds whatever the number of queries or blocks; nothing is
collected or broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions import fixed
from assay.operators import fusion
from assay.sources.shared import written
from assay.sources.tables import small, tasks

BLOCK_SPANS = 256
#: Blocks in a group and queries in a task.
GROUP_BLOCKS = 16
TASK_QUERIES = 512
#: Pairs of query and block that a task brings together.
PART_PAIRS = 1_000_000
#: Bytes of a row group of written blocks (readers hold one at a time), and tokens whose codes a task keeps.
ROW_GROUP = 8_000_000
KNOWN_TOKENS = 200_000
BUCKETS = 256
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_TOKEN = re.compile(r"[A-Za-z0-9_]+")
_STOP = frozenset(fixed.STOP_WORDS)


def tokens(s: str) -> list[str]:
    return [t for t in (x.lower() for x in _TOKEN.findall(s)) if len(t) > 1 and t not in _STOP]


def _codes(token: str, known: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """A token's 64-bit code, and its bucket: the first byte of its MD5."""
    got = known.get(token)
    if got is None:
        if len(known) >= KNOWN_TOKENS:
            known.clear()
        d = hashlib.md5(token.encode()).digest()
        got = known[token] = int.from_bytes(d[8:], "little", signed=True), d[0]
    return got


def grams(s: str) -> np.ndarray:
    """The distinct 3-grams of a text between single spaces, as the numbers that their code points make."""
    points = np.frombuffer(f" {_SPACE.sub(' ', s).strip(' ').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]) if len(points) > 2 else np.array([points[0] << 21 | points[-1]], np.int64)


def _vectors(counts: np.ndarray) -> np.ndarray:
    """Rows of token counts by bucket, of length one."""
    v = counts.astype(np.float64)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, n, out=v, where=n > 0)


def _counts(buckets: list[list[int]]) -> np.ndarray:
    return np.stack([np.bincount(b, minlength=BUCKETS) for b in buckets])


def _ends(parts: list[np.ndarray]) -> bytes:
    return np.cumsum([len(p) for p in parts], dtype=np.int32).tobytes()


def _places(values: np.ndarray, among: np.ndarray) -> bytes:
    return np.searchsorted(among, values).astype(_width(among)).tobytes()


def _width(among: np.ndarray) -> type:
    return np.uint16 if len(among) <= 1 << 16 else np.uint32


_BLOCK = "block long, n int, ids binary, paths array<string>, kinds array<int>, lines array<int>, occurrences array<int>, tokens binary, token_ends binary, token_places binary, grams binary, gram_ends binary, gram_places binary, bucket_ends binary, buckets binary, counts binary"


def blocks(index: DataFrame) -> DataFrame:
    """The blocks of a written index (id, path, kind, line_number, occurrences, search_text), spans in the order in which they come."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_SPANS):
                ids, paths, kinds, lines, occurrences, texts = (c.to_pylist() for c in b.slice(a, BLOCK_SPANS).columns)
                coded = [[_codes(t, known) for t in tokens(s)] for s in texts]
                row = [ids[0], len(ids), np.array(ids, np.int64).tobytes(), paths, kinds, lines, occurrences]
                for held in ([np.unique(np.array([c for c, _ in x], np.int64)) for x in coded], [grams(s) for s in texts]):
                    every = np.concatenate(held)
                    among = np.unique(every)
                    row += [among.tobytes(), _ends(held), _places(every, among)]
                counts = _counts([[c for _, c in x] for x in coded])
                row += [_ends([np.flatnonzero(c) for c in counts]), np.nonzero(counts)[1].astype(np.uint8).tobytes(), counts[counts > 0].astype(np.uint32).tobytes()]
                names = [x.split()[0] for x in _BLOCK.split(", ")]
                kinds_ = {"block": pa.int64(), "n": pa.int32(), "paths": pa.list_(pa.string()), "kinds": pa.list_(pa.int32()), "lines": pa.list_(pa.int32()), "occurrences": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds_.get(name, pa.binary())) for name, v in zip(names, row, strict=True)], names=names)

    return index.select("id", "path", "kind", "line_number", "occurrences", "search_text").mapInArrow(pack, _BLOCK)


def lists(made: DataFrame) -> DataFrame:
    """token (its code) and block, a row for each block that holds the token."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = np.frombuffer(body, np.int64)
                yield pa.RecordBatch.from_pydict({"token": pa.array(t), "block": pa.array(np.full(len(t), block))})

    return made.select("block", "tokens").mapInArrow(spread, "token long, block long")


class Block:
    def __init__(self, row: dict):
        read = lambda name, kind=np.int64: np.frombuffer(row[name], kind)
        self.n, self.ids = row["n"], read("ids")
        self.paths, self.kinds, self.lines, self.occurrences = row["paths"], row["kinds"], row["lines"], row["occurrences"]
        self.token, self.gram = read("tokens"), read("grams")
        self.token_at, self.gram_at = read("token_places", _width(self.token)), read("gram_places", _width(self.gram))
        self.token_of, self.gram_of, of = (np.repeat(np.arange(self.n, dtype=np.int32), np.diff(read(x, np.int32), prepend=0)) for x in ("token_ends", "gram_ends", "bucket_ends"))
        self.gram_count = np.bincount(self.gram_of, minlength=self.n)
        counts = np.zeros((self.n, BUCKETS))
        counts[of, read("buckets", np.uint8)] = read("counts", np.uint32)
        self.weights = _vectors(counts)
        self.peaks = self.weights.max(0)


def _matrix(vocabulary: np.ndarray, values: np.ndarray, of: np.ndarray, n: int, places: np.ndarray | None = None) -> np.ndarray:
    """Which of n rows has which value of a sorted vocabulary; places: the rows' values as places among the values given."""
    out = np.zeros((n, len(vocabulary)), np.float32)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        hit = vocabulary[at] == values
        if places is not None:
            at, hit = at[places], hit[places]
        out[of[hit], at[hit]] = 1
    return out


class Queries:
    """Some planned queries as matrices over their own tokens and 3-grams, and the best spans found for each."""

    def __init__(self, rows: list[dict], most: int):
        self.rows, self.most = rows, most
        words = [tokens(r["query"]) for r in rows]
        known: dict[str, tuple[int, int]] = {}
        coded = [[_codes(t, known) for t in w] for w in words]
        self.weights = _vectors(_counts([[b for _, b in x] for x in coded])).T
        held = [grams(r["query"]) if r["query"].strip() else np.empty(0, np.int64) for r in rows]
        flat = lambda parts: (np.concatenate(parts), np.repeat(np.arange(len(rows)), [len(p) for p in parts]))
        code, of = flat([np.array([c for c, _ in x], np.int64) for x in coded])
        self.vocabulary = np.unique(code)
        self.tokens = _matrix(self.vocabulary, code, of, len(rows)).T
        gram, of = flat(held)
        self.gram_vocabulary = np.unique(gram)
        self.grams = _matrix(self.gram_vocabulary, gram, of, len(rows)).T
        self.sizes = np.maximum(1, self.grams.sum(0)).astype(np.float64)
        self.everywhere = np.array([r["everywhere"] for r in rows])
        self.floor = np.array([-1.0 if r["floor"] is None else r["floor"] for r in rows])
        self.best: list[list[tuple]] = [[] for _ in rows]
        self.names = ahocorasick.Automaton()
        by_word: dict[str, list[int]] = {}
        for q, w in enumerate(words):
            for t in set(w):
                by_word.setdefault(t, []).append(q)
        for t, qs in by_word.items():
            self.names.add_word(t, qs)
        if by_word:
            self.names.make_automaton()
        self.known: dict[str, np.ndarray] = {}
        self.scored = self.offered = 0

    def named(self, path: str) -> np.ndarray:
        """The queries one of whose tokens stands in a path."""
        got = self.known.get(path)
        if got is None:
            got = np.zeros(len(self.rows), bool)
            if len(self.names):
                for _, qs in self.names.iter(path.lower()):
                    got[qs] = True
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[path] = got
        return got

    def bound(self, block: Block) -> np.ndarray:
        share = np.isin(self.gram_vocabulary, block.gram).astype(np.float32) @ self.grams / self.sizes
        bonus = np.any([self.named(p) for p in dict.fromkeys(block.paths)], 0)
        return 0.45 * np.minimum(1, share) + 0.47 * np.minimum(1, block.peaks @ self.weights) + 0.08 * bonus + 3e-6

    def visit(self, block: Block, bound: np.ndarray, asked: np.ndarray) -> None:
        """Scores a block's spans for the queries that asked for the block and may find one there."""
        self.offered += block.n * int(asked.sum())
        q = np.flatnonzero(asked & (bound >= self.floor))
        if not len(q):
            return
        near = (_matrix(self.vocabulary, block.token, block.token_of, block.n, block.token_at) @ self.tokens[:, q] > 0) | self.everywhere[q]
        cosine = np.round(np.clip(block.weights @ self.weights[:, q], 0, 1), 6)
        bonus = np.stack([self.named(p)[q] for p in block.paths])
        most = 0.45 * np.minimum(1, block.gram_count[:, None] / self.sizes[q]) + 0.47 * cosine + 0.08 * bonus + 3e-6
        row, col = np.nonzero(near & (most >= self.floor[q]))
        if not len(row):
            return
        self.scored += len(row)
        some = np.unique(row)
        at = np.searchsorted(some, block.gram_of)
        mine = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == block.gram_of)
        shared = _matrix(self.gram_vocabulary, block.gram, at[mine], len(some), block.gram_at[mine]) @ self.grams[:, q]
        structural = np.round(shared[np.searchsorted(some, row), col].astype(np.float64) / self.sizes[q[col]], 6)
        final = np.round(np.minimum(1.0, 0.45 * structural + 0.47 * cosine[row, col] + 0.08 * bonus[row, col]) + fusion.TIE, 6)
        good = (final > 0) & (final >= self.floor[q[col]])
        row, col, structural, final, cosine = row[good], col[good], structural[good], final[good], cosine[row[good], col[good]]
        for k in np.unique(col):
            new = np.flatnonzero(col == k)
            if len(new) > self.most:
                new = new[final[new] >= np.partition(final[new], -self.most)[-self.most]]
            rows = [(-final[i], -cosine[i], -structural[i], -block.occurrences[row[i]], block.paths[row[i]], block.lines[row[i]], block.kinds[row[i]], int(block.ids[row[i]])) for i in new.tolist()]
            best = self.best[q[k]] = sorted(self.best[q[k]] + rows)[: self.most]
            if len(best) == self.most:
                self.floor[q[k]] = max(self.floor[q[k]], -best[-1][0])


def best(index: DataFrame, made: DataFrame, postings: DataFrame, planned: DataFrame, most: int) -> DataFrame:
    """request_id, plan, structural, cosine, final and the span's columns: the best spans of each planned query, most at most.

    index: the written spans; made and postings: their written blocks and lists. Order: final score, cosine, structural score, occurrences, then path, line and kind.
    """
    columns = ["span", "path", "source_type", "kind", "line_number", "text", "occurrences", "hazard", "coverage", "calm"]
    queries = planned.where("trim(query) <> ''").select("request_id", "plan", "query")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, p, q = (c.to_pylist() for c in b.columns)
            known: dict[str, tuple[int, int]] = {}
            rows = [(x, y, c) for x, y, s in zip(r, p, q, strict=True) for c in {_codes(t, known)[0] for t in tokens(s)}]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["request_id", "plan", "token"])

    key = ["request_id", "plan"]
    words = written(queries.mapInArrow(cut, "request_id long, plan int, token long"), "query-tokens")
    n_queries, n_blocks = queries.count(), made.count()
    groups, chunks = max(1, -(-n_blocks // GROUP_BLOCKS)), max(1, -(-n_queries // TASK_QUERIES))
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group")
    # dealt by group, with so many pairs of query and block in a task at most, whatever the words' frequencies
    n = tasks(made, n_queries * n_blocks / PART_PAIRS)
    if small(words):
        vocabulary = F.broadcast(words.select("token").distinct())
        meet = postings.join(vocabulary, "token", "left_semi").select("token", "block", group).repartition(n, "group").join(F.broadcast(words), "token")
    else:
        meet = postings.hint("merge").join(words, "token").select(*key, "block", group).repartition(n, "group")
    met = meet.select(*key, "group", "block").distinct()
    some = written(met.groupBy(*key, "group").agg(F.collect_list("block").alias("blocks")), "met")  # GROUP_BLOCKS of them, about
    nowhere = queries.select(*key).hint("merge").join(some.select(*key).distinct(), key, "left_anti")
    every = nowhere.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(None).cast("array<long>").alias("blocks"))
    pairs = written(some.unionByName(every).withColumn("chunk", F.pmod(F.xxhash64(*key), F.lit(chunks))), "pairs")
    schema = "request_id long, plan int, id long, structural double, cosine double, final double"
    body = made.withColumn("group", group)

    def search(key, left, right):
        asked = left.to_pylist()
        q, out = Queries(asked, most), []
        wanted: dict[int, list[int]] = {}
        for i, r in enumerate(asked):
            for b in r["blocks"] or ():
                wanted.setdefault(b, []).append(i)
        opened = []
        for r in right.to_pylist():
            mask = q.everywhere.copy()
            mask[wanted.get(r["block"], [])] = True
            if mask.any():
                block = Block(r)
                bound = q.bound(block)
                opened.append((-float(bound[mask].max()), len(opened), block, bound, mask))
        for _, _, block, bound, mask in sorted(opened, key=lambda x: x[:2]):
            q.visit(block, bound, mask)
        for r, found in zip(asked, q.best, strict=True):
            out += [(r["request_id"], r["plan"], x[7], -x[2], -x[1], -x[0]) for x in found]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        cols = zip(*out, strict=True) if out else ((),) * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["request_id", "plan", "id", "structural", "cosine", "final"])

    by_score = Window.partitionBy(*key).orderBy(F.desc("final"))
    first = F.pmod(F.xxhash64("group", F.lit(1)), F.lit(isqrt(groups - 1) + 1)) == 0
    found, asked = None, queries.withColumn("floor", F.lit(None).cast("double"))
    for mine in (first, ~first):
        here = pairs.where(mine)
        left = here.hint("merge").join(asked, key).select(*key, "query", "floor", F.col("blocks").isNull().alias("everywhere"), "blocks", "group", "chunk").groupBy("group", "chunk")
        right = here.select("group", "chunk").distinct().hint("merge").join(body, "group").select(F.col("group").alias("g"), F.col("chunk").alias("c"), *made.columns).groupBy("g", "c")
        new = written(left.cogroup(right).applyInArrow(search, schema), "found")
        found = new if found is None else found.unionByName(new)
        kth = found.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == most).select(*key, F.col("final").alias("floor"))
        asked = queries.hint("merge").join(kth, key, "left")
    tied = written(found.withColumn("nth", F.rank().over(by_score)).where(F.col("nth") <= most).drop("nth"), "tied")
    w = Window.partitionBy(*key).orderBy(F.desc("final"), F.desc("cosine"), F.desc("structural"), F.desc("occurrences"), "path", "line_number", "kind", "id")
    full = tied.hint("merge").join(index.select("id", *columns), "id")
    return full.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("id")
