"""Exact top-k by inner product: a ball tree in each shard, searched by branch and bound.

Method: every shard's vectors form a ball tree. A block of queries goes down a tree together; a node is entered only
by the queries whose upper bound there (inner product with the centre, plus norm times radius) reaches their
current k-th score, and of two children each query takes the one with the higher bound first. The k-th scores
are shared between shards: a query block searches the shard of its highest bound first, then the square root of the shards' number by bound, then the
rest, and carries the k-th scores found so far from each round to the next. Before each round a shard's root ball prunes it for blocks that it cannot serve.

Scale: shards have `SHARD_ROWS` rows and query blocks `BLOCK_QUERIES`; a task opens one tree for up to `TOGETHER` blocks. Pairs of blocks and shards are
judged from the shards' balls alone, `CHUNK` of them at a time, so nothing that grows is broadcast. A shard keeps at most k + 1 rows of one equal vector,
those of the smallest ids, which is all that any answer can hold.

Cases: vectors that are null, empty or hold nulls or non-finite components take no part; shorter vectors count as
filled with zeros; of repeated rows of an id the smallest vector counts; ties go to the smaller id; rows of null id
take no part; a query has fewer rows if there are fewer candidates; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K = 20
SHARD_ROWS = 16_384
BLOCK_QUERIES = 1024
LEAF = 256
#: Query blocks that a task searches in one tree.
TOGETHER = 32
#: Shards whose balls are judged at once.
CHUNK = 1024
_NONE = np.iinfo(np.int64).min


class BallTree:
    """Nodes as arrays: first and last row, centre, radius and children (-1 at leaves)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
        first = np.flatnonzero(new)
        nth = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        self.ids, self.vectors = ids[nth <= k], vectors[nth <= k].astype(np.float64)
        self.exact = bool(np.abs(vectors).max(initial=0) < 2**20)
        self.integers = None if self.exact else vectors[nth <= k]
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        self._build(0, len(self.ids))

    def _build(self, a: int, b: int) -> int:
        v = self.vectors[a:b]
        centre = v.mean(0)
        far = np.sqrt(((v - centre) ** 2).sum(1))
        me = len(self.nodes)
        self.nodes.append((a, b, centre, float(far.max()), -1, -1))
        if b - a > LEAF and far.max() > 0:
            one = v[far.argmax()]
            two = v[((v - one) ** 2).sum(1).argmax()]
            order = np.argsort(v @ (two - one), kind="stable")
            self.vectors[a:b], self.ids[a:b] = v[order], self.ids[a:b][order]
            if self.integers is not None:
                self.integers[a:b] = self.integers[a:b][order]
            mid = (a + b) // 2
            left, right = self._build(a, mid), self._build(mid, b)
            self.nodes[me] = (*self.nodes[me][:4], left, right)
        return me


class Search:
    """The best k of a block of queries, over any number of trees."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.exact, self.k, self.floor = ids, vectors, k, floor
        self.vectors = vectors.astype(np.float64)
        self.norms = np.sqrt((self.vectors**2).sum(1))
        self.score, self.of = np.full((len(ids), k), _NONE, np.int64), np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)

    def least(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[q, -1], self.floor[q])

    def bound(self, node: tuple, q: np.ndarray) -> np.ndarray:
        up = self.vectors[q] @ node[2] + self.norms[q] * node[3]
        return up + 1e-9 * (np.abs(up) + self.norms[q] + 1)

    def visit(self, tree: BallTree, at: int, q: np.ndarray, bound: np.ndarray) -> None:
        reach = bound >= self.least(q)
        q = q[reach]
        if not len(q):
            return
        a, b, _, _, left, right = tree.nodes[at]
        if left < 0:
            return self._leaf(tree, a, b, q)
        up = self.bound(tree.nodes[left], q), self.bound(tree.nodes[right], q)
        by = up[0] >= up[1]
        for side, (one, two) in ((by, (0, 1)), (~by, (1, 0))):
            for x in (one, two):
                self.visit(tree, (left, right)[x], q[side], up[x][side])

    def _leaf(self, tree: BallTree, a: int, b: int, q: np.ndarray) -> None:
        if tree.exact and np.abs(self.exact).max(initial=0) < 2**20:
            s = (self.vectors[q] @ tree.vectors[a:b].T).astype(np.int64)
        else:
            s = self.exact[q] @ tree.integers[a:b].T if tree.integers is not None else self.exact[q] @ tree.vectors[a:b].T.astype(np.int64)
        near = (s >= self.least(q)[:, None]) & (self.ids[q][:, None] != tree.ids[a:b][None, :])
        row, col = np.nonzero(near)
        if not len(row):
            return
        some = np.unique(row)
        mine = np.repeat(np.arange(len(some)), self.k)
        old = self.score[q[some]].ravel(), self.of[q[some]].ravel()
        which = np.concatenate([mine, np.searchsorted(some, row)])
        score, of = np.concatenate([old[0], s[row, col]]), np.concatenate([old[1], tree.ids[a:b][col]])
        order = np.lexsort((of, -np.maximum(score, -np.iinfo(np.int64).max), which))
        which = which[order]
        first = np.searchsorted(which, np.arange(len(some)))
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[q[some]], self.of[q[some]] = score[take].reshape(-1, self.k), of[take].reshape(-1, self.k)


def integers(vector: Column) -> Column:
    """floor(64 * x) of each component; null for vectors that take no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    return F.when((F.size(x) > 0) & ~bad, F.transform(x, lambda v: F.floor(v * 64).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(sizes.max(initial=1))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = K) -> DataFrame:
    """vectors and queries (id long, v array<long>) to query_id, rank, vec_id, score; a query's own id is no candidate."""
    n, m, wide = vectors.count(), queries.count(), vectors.unionByName(queries).agg(F.max(F.size("v"))).first()[0] or 1
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_QUERIES))

    def pad(v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, wide - v.shape[1])))

    def plant(key, t):
        tree = BallTree(t["id"].to_numpy(), pad(_matrix(t["v"])), k)
        _, _, centre, radius, _, _ = tree.nodes[0]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "centre": pa.array([centre], pa.list_(pa.float64())), "radius": pa.array([radius])})

    def bundle(key, t):
        body = pickle.dumps((t["id"].to_numpy(), pad(_matrix(t["v"])), np.full(len(t), _NONE)))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "queries": pa.array([body], pa.binary())})

    def gather(key, t):
        body = pickle.dumps((t["shard"].to_numpy(), np.stack(t["centre"].to_pylist()), t["radius"].to_numpy()))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "balls": pa.array([body], pa.binary())})

    trees = written(vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(plant, "shard int, tree binary, centre array<double>, radius double"), "trees")
    asked = written(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(bundle, "block int, queries binary"), "queries")
    balls = written(trees.withColumn("chunk", F.floor(F.col("shard") / CHUNK).cast("int")).groupBy("chunk").applyInArrow(gather, "chunk int, balls binary"), "balls")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, queries, body in zip(*(b.column(i) for i in range(3)), strict=True):
                (_, v, floor), (shard, centre, radius) = pickle.loads(queries.as_py()), pickle.loads(body.as_py())
                v = v.astype(np.float64)
                up = v @ centre.T + np.sqrt((v**2).sum(1))[:, None] * radius
                up += 1e-9 * (np.abs(up) + 1)
                reach = np.flatnonzero((up >= floor[:, None]).any(0))
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(reach), block.as_py(), np.int32)), "shard": pa.array(shard[reach], pa.int32()), "bound": pa.array(up.max(0)[reach])})

    def search(key, left, right):
        out, tree = [], pickle.loads(right["tree"][0].as_py())
        for block, queries in zip(left["block"], left["queries"], strict=True):
            ids, v, floor = pickle.loads(queries.as_py())
            s, q = Search(ids, v, k, floor), np.arange(len(ids))
            s.visit(tree, 0, q, s.bound(tree.nodes[0], q))
            row, col = np.nonzero(s.score > _NONE)
            out.append((np.full(len(row), block.as_py(), np.int32), ids[row], s.of[row, col], s.score[row, col]))
        return pa.table({name: pa.array(np.concatenate(x)) for name, x in zip(("block", "query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    def carry(key, left, right):
        ids, v, floor = pickle.loads(left["queries"][0].as_py())
        if len(right):
            q, s = right["query_id"].to_numpy(), right["least"].to_numpy()
            order = np.argsort(ids)
            floor[order[np.searchsorted(ids[order], q)]] = s
        return pa.table({"block": left["block"], "queries": pa.array([pickle.dumps((ids, v, floor))], pa.binary())})

    chunks, pair = -(-shards // CHUNK), ["block", "shard"]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    done = found = None
    for most in (1, isqrt(shards - 1) + 1, shards):
        reach = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).hint("merge").join(balls, "chunk").select("block", "queries", "balls").mapInArrow(judge, "block int, shard int, bound double")
        rest = reach if done is None else reach.hint("merge").join(done, pair, "left_anti")
        nth = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("bound"), "shard"))
        pairs = written(rest.withColumn("nth", nth).where(F.col("nth") <= most).select(*pair), "pairs")
        if pairs.isEmpty():
            break
        at = pairs.withColumn("part", F.floor(F.col("block") / TOGETHER).cast("int"))
        left = at.hint("merge").join(asked, "block").groupBy("shard", "part")
        tasks = at.select("shard", "part").distinct().hint("merge").join(trees.select("shard", "tree"), "shard")
        right = tasks.select(F.col("shard").alias("of"), F.col("part").alias("nth"), "tree").groupBy("of", "nth")
        new = written(left.cogroup(right).applyInArrow(search, "block int, query_id long, vec_id long, score long"), "found")
        found = written(ranked(new if found is None else found.drop("rank").unionByName(new)), "best")
        done = pairs if done is None else done.unionByName(pairs)
        least = found.groupBy("block", "query_id").agg(F.count("*").alias("c"), F.min("score").alias("least")).where(F.col("c") == k)
        asked = written(asked.groupBy("block").cogroup(least.groupBy("block")).applyInArrow(carry, "block int, queries binary"), "queries")
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), integers(F.col("embedding")).alias("v"))
    vectors = written(rows.where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")), "vectors")
    return nearest(vectors, vectors.where(F.col("id") % 20 == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 20
"""
