"""Centroid clustering: exact rounds of assignment and averaging, in which ns-bounds save most distances.

Method: a vector keeps, for each centroid, a lower bound on its distance and the round in which that was last evaluated. All
positions of the centroids are retained; a bound is loosened by the norm of the total displacement since its own round, which is
never more than the sum of the displacements of the rounds between. A vector whose own distance, loosened upwards likewise, is below all its loosened bounds keeps
its centroid without any distance. Else its own distance is evaluated, and then those centroids only whose bounds it does not beat.
Distances are evaluated exactly on integers and bounds are rounded down, so every round is that of a full scan, ties included.

Scale: vectors lie in chunks of `CHUNK`, bucketed once; each round joins them with the bounds of the round before, bucketed alike,
without an exchange, and writes new bounds (about a seventh of the vectors' size) and one sum for each centroid and chunk. The sums are
folded in tasks, then in a grouping. What reaches driver and tasks has a row for each centroid and at most
`HISTORY` positions: bounds older than that are loosened once more and dated anew. The former round's table is deleted when the next is written.
Rows are dealt out evenly whatever their ids or values, and equal vectors or ids gather nowhere.

Cases: vectors that are null, of another length, hold nulls or non-finite components, or a component of 2^27 or more after scaling (whose squares leave
64 bits) take no part; repeated rows each count; rows of null id count too, and begin no centroid unless there are too few others; of equal
hashes the smaller vector comes first; fewer vectors than centroids make fewer centroids; empty clusters keep their centroid; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, emptied, parts, scratch, table, written

DIMS = 64
CENTROIDS = 8
ROUNDS = 10
CHUNK = 4096
#: Rounds of which centroids' positions are kept.
HISTORY = 32
#: Components are below this in size.
MOST = 1 << 27


def scaled(vector: Column, dims: int = DIMS, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    x = F.transform(vector, lambda v: v.cast("double") * scale)
    bad = F.exists(x, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) >= MOST), F.lit(True)))
    return F.when((F.size(x) == dims) & ~bad, F.transform(x, lambda v: F.floor(v).cast("int")))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = 3) -> list[list[int]]:
    """The vectors of the k smallest hashes of seed and id."""
    keyed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    return [r.v for r in keyed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid: in doubles where these are exact, else in longs."""
    far = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * 2
    y = x.astype(np.float64 if far * far * x.shape[1] < 1 << 53 else np.int64) - c
    return np.einsum("ij,ij->i", y, y).astype(np.int64)


def _down(d: np.ndarray) -> np.ndarray:
    return np.nextafter(d.astype(np.float32), np.float32(-np.inf))


class Bounds:
    """Of some vectors: their centroids, the lower bound for each centroid, and the round of each bound's evaluation."""

    def __init__(self, own: np.ndarray, low: np.ndarray, when: np.ndarray):
        self.own, self.low, self.when = own, low, when

    @classmethod
    def fresh(cls, x: np.ndarray, centres: np.ndarray, now: int) -> Bounds:
        d = np.stack([squared(x, c) for c in centres], 1)
        return cls(d.argmin(1).astype(np.int32), _down(np.sqrt(d)), np.full(d.shape, now, np.int32))

    @classmethod
    def read(cls, n: int, own: bytes, low: bytes, when: bytes) -> Bounds:
        return cls(np.frombuffer(own, np.int32).copy(), np.frombuffer(low, np.float32).reshape(n, -1).copy(), np.frombuffer(when, np.int32).reshape(n, -1).copy())

    def moved_on(self, x: np.ndarray, centres: np.ndarray, moved: np.ndarray, eldest: int, fold: int, now: int) -> int:
        """Assigns the vectors anew; moved: displacement since each round from `eldest` on, by centroid. Returns the number of distances evaluated.

        Bounds from before the round `fold` are loosened for good and dated anew: their positions are about to be forgotten.
        """
        rows, ks = np.arange(len(x)), np.arange(len(centres))
        drift = moved[self.when - eldest, ks]
        low = self.low - drift
        stale = self.when < fold
        self.low, self.when = np.where(stale, _down(low), self.low), np.where(stale, now, self.when)
        up = np.where(stale[rows, self.own], np.inf, np.nextafter(np.nextafter(self.low[rows, self.own], np.float32(np.inf)), np.float32(np.inf)).astype(np.float64) + drift[rows, self.own])
        low[rows, self.own] = np.inf
        open_ = np.flatnonzero(low.min(1) <= up) if len(ks) > 1 else rows[:0]
        open_ = np.union1d(open_, np.flatnonzero(np.isinf(up)))
        if not len(open_):
            return 0
        best, count = np.zeros(len(x), np.int64), len(open_)
        near = np.full(len(x), -np.inf)
        for j in ks:
            r = open_[self.own[open_] == j]
            best[r] = squared(x[r], centres[j])
            near[r] = np.sqrt(best[r])
            self.low[r, j], self.when[r, j] = _down(near[r]), now
        own = self.own.copy()
        for j in ks:
            r = open_[low[open_, j] <= near[open_]]
            d = squared(x[r], centres[j])
            self.low[r, j], self.when[r, j] = _down(np.sqrt(d)), now
            take = (d < best[r]) | ((d == best[r]) & (j < own[r]))
            best[r[take]], own[r[take]] = d[take], j
            count += len(r)
        self.own = own
        return count


def _chunks(vectors: DataFrame) -> DataFrame:
    """Ids and vectors in rows of up to CHUNK, dealt out evenly."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def full() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, x = whole["id"].combine_chunks(), whole["v"].combine_chunks().flatten().to_numpy().astype(np.int32)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([part | n]), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "x": pa.array([x.tobytes()], pa.binary())})

        for b in batches:
            while b.num_rows:
                room = CHUNK - sum(h.num_rows for h in held)
                held.append(b.slice(0, room))
                b = b.slice(room)
                if sum(h.num_rows for h in held) == CHUNK:
                    yield full()
                    held, n = [], n + 1
        if held:
            yield full()

    return vectors.mapInArrow(pack, "chunk long, n int, ids array<long>, x binary")


_STATE = "chunk long, own binary, low binary, when binary, n binary, sums binary, evaluated long"


def _assigned(both: DataFrame, centres: np.ndarray, moved: np.ndarray | None, eldest: int, fold: int, now: int) -> DataFrame:
    k = len(centres)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = np.frombuffer(row["x"], np.int32).reshape(row["n"], -1)
                if moved is None:
                    s, count = Bounds.fresh(x, centres, now), x.shape[0] * k
                else:
                    s = Bounds.read(row["n"], row["own"], row["low"], row["when"])
                    count = s.moved_on(x, centres, moved, eldest, fold, now)
                sums = np.zeros((k, x.shape[1]), np.int64)
                np.add.at(sums, s.own, x)
                out = [row["chunk"], s.own.tobytes(), s.low.tobytes(), s.when.tobytes(), np.bincount(s.own, minlength=k).tobytes(), sums.tobytes(), count]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in out], names=["chunk", "own", "low", "when", "n", "sums", "evaluated"])

    return both.mapInArrow(step, _STATE)


def _averages(state: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, int]:
    """The next centroids, floor(sum / count), and how many distances were evaluated; a task sends one sum for each centroid and component."""
    k, d = centres.shape

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, evaluated = np.zeros(k * (d + 1), np.int64), 0
        for b in batches:
            for n, sums, e in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                total += np.concatenate([np.frombuffer(n, np.int64), np.frombuffer(sums, np.int64)])
                evaluated += e
        yield pa.RecordBatch.from_pydict({"total": pa.array([[*total.tolist(), evaluated]], pa.list_(pa.int64()))})

    folded = state.select("n", "sums", "evaluated").mapInArrow(fold, "total array<long>")
    sums = folded.select(F.posexplode("total").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    got = {r["at"]: int(r.s) for r in sums.collect()}
    new = [[got[k + j * d + i] // got[j] for i in range(d)] if got.get(j) else centres[j].tolist() for j in range(k)]
    return np.array(new, np.int64), got.get(k * (d + 1), 0)


def clustered(vectors: DataFrame, *, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3, history: int | None = None, evaluated: list[int] | None = None) -> tuple[DataFrame, np.ndarray]:
    """Rows of id (long), cluster and distance (squared), and the final centroids; vectors: id, v (array<int>, all of one length).

    evaluated: gets the number of distances evaluated in each round.
    """
    spark, history = vectors.sparkSession, HISTORY if history is None else history
    centres = np.array(first_centroids(vectors, k, seed), np.int64)
    if not len(centres):
        return spark.createDataFrame([], "id long, cluster int, distance long"), centres

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, ids, x, own in zip(*(b.column(i) for i in range(4)), strict=True):
                own = np.frombuffer(own.as_py(), np.int32)
                v = np.frombuffer(x.as_py(), np.int32).reshape(n.as_py(), -1)
                far = np.zeros(len(v), np.int64)
                for j in np.unique(own):
                    far[own == j] = squared(v[own == j], centres[j])
                yield pa.RecordBatch.from_pydict({"id": ids.values, "cluster": pa.array(own), "distance": pa.array(far)})

    with scratch(spark):
        n = vectors.count()
        buckets = max(1, min(parts(spark), -(-n // CHUNK)))
        points = bucketed(_chunks(vectors.repartition(buckets)), "points", "chunk", buckets)
        state, kept, eldest = None, [], 0  # kept: positions in the rounds from `eldest` on
        for now in range(rounds + 1):
            kept.append(centres)
            if now - 1 - history > eldest:
                kept, eldest = kept[1:], eldest + 1
            moved, both = None, points.select("chunk", "n", "x")
            if state is not None:
                moved = np.sqrt(((centres - np.array(kept)).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12)
                both = both.join(state.select("chunk", "own", "low", "when").hint("merge"), "chunk")
            new = bucketed(_assigned(both, centres, moved, eldest, now - history, now), "bounds", "chunk", buckets)
            if state is not None:
                emptied(state)
            state = new
            after, count = _averages(state, centres)
            if evaluated is not None:
                evaluated.append(count)
            if now == rounds or (after == centres).all():
                break
            centres = after
        both = points.select("chunk", "n", "ids", "x").join(state.select("chunk", "own").hint("merge"), "chunk").select("n", "ids", "x", "own")
        rows = written(both.mapInArrow(read, "id long, cluster int, distance long"), "clustered", keep=True)
    return rows, centres


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), scaled(F.col("embedding")).alias("v"))
    with scratch(spark):
        found, centres = clustered(written(rows.where("v IS NOT NULL"), "vectors"))
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    total = {r.cluster: int(r.s) for r in each.collect()}
    text = [(j, total.get(j, 0), sum(total.values()), ",".join(map(str, c))) for j, c in enumerate(centres.tolist())]
    centroid = spark.createDataFrame(text, "cluster int, cluster_inertia long, inertia long, text string")
    return found.join(F.broadcast(centroid), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("text", 256).alias("centroid_sha256"))


def _sql() -> str:
    near = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = """WITH v AS MATERIALIZED (SELECT row_number() OVER () row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(CAST(x AS DOUBLE)) * 1024 >= 134217728)) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, c) - 1 j, c FROM (SELECT sha256('3:' || vec_id) h, v c FROM v ORDER BY h NULLS LAST, v LIMIT 8))"""
    for r in range(1, ROUNDS + 2):
        out += f""",
a{r} AS MATERIALIZED (SELECT row, any_value(vec_id) vec_id, any_value(v) v, min(struct_pack(d := CAST({near} AS BIGINT), j := j)) a FROM v, c{r - 1} GROUP BY row),
c{r} AS MATERIALIZED (SELECT o.j, coalesce(n.c, o.c) c FROM c{r - 1} o LEFT JOIN (SELECT j, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) c FROM
  (SELECT j, i, CAST(sum(x) AS BIGINT) s, count(*) n FROM (SELECT a.j j, unnest(v) x, generate_subscripts(v, 1) i FROM a{r}) GROUP BY j, i) GROUP BY j) n ON n.j = o.j)"""
    return out + f"""
SELECT vec_id, CAST(a.j AS INTEGER) AS "cluster", a.d distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) inertia, sha256(array_to_string(c, ',')) centroid_sha256
FROM a{ROUNDS + 1} JOIN c{ROUNDS} ON c{ROUNDS}.j = a.j"""


SQL = _sql()
