"""Centroid clustering, approximate neighbours and the prefix trie against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import clustering, neighbours, trie


def _clusters(rows, k, rounds):
    x = np.array([v for _, v in rows], np.int64)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest() if rows[i][0] is not None else "", rows[i][1]))[:k]
    c = x[first]
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if r < rounds:
            c = np.array([[int(s) // int((own == j).sum()) for s in x[own == j].sum(0)] if (own == j).any() else c[j] for j in range(len(c))])
    return sorted(((-1 if i is None else i), int(own[n]), int(d[n, own[n]])) for n, (i, _) in enumerate(rows)), c


@pytest.mark.parametrize("history", [0, 1, 2, 32])
def test_clusters_equal_full_scans(spark, monkeypatch, history):
    monkeypatch.setattr(clustering, "CHUNK", 37)
    rng = random.Random(history)
    middle = [[rng.gauss(0, 3) for _ in range(5)] for _ in range(6)]
    vectors = [[m + rng.gauss(0, 1) for m in rng.choice(middle)] for _ in range(260)]
    vectors[40:140] = [vectors[0]] * 100
    given = [(i if i % 50 else 7, v) for i, v in enumerate(vectors)] + [(None, vectors[3]), (None, vectors[9])]
    odd = [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0] * 6), (904, [1.0, None, 1.0, 1.0, 1.0]), (905, [float("nan")] * 5), (906, [float("-inf")] * 5), (907, [1e30] * 5)]
    df = spark.createDataFrame(given + odd, "id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("chunk", "own", "low", "n", "x", "cluster")})
    v = df.select("id", clustering.scaled(F.col("embedding"), 5).alias("v"), "chunk", "cluster").where("v IS NOT NULL")
    evaluated = []
    found, centres = clustering.clustered(v.select("id", "v"), k=6, rounds=8, history=history, evaluated=evaluated)
    want, c = _clusters([(i, [math.floor(1024 * x) for x in vec]) for i, vec in given], 6, 8)
    assert sorted((-1 if r.id is None else r.id, r.cluster, r.distance) for r in found.collect()) == want
    assert centres.tolist() == c.tolist()
    assert evaluated[0] == 6 * len(given) and evaluated[-1] < 4 * len(given)


def test_clusters_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [1, 2]), (2, [5, 5])], "id long, v array<int>")
    assert sorted(map(tuple, clustering.clustered(df)[0].collect())) in ([(1, 0, 0), (1, 0, 0), (2, 2, 0)], [(1, 1, 0), (1, 1, 0), (2, 0, 0)])
    assert clustering.clustered(df.limit(0))[0].count() == 0


def test_distances_are_exact_where_doubles_are_not():
    x, c = np.array([[(1 << 27) - 1, 3]]), np.array([-(1 << 27) + 1, 4])
    assert clustering.squared(x, c).tolist() == [(2 * ((1 << 27) - 1)) ** 2 + 1]


def _exact(vectors, q, k):
    wide = max(len(v) for v in vectors.values())
    pad = lambda v: [*v, *[0.0] * (wide - len(v))]
    return sorted((-sum(a * b for a, b in zip(pad(vectors[q]), pad(v))), i) for i, v in vectors.items() if i != q)[:k]


def _recall(spark, vectors, monkeypatch, rows=300):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", rows)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 16)
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>").repartition(5)
    got = {}
    for r in neighbours.nearest(df, df.where("id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    found = total = 0
    for q in [i for i in vectors if i % 20 == 0]:
        want = _exact(vectors, q, 20)
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, len(want) + 1))
        assert all(math.isclose(s, -_exact({q: vectors[q], i: vectors[i]}, q, 1)[0][0], abs_tol=1e-12) for _, i, s in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        found, total = found + len({i for _, i in want} & {i for _, i, _ in rows}), total + len(want)
    return found / total


@pytest.mark.parametrize("kind", ["ball", "clusters", "norms", "ties"])
def test_neighbours_recall(spark, monkeypatch, kind):
    rng = np.random.default_rng(len(kind))
    x = rng.standard_normal((1500, 24))
    if kind == "ball":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "clusters":
        x = x * 0.3 + rng.standard_normal((12, 24))[rng.integers(0, 12, 1500)]
    elif kind == "norms":
        x *= np.exp(rng.standard_normal((1500, 1)))
    else:
        x = np.round(x)
        x[200:700] = x[0]
    assert _recall(spark, dict(enumerate(x.tolist())), monkeypatch) >= 0.9


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [0.5]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, []), (7, [-1.0, 2.0]), (8, [0.5]), (None, [1.0, 1.0]), (20, [0.0, 0.0]), (40, [0.0, 3.0, 1.0]), (9, [float("inf")])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("part", "number", "norm", "task")})
    v = df.select("id", neighbours.usable(F.col("embedding")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(v, v.where("id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 0.25), (0, 2, 8, 0.25), (0, 3, 40, 0.0), (0, 4, 7, -0.5), (40, 1, 7, 6.0), (40, 2, 0, 0.0), (40, 3, 1, 0.0), (40, 4, 8, 0.0)]
    assert neighbours.nearest(v.limit(0), v.limit(0)).count() == 0


def test_neighbours_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x = {r.vec_id: r.embedding for r in rows}
    found = {}
    for r in neighbours.op12_neighbours(spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == {i for i in x if i % 20 == 0}
    ids, m = np.array(list(x)), np.array(list(x.values()), float)
    hit = sum(len(found[q] & set(ids[np.argsort(-np.where(ids == q, -9, m @ np.array(x[q], float)))[:20]].tolist())) for q in found)
    assert hit / (20 * len(found)) >= 0.9


def test_collisions_spare_products():
    x = np.random.default_rng(1).standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    directions = neighbours.lines(64)
    s = neighbours.Shard(np.arange(4000), x, directions, 20)
    q = x[7] + 0.3 * x[8]
    score, ids, evaluated = s.best(7, q, directions, 20, -np.inf)
    assert len(ids) == 20 and evaluated < 2000


def _trie(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    by = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    now = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        now[c] = tuple(by.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    nodes = {}
    for c, p in now.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out, kids = [], {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, ())) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, ())) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if now[c] == p)
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("shard, waiting", [(4096, 50_000), (3, 50_000), (1, 2), (20, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, shard, waiting):
    for name, value in (("SHARD_CONVS", shard), ("OVERSAMPLE", 2), ("MOST_WAITING", waiting), ("PIECE_BYTES", 9)):
        monkeypatch.setattr(trie, name, value)
    rng = random.Random(shard)
    rows = []
    for c in [*range(-120, -90), *range(0, 60), *range(100, 150), *range(730, 760)]:
        if c % 9 == 1:
            rows += [(c, t, "user", f"same {t}") for t in range(7)]
        elif c != 730:
            rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "bb", "x" * 30])) for t in range(rng.randrange(1, 9))]
    rows += [(5, 2, "user", "a"), (5, 2, "user", "a"), (5, None, "user", "null turn"), (6, 2, "us", "era"), (6, 2, "use", "ra"), (None, 1, "user", "no conversation"), (11, 9, "u", "long " * 20_000), (55, 9, "u", "long " * 20_000)]
    rows += [(12, t, "user", "deep") for t in range(10, 900)] + [(13, t, "user", "deep") for t in range(10, 900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("base", "nth", "path", "sizes", "shard", "key")})
    got = trie.trie(trie.rebuilt(df)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == _trie(rows)
    assert trie.trie(trie.rebuilt(df.limit(0))).count() == 0
