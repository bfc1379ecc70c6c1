"""Conversation prefix trie by splitter-skeleton: what prefixes conversations share, and what sharing them saves.

Method: a conversation becomes a path, sixteen bytes of SHA-256 for each turn (of its role and text), so that paths in byte order are a
walk through the trie. Splitters from a sample cut (path, conv_id) into ranges. The trie of the splitters' paths, the skeleton, is broadcast: only its nodes can
have members in several ranges. Each range, sorted, is walked once with a stack of open nodes; nodes outside the skeleton begin and end in it and are
finished there. Of skeleton nodes each range emits partial counts, which a grouping adds up; a last pass from the skeleton's
tips to the root adds what depends on whole nodes. The members that end in a skeleton node leave their ranges as pieces of text in order, which one streaming pass hashes.

Scale: texts are shuffled once, to number turns; then only paths and lengths. Equal conversations may be cut anywhere, since the id belongs to the key. A walk
holds its open nodes and up to `MOST_WAITING` finished children of each (they wait for the parent's smallest member; beyond that they get it by a join).
The splitters' paths have `MOST_TURNS` turns together at most (else every second one is left out, down to one), so the skeleton has a proven bound.
A conversation's path is one row.

Cases: null roles and texts are empty; rows of null conv_id belong to no conversation; null turns come first; turns of equal number go by role, then text, and
repeated rows stay; conversations of one turn or none, absent first conversations of a hundred and negative ids (c % 100 has the sign of c) follow the
rule; an empty table gives no rows, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, scratch, table, written

BYTES = 16
#: Conversations in a range, and ranges at most (then they are larger).
SHARD_CONVS = 4096
MOST_SHARDS = 20_000
#: Sampled conversations for each range.
OVERSAMPLE = 16
#: Turns of all splitters together.
MOST_TURNS = 1_000_000
#: Children that wait at an open node.
MOST_WAITING = 50_000
#: Bytes of ids in a piece of text.
PIECE_BYTES = 1_000_000
#: Nodes with waiting children that may be broadcast.
MOST_BROADCAST = 200_000
_NONE = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, *, group: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, path and sizes (code points of each turn) of rebuilt conversations: h turns of the group's first one, then the own ones after h; h is crc32(conv_id) % heads."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    c = F.col("conv_id").cast("long")
    rows = conversations.select(c.alias("conv_id"), (c - c % group).alias("base"), "turn", role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    rows = rows.repartition(parts(conversations.sparkSession), "base")
    nth = F.row_number().over(Window.partitionBy("base", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    token = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * BYTES)
    turns = rows.select("base", "conv_id", nth.alias("nth"), token.alias("token"), F.length("text").alias("size"))
    gathered = lambda rows, *by: rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("nth", "token", "size"))).alias("turns"))
    head = gathered(turns.where((F.col("conv_id") == F.col("base")) & (F.col("nth") < heads)), "base").withColumnRenamed("turns", "head")
    whole = gathered(turns, "base", "conv_id").hint("merge").join(head, "base", "left")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    now = F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), h), own))
    return whole.select("conv_id", now.alias("turns")).select("conv_id", F.unhex(F.array_join(F.col("turns.token"), "")).alias("path"), F.col("turns.size").alias("sizes"))


class Skeleton:
    """The trie of the splitters' paths. Nodes are numbers, parents before children; 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters, self.parent, self.depth = splitters, [-1], [0]
        self.nodes: list[list[int]] = []
        before, ids = b"", [0]
        for path, _ in splitters:
            same = _shared(before, path)
            ids = ids[: same + 1]
            for d in range(same + 1, len(path) // BYTES + 1):
                self.parent.append(ids[-1])
                self.depth.append(d)
                ids.append(len(self.parent) - 1)
            self.nodes.append(ids)
            before = path

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


def _shared(a: bytes, b: bytes) -> int:
    """The number of turns that two paths begin with alike."""
    if a == b:
        return len(a) // BYTES
    low, high = 0, min(len(a), len(b)) // BYTES
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * BYTES] == b[: mid * BYTES] else (low, mid - 1)
    return low


class _Node:
    """An open node of a walk."""

    __slots__ = ("chars", "children", "ends", "key", "least", "leaves", "left", "members", "right", "saved", "skeleton", "waiting")

    def __init__(self, chars: int, left: bool, right: bool, skeleton: int):
        self.chars, self.left, self.right, self.skeleton = chars, left, right, skeleton
        self.members, self.least, self.children, self.leaves, self.saved, self.ends, self.waiting, self.key = 0, None, 0, 0, 0, None, [], None


#: kind: 0 a node, 1 part of a skeleton node, 2 a piece of a skeleton node's ids.
_FIELDS = (("kind", pa.int32()), ("key", pa.int64()), ("nth", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends", pa.string()))
_SCHEMA = ", ".join(f"{name} {'string' if kind == pa.string() else 'int' if kind == pa.int32() else 'long'}" for name, kind in _FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[name for name, _ in _FIELDS])


class Walk:
    """The walk of one range: rows come in order of path and id; finished nodes, parts and pieces go to `out`."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.shard, self.out, self.number = shard, [], 0
        self.left = (skeleton.splitters[shard - 1][0], skeleton.nodes[shard - 1]) if shard else (b"", [0])
        self.right = (skeleton.splitters[shard][0], skeleton.nodes[shard]) if shard < len(skeleton.splitters) else (b"", [0])
        self.stack, self.path = [_Node(0, True, True, 0)], b""
        self.piece: list[str] = []
        self.piece_of, self.piece_size = 0, 0

    def add(self, path: bytes, conv_id: int, sizes: list[int]) -> None:
        same = _shared(self.path, path)
        while len(self.stack) > same + 1:
            self._close()
        for d in range(same, len(path) // BYTES):
            token, up = path[d * BYTES : (d + 1) * BYTES], self.stack[-1]
            left, right = (ok and p[d * BYTES : (d + 1) * BYTES] == token for ok, (p, _) in ((up.left, self.left), (up.right, self.right)))
            self.stack.append(_Node(sizes[d], left, right, self.left[1][d + 1] if left else self.right[1][d + 1] if right else -1))
        self.path, top = path, self.stack[-1]
        top.members += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        if top.skeleton >= 0:
            self._ended(top.skeleton, str(conv_id))
        elif top.ends is None:
            top.ends = hashlib.sha256(b"%d" % conv_id)
        else:
            top.ends.update(b",%d" % conv_id)

    def _ended(self, node: int, text: str) -> None:
        if node != self.piece_of or self.piece_size > PIECE_BYTES:
            self._piece()
        self.piece_of = node
        self.piece.append(text)
        self.piece_size += len(text) + 1

    def _piece(self) -> None:
        if self.piece:
            self.out.append((2, self.piece_of, self._nth(), *[None] * 9, ",".join(self.piece)))
        self.piece, self.piece_size = [], 0

    def _nth(self) -> int:
        self.number += 1
        return self.shard << 40 | self.number

    def _close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        up = self.stack[-1] if self.stack else None
        if node.skeleton >= 0:
            self._flush(node, node.skeleton)
            self.out.append((1, node.skeleton, None, node.least, depth, None, None, node.members, node.children, node.leaves, node.saved, node.chars, None))
        else:
            if not node.children:
                node.leaves = 1
            node.saved += (node.members - 1) * node.chars
            if node.key is not None:
                self._flush(node, node.key)
            self.out.extend((*row[:5], node.least, *row[6:]) for row in node.waiting)
            up.children += 1
            up.waiting.append((0, node.key, None, node.least, depth, None, None, node.members, node.children, node.leaves, node.saved, None, node.ends.hexdigest() if node.ends else _NONE))
            if len(up.waiting) > MOST_WAITING:
                if up.skeleton < 0 and up.key is None:
                    up.key = -1 - self._nth()
                self._flush(up, up.skeleton if up.skeleton >= 0 else up.key)
        if up:
            up.members += node.members
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.leaves += node.leaves
            up.saved += node.saved

    def _flush(self, node: _Node, key: int) -> None:
        """Waiting children leave with the key of a parent whose smallest member they will get by a join."""
        self.out.extend((*row[:6], key, *row[7:]) for row in node.waiting)
        node.waiting = []

    def end(self) -> None:
        while self.stack:
            self._close()
        self._piece()


def _splitters(paths: DataFrame, n: int) -> list[tuple[bytes, int]]:
    """Keys that cut the paths into ranges: every so many of a sample in order. Their number and their turns are bounded."""
    shards = min(MOST_SHARDS, -(-n // SHARD_CONVS))
    if shards < 2:
        return []
    some = paths.select("path", "conv_id").sample(min(1.0, shards * OVERSAMPLE / n), seed=13)
    some = written(some.withColumn("nth", F.row_number().over(Window.orderBy("path", "conv_id"))), "sample")
    chosen = some.where(F.col("nth") % OVERSAMPLE == 0).select("path", "conv_id", F.length("path").alias("bytes"))
    step = 1
    while chosen.count() > 1 and chosen.agg(F.sum("bytes")).first()[0] > MOST_TURNS * BYTES:
        step *= 2
        chosen = some.where(F.col("nth") % (OVERSAMPLE * step) == 0).select("path", "conv_id", F.length("path").alias("bytes"))
    return sorted((bytes(r.path), r.conv_id) for r in chosen.collect())


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256; conversations: conv_id, path, sizes."""
    spark = conversations.sparkSession
    with scratch(spark):
        paths = written(conversations.select("conv_id", "path", "sizes"), "paths")
        skeleton = Skeleton(_splitters(paths, paths.count()))
        shared = spark.sparkContext.broadcast(skeleton)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of = [shared.value.shard(p, c) for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of, pa.int64())], names=["conv_id", "path", "sizes", "shard"])

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None
            for b in batches:
                for c, p, s, of in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if now is None or now.shard != of:
                        if now:
                            now.end()
                            yield _batch(now.out)
                        now = Walk(shared.value, of)
                    now.add(p, c, s)
                    if len(now.out) >= 10_000:
                        yield _batch(now.out)
                        now.out = []
            if now:
                now.end()
                yield _batch(now.out)

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, rows = shared.value, {}
            for b in batches:
                rows |= {r["key"]: r for r in b.to_pylist()}
            for key in rows:
                if key:
                    rows[tree.parent[key]]["n_children"] += 1
            for r in rows.values():
                r["n_leaves"] += not r["n_children"]
                r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"]
                r["own"] = int(not r["n_children"]), (r["n_convs"] - 1) * r["chars"]
            below = dict.fromkeys(rows, (0, 0))
            for key in sorted(rows, reverse=True):
                r, (leaves, saved) = rows[key], below[key]
                r["n_leaves"] += leaves
                r["saved_tokens"] += saved
                if key:
                    up = below[tree.parent[key]]
                    below[tree.parent[key]] = up[0] + leaves + r["own"][0], up[1] + saved + r["own"][1]
            out = [(1, k, None, r["conv_id"], tree.depth[k], rows[tree.parent[k]]["conv_id"] if k else None, None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], None, None) for k, r in rows.items()]
            if out:
                yield _batch(out)

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, sha = None, None
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if key != now:
                        if now is not None:
                            yield pa.RecordBatch.from_pydict({"key": pa.array([now], pa.int64()), "sha": pa.array([sha.hexdigest()])})
                        now, sha = key, hashlib.sha256(text.encode())
                    else:
                        sha.update(b"," + text.encode())
            if now is not None:
                yield pa.RecordBatch.from_pydict({"key": pa.array([now], pa.int64()), "sha": pa.array([sha.hexdigest()])})

        shards = len(skeleton.splitters) + 1
        dealt = paths.mapInArrow(deal, "conv_id long, path binary, sizes array<int>, shard long").repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
        found = written(dealt.mapInArrow(walk, _SCHEMA), "nodes")
        sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        added = found.where("kind = 1").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), *sums)
        tips = added.repartition(1).mapInArrow(reduce, _SCHEMA).drop("ends")  # a row for each skeleton node, whose number is bounded
        shas = found.where("kind = 2").select("key", F.col("ends").alias("text"), "nth").repartition(max(1, min(parts(spark), shards)), "key").sortWithinPartitions("key", "nth").drop("nth")
        hashed = shas.select("key", "text").mapInArrow(digest, "key long, sha string")
        bones = written(tips.hint("merge").join(hashed, "key", "left").withColumn("ends", F.coalesce("sha", F.lit(_NONE))).drop("sha"), "skeleton")
        local = found.where("kind = 0")
        keyed = written(bones.select("key", "conv_id").unionByName(local.where("key IS NOT NULL").select("key", "conv_id")), "parents")
        how = "broadcast" if keyed.count() <= MOST_BROADCAST else "merge"
        answer = keyed.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("answer")).hint(how)
        late = local.where("parent_key IS NOT NULL").drop("parent_conv_id").join(answer, "parent_key").withColumnRenamed("answer", "parent_conv_id")
        every = local.where("parent_key IS NULL").unionByName(late).unionByName(bones)
        return written(every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")), "trie", keep=True)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


SQL = """
WITH t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') role, coalesce(text, '') text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) p FROM conversations WHERE conv_id IS NOT NULL),
h AS MATERIALIZED (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, i: xor(s >> 1, 3988292384 * (s & 1))))) % 6 h FROM (SELECT DISTINCT conv_id c FROM t)),
r AS MATERIALIZED (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, p) d FROM (SELECT c, 0 part, p, role, text FROM h JOIN t ON t.conv_id = c - c % 100 AND p <= h UNION ALL SELECT c, 1, p, role, text FROM h JOIN t ON t.conv_id = c AND p > h)),
m AS MATERIALIZED (SELECT c, d, list(struct_pack(role := role, text := text)) OVER (PARTITION BY c ORDER BY d) k, length(text) chars, count(*) OVER (PARTITION BY c) n FROM r
  UNION ALL SELECT h.c, 0, [], 0, coalesce(x.n, 0) FROM h LEFT JOIN (SELECT c, count(*) n FROM r GROUP BY c) x ON x.c = h.c),
n AS MATERIALIZED (SELECT min(c) conv_id, d, k, count(*) n_convs, any_value(chars) chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) ends FROM m GROUP BY d, k),
o AS MATERIALIZED (SELECT m.c, m.d, n.conv_id FROM m JOIN n ON m.d = n.d AND m.k = n.k),
f AS MATERIALIZED (SELECT n.*, up.conv_id parent_conv_id, (SELECT count(*) FROM n x JOIN o y ON y.c = x.conv_id AND y.d = x.d - 1 WHERE y.conv_id = n.conv_id AND x.d = n.d + 1) n_children
  FROM n LEFT JOIN o up ON up.c = n.conv_id AND up.d = n.d - 1),
s AS (SELECT o.conv_id, o.d, CAST(sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) n_leaves, CAST(sum((f.n_convs - 1) * f.chars) AS BIGINT) saved FROM f JOIN o ON o.c = f.conv_id AND o.d <= f.d GROUP BY o.conv_id, o.d)
SELECT f.conv_id, f.d "depth", parent_conv_id, n_convs, n_children, n_leaves, saved saved_tokens, ends ends_sha256 FROM f JOIN s ON s.conv_id = f.conv_id AND s.d = f.d
"""
