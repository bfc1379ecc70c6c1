"""Best-fit packing of tokenized documents into sequences of a fixed length.

Method: exact-complement hashing. Only lengths matter for a plan, so the plan is made from how many pieces there are
of each length. From the longest length down, the gap that a piece leaves is looked up among the available single
lengths, pair sums and triple sums, and combinations that fill it exactly are consumed as often as their counts allow;
lengths that are used up leave the index of sums.
What is left is packed best fit, longest first, over groups of equal gaps. The plan lists for each length which
ranks go to which sequences and offsets; every piece finds its own by its rank among pieces of its length.

Scale: the plan's size depends on the capacity alone (every combination it takes uses up a length). Ranks
come from counts of each batch and length, so no length's pieces meet in one task, however many they are.

Cases: null and empty texts are the end mark alone; repeated rows each get their pieces; a null doc_id is kept; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .words import slices

CAPACITY = 1024
END = 2
SLICE_BYTES = 1_000_000


def vocabulary() -> str:
    """The tokenizer that the query uses; an operator's caller gives its own path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, *, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (with_ids: also the ids) of each document's pieces, with batch and nth (the place among the batch's pieces of that length).

    tokenizer: a path that every executor can read; None takes the public vocabulary installed there.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        enc = encoder(tokenizer or vocabulary())
        part, count = TaskContext.get().partitionId(), 0
        seen = np.zeros(capacity + 1, np.int64)
        rows = 0
        for b in slices(batches, 1, SLICE_BYTES):
            ids, bounds = enc.encode(pc.fill_null(b.column(1), "").to_pylist())
            n = np.diff(bounds) + 1
            k = -(-n // capacity)
            doc = np.repeat(np.arange(b.num_rows), k)
            piece = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            head = (n - 1) % capacity + 1
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            whole = np.full(n.sum(), end, np.uint32)
            whole[np.arange(len(ids)) + np.repeat(np.arange(b.num_rows), n - 1)] = ids
            at = (np.cumsum(n) - n)[doc] + start
            raw = whole.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            if rows > 200_000:  # a new batch of ranks
                seen[:], rows, count = 0, 0, count + 1
            rows += len(length)
            order = np.argsort(length, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], length[order][1:] != length[order][:-1]]))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(new, np.diff(np.append(new, len(length))))
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            out = {"doc_id": b.column(0).take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "batch": pa.array(np.full(len(doc), (part << 32) | count)), "nth": pa.array(nth)}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)).astype(np.int32)), pa.array(whole.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, batch long, nth long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(cut, schema)


class Sums:
    """How many pieces are left of each length, and an index by sum of the singles, pairs and triples of lengths that are left.

    `singles`, `pairs` and `triples` count, for each sum below the capacity, the combinations of one, two and three lengths (a length may come again) of which pieces are left.
    Combinations that hold a length are those of one member less with that length put in, so a length enters or leaves the index by adding or taking away shifted counts.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        self.singles, self.pairs, self.triples = (np.zeros(capacity + 1, np.int64) for _ in range(3))
        for length, n in counts.items():
            if n:
                self.left[length] = n
                self.singles[length] = 1
                self.pairs[length:] += self.singles[: len(self.pairs) - length]
                self.triples[length:] += self.pairs[: len(self.triples) - length]

    def consume(self, *lengths: int) -> int:
        """Takes a combination as often as pieces allow, and says how often; lengths that are used up leave the index."""
        n = min(int(self.left[x]) // lengths.count(x) for x in set(lengths))
        if n:
            for x in lengths:
                self.left[x] -= n
            for x in {x for x in lengths if not self.left[x]}:
                self.triples[x:] -= self.pairs[: len(self.triples) - x]
                self.pairs[x:] -= self.singles[: len(self.pairs) - x]
                self.singles[x] = 0
        return n

    def pairs_of(self, total: int, most: int) -> list[tuple[int, int]]:
        """The pairs of a sum, the larger length first and at most so large, in falling order."""
        if not self.pairs[total]:
            return []
        b = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
        b = b[(self.singles[b] > 0) & (self.singles[total - b] > 0)] if len(b) else b
        return [(x, total - x) for x in b.tolist()]

    def triples_of(self, total: int) -> Iterator[tuple[int, int, int]]:
        """The triples of a sum, largest length first; only lengths whose complement is the sum of a pair are opened."""
        if self.triples[total]:
            x = np.arange(total - 2, 0, -1)
            for a in x[(self.singles[x] > 0) & (self.pairs[total - x] > 0)].tolist():
                if self.singles[a]:
                    yield from ((a, *pair) for pair in self.pairs_of(total - a, a))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination of lengths is packed; counts: how many pieces there are of each length."""
    sums = Sums(counts, capacity)
    left = sums.left
    out: list[tuple[tuple[int, ...], int]] = []
    for a in range(capacity, 0, -1):
        if not left[a]:
            continue
        gap = capacity - a
        for filling in itertools.chain([()] if not gap else [(gap,)] if sums.singles[gap] else [], sums.pairs_of(gap, gap), sums.triples_of(gap)):
            if not left[a]:
                break
            n = sums.consume(a, *filling)
            if n:
                out.append(((a, *filling), n))
    # best fit, longest first: groups of sequences with equal contents, by the gap that is left
    gaps: dict[int, list[list]] = {}
    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            fit = min((g for g in gaps if g >= a), default=None)
            if fit is None:
                each = capacity // a
                full, some = divmod(n, each)
                for size, qty in ((each, full), (some, 1)):
                    if size and qty:
                        gaps.setdefault(capacity - a * size, []).append([(a,) * size, qty])
                n = 0
                continue
            group = gaps[fit][-1]
            used = min(n, group[1])
            gaps.setdefault(fit - a, []).append([(*group[0], a), used])
            group[1] -= used
            n -= used
            if not group[1]:
                gaps[fit].remove(group)
                if not gaps[fit]:
                    del gaps[fit]
    out.extend((x, n) for groups in gaps.values() for x, n in groups)
    return out


class Slots:
    """For each length, the ranks at which its slots begin, with their sequences and offsets."""

    def __init__(self, combinations: list[tuple[tuple[int, ...], int]]):
        by: dict[int, list[tuple[int, int, int]]] = {}
        upto: dict[int, int] = {}
        base = 0
        for lengths, n in combinations:
            offset = 0
            for x in lengths:
                by.setdefault(x, []).append((upto.get(x, 0), base, offset))
                upto[x] = upto.get(x, 0) + n
                offset += x
            base += n
        self.by = {x: np.array(rows, np.int64) for x, rows in by.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], length[order][1:] != length[order][:-1]])) if len(order) else []
        for at in np.split(order, cut[1:]) if len(order) else ():
            rows = self.by[int(length[at[0]])]
            k = np.searchsorted(rows[:, 0], rank[at], "right") - 1
            sequence[at], offset[at] = rows[k, 1] + rank[at] - rows[k, 0], rows[k, 2]
        return sequence, offset


def packed(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset."""
    cut = written(cut, "pieces")
    held = cut.groupBy("batch", "length").agg(F.count("*").alias("n"))
    held = written(held, "lengths")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length, capacity at most
    slots = cut.sparkSession.sparkContext.broadcast(Slots(plan(counts, capacity)))
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))).select("batch", "length", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = cut.hint("merge").join(before, ["batch", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "batch")
    rest = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = slots.value.find(b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("rank")).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in rest] + [pa.array(sequence), pa.array(offset)], [*rest, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in rest) + ", sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
