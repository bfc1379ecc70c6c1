"""Substring dedup: removes words of repeated 13-word windows, found by recompression.

Method: Spark rounds rename a text's words to ever longer symbols. A round first names runs of equal symbols,
then pairs of neighbours of which the left symbol is of the "left" half of all names and the right one of the "right" half. Names
are 64-bit hashes of what they stand for and halves are a bit of the name, so equal substrings get equal symbols
except near their two ends (`margin` words). Each round is an exchange over all texts: every piece of the corpus sends
the names that it made in the round, each once, to the group that the name belongs to, and learns which of them
any other document has. A name of one document only is a symbol that no repeat holds: it takes no part in later
rounds, and windows that hold it are given up. Rounds go on until a window no longer holds a whole symbol for certain: `rounds_of(13)` is two.

The windows that are left, all of whose symbols are shared, are verified in a last exchange of the same
form: each sends 128 bits of its words and its smallest doc_id, and learns whether a smaller document has it. Windows are
equal if all 128 bits are; equal names of different symbols only make a window be verified that need not be.

Scale: texts lie compressed in pieces of `PIECE_BYTES`; an exchange moves at most nine bytes for each distinct name of a piece, or
twenty-four for each distinct window, and answers with one bit. A name or window is sent by a piece once, however often it occurs, and
groups are ranges of the hash, so a passage that a third of all rows hold weighs no more than one that each piece holds once. Groups
hold the names of about `GROUP_BYTES` of text. Messages number pieces times groups, so both sizes should be raised beyond some terabytes.

Cases: null and empty texts give n_words 0 and the hash of no bytes; texts under 13 words lose nothing;
rows of one doc_id do not remove each other (ids must be smaller), and each loses its own repeats only;
rows of null doc_id count as the largest id; an empty table gives no rows; extra columns are kept, but for those named as the operator's own results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bucketed, packed_rows, parts, quoted, row_key, table, written
from .words import NON_SPACE, buffers, chunks, gram_hashes, gram_places, mix, slices

WINDOW = 13
#: Text bytes of a piece; a longer text is a piece of its own.
PIECE_BYTES = 8_000_000
#: Text bytes whose names one group handles.
GROUP_BYTES = 16_000_000
_NULL = np.iinfo(np.int64).max
_U = np.uint64


def rounds_of(window: int) -> int:
    """The rounds after which a window still holds a whole symbol (of up to 2^r words) between its margins."""
    r = 0
    while 2 * margin(r + 1) + 2 ** (r + 1) <= window:
        r += 1
    return r


def margin(r: int) -> int:
    """Words at either end of a window whose symbols may depend on what stands outside it, after r rounds."""
    return 2**r


class Parse:
    """Symbols of a chunk of texts; `step` makes the next round's."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        n = len(hashes)
        self.name, self.start, self.length = hashes, np.arange(n), np.ones(n, np.int64)
        self.lone = np.zeros(n, bool)
        self.edge = np.zeros(n + 1, bool)
        self.edge[bounds] = True
        #: Words of runs of three symbols or more: windows with such are not judged by their symbols.
        self.runs = np.zeros(n + 1, np.int64)
        self.level = 0

    def step(self) -> np.ndarray:
        """Names runs and pairs; says which symbols are new. Symbols marked `lone` are not named again."""
        name, start, length, lone = self.name, self.start, self.length, self.lone
        if not len(name):
            return np.empty(0, bool)
        new = np.concatenate([[True], (name[1:] != name[:-1]) | self.edge[start[1:]]])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(name)))
        length, name, start, lone, run = np.add.reduceat(length, at), name[at], start[at], lone[at], count > 1
        long = np.flatnonzero(count > 2)
        np.add.at(self.runs, start[long], 1)
        np.add.at(self.runs, start[long] + length[long], -1)
        name = np.where(run, mix(name + count.astype(_U) * _U(0xA0761D6478BD642F)), name)
        side = ((name >> _U(17 + self.level)) & _U(1)).astype(bool)
        free = ~run & ~lone
        joins = np.concatenate([side[:-1] & ~side[1:] & free[:-1] & free[1:] & ~self.edge[start[1:]], [False]])
        keep = np.concatenate([[True], ~joins[:-1]])
        following = np.append(name[1:], _U(0))
        self.level += 1
        self.name = np.where(joins, mix(name * _U(0xE7037ED1A0B428DB) + following + _U(self.level)), name)[keep]
        self.length = np.where(joins, length + np.append(length[1:], 0), length)[keep]
        self.start, self.lone = start[keep], lone[keep]
        return (joins | run)[keep] & ~self.lone

    def dead(self, window: int) -> np.ndarray:
        """By first word, how many symbols that no other document has rule a window out."""
        out, m = np.zeros(len(self.edge) + 1, np.int64), margin(self.level)
        bad = np.flatnonzero(self.lone)
        first = np.maximum(self.start[bad] + self.length[bad] + m - window, 0)
        last = self.start[bad] - m
        ok = first <= last
        np.add.at(out, first[ok], 1)
        np.add.at(out, last[ok] + 1, -1)
        return np.cumsum(out)


class Piece:
    """A piece's texts as words, taken through as many rounds as there are answers."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, window: int):
        self.ids, self.window = ids, window
        self.chunks = list(chunks(pa.array(texts, pa.binary()), NON_SPACE))
        self.parses = [Parse(c.hashes, c.bounds) for c in self.chunks]
        self.dead = [np.zeros(len(c.hashes) + 2, np.int64) for c in self.chunks]
        self.fresh: list[np.ndarray] = []

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """The next round's new names in order, each once, and whether more than one document of the piece has it."""
        self.fresh = [p.step() for p in self.parses]
        name = np.concatenate([p.name[f] for p, f in zip(self.parses, self.fresh, strict=True)] or [np.empty(0, _U)])
        doc = np.concatenate([self.ids[c.first + np.searchsorted(c.bounds, p.start[f], "right") - 1] for c, p, f in zip(self.chunks, self.parses, self.fresh, strict=True)] or [np.empty(0, np.int64)])
        self.unique, self.code = np.unique(name, return_inverse=True)
        low, high = np.full(len(self.unique), _NULL), np.full(len(self.unique), np.iinfo(np.int64).min)
        np.minimum.at(low, self.code, doc)
        np.maximum.at(high, self.code, doc)
        return self.unique, (low < high) | (low == _NULL)

    def learn(self, shared: np.ndarray) -> None:
        """Takes the answer to `names`: which of them some other document has too."""
        lone, at = ~shared[self.code], 0
        for k, (p, f) in enumerate(zip(self.parses, self.fresh, strict=True)):
            n = int(f.sum())
            p.lone[np.flatnonzero(f)[lone[at : at + n]]] = True
            at += n
            self.dead[k] += p.dead(self.window)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that no round ruled out: two hashes of each, its document's row, its place there and its first word's id."""
        got = []
        for c, p, dead in zip(self.chunks, self.parses, self.dead, strict=True):
            at = gram_places(c.bounds, self.window)
            if not len(at):
                continue
            long = np.cumsum(np.cumsum(p.runs) > 0)
            at = at[(dead[at] == 0) | (long[at + self.window - 1] > np.where(at, long[at - 1], 0))]
            one, two = gram_hashes(c.hashes, self.window), gram_hashes(mix(c.hashes ^ _U(0x2545F4914F6CDD1D)), self.window)
            row = np.searchsorted(c.bounds, at, "right") - 1
            got.append((one[at], two[at], c.first + row, at - c.bounds[row]))
        if not got:
            none = np.empty(0, np.int64)
            return none.view(_U), none.view(_U), none, none, none
        one, two, row, place = (np.concatenate(x) for x in zip(*got, strict=True))
        return one, two, row, place, self.ids[row]


def _least(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows: the first place of each distinct one in the order of their hashes, the number of each one's distinct window, and the distinct ones' least documents."""
    order = np.lexsort((two, one))
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]) if len(order) else np.empty(0, bool)
    first = np.flatnonzero(new)
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return order[first], code, np.minimum.reduceat(doc[order], first) if len(order) else doc


def _ends(name: np.ndarray, groups: int) -> np.ndarray:
    """Where each group's names end in a list that is in order; groups are equal ranges of the names."""
    return np.searchsorted(name >> _U(32), (np.arange(groups + 1, dtype=np.float64) * (2**32 / groups)).astype(np.int64).astype(_U))


def _key(doc_id: str, text: str) -> F.Column:
    """Rows of equal id and text lose the same words."""
    return row_key(F.col(doc_id).cast("long"), F.col(text))


def _pieces(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """piece, ids, keys, lengths and texts, compressed; equal rows of one batch are one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def full() -> pa.RecordBatch:
            nonlocal count, held, size
            texts = [t for x in held for t in x[2]]
            out = {"piece": pa.array([part | count], pa.int64()), "ids": pa.array([np.concatenate([x[0] for x in held])], pa.list_(pa.int64())), "keys": pa.array([np.concatenate([x[1] for x in held])], pa.list_(pa.int64()))}
            out |= {"lengths": pa.array([list(map(len, texts))], pa.list_(pa.int32())), "texts": pa.array([squeeze.compress(b"".join(texts))], pa.binary())}
            count, held, size = count + 1, [], 0
            return pa.RecordBatch.from_pydict(out)

        for b in slices(batches, 1, PIECE_BYTES // 4):
            _, once = np.unique(b.column(2).to_numpy(), return_index=True)
            b = b.take(pa.array(np.sort(once)))
            texts = pc.fill_null(b.column(1), "").cast(pa.binary()).to_pylist()
            held.append((b.column(0).fill_null(_NULL).to_numpy(), b.column(2).to_numpy(), texts))
            size += sum(map(len, texts))
            if size >= PIECE_BYTES * 3 // 4:
                yield full()
        if held:
            yield full()

    return docs.select(F.col(doc_id).cast("long"), F.col(text), _key(doc_id, text)).mapInArrow(pack, "piece long, ids array<long>, keys array<long>, lengths array<int>, texts binary")


def _opened(b: pa.RecordBatch, r: int, window: int, answers: int) -> tuple[int, np.ndarray, Piece]:
    """A row of pieces: its number, its keys and its texts after the rounds to which it has answers."""
    piece, ids, keys, lengths, blob = (b.column(k)[r] for k in range(5))
    raw, ends = zstandard.ZstdDecompressor().decompress(blob.as_py()), np.cumsum(lengths.values.to_numpy())
    texts = [raw[e - n : e] for e, n in zip(ends.tolist(), lengths.as_py(), strict=True)]
    p = Piece(texts, ids.values.to_numpy(), window)
    for k in range(answers):
        names, _ = p.names()
        p.learn(_bits(b.column(5 + k)[r].as_py(), len(names)))
    return piece.as_py(), keys.values.to_numpy(), p


def _bits(answer: list[dict] | None, n: int) -> np.ndarray:
    """The answers of all groups, in the order of what was sent."""
    got = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in answer or ()]
    out = np.concatenate(got).astype(bool) if got else np.empty(0, bool)
    assert len(out) == n
    return out


_SENT = pa.schema([("grp", pa.int32()), ("piece", pa.int64()), ("blob", pa.binary())])


def _exchange(asked: DataFrame, ask: Callable, meet: Callable, groups: int) -> DataFrame:
    """piece and answer, an array of (grp, n, bits). ask: what a row sends, (piece, names in order, blob of a range of them); meet: from a group's blobs to the bits of each."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                piece, names, blob = ask(b, r)
                ends = _ends(names, groups)
                full = np.flatnonzero(np.diff(ends))
                for i in range(0, len(full), 1024):
                    rows = [(int(g), piece, blob(ends[g], ends[g + 1])) for g in full[i : i + 1024]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SENT.types, strict=True)], schema=_SENT)

    def reply(t: pa.Table) -> pa.Table:
        bits = meet(t["blob"].to_pylist())
        return pa.table({"piece": t["piece"], "grp": t["grp"], "n": pa.array([len(x) for x in bits], pa.int32()), "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})

    met = asked.mapInArrow(send, "grp int, piece long, blob binary").groupBy("grp").applyInArrow(reply, "piece long, grp int, n int, bits binary")
    return written(met.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("grp", "n", "bits"))).alias("answer")), "answers")


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int | None = None) -> DataFrame:
    """_k (the row's key by `_key`) and `starts`, little-endian uint32 first words of windows that start in a smaller document too."""
    rounds = rounds_of(window) if rounds is None else rounds
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n
    groups = max(parts(docs.sparkSession), -(-size // GROUP_BYTES))
    pieces = bucketed(_pieces(docs, doc_id, text), "pieces", "piece")  # rounds move answers, never texts

    def with_answers(answers: list[DataFrame]) -> DataFrame:
        out = pieces
        for k, a in enumerate(answers):
            out = out.join(a.withColumnRenamed("answer", f"answer{k}").hint("merge"), "piece", "left")
        return out.select("piece", "ids", "keys", "lengths", "texts", *[f"answer{k}" for k in range(len(answers))])

    def meet_names(blobs: list[bytes]) -> list[np.ndarray]:
        n = [int(np.frombuffer(x, np.int64, 1)[0]) for x in blobs]
        names = np.concatenate([np.frombuffer(x, _U, m, 8) for x, m in zip(blobs, n, strict=True)])
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, -1, 8 + 8 * m), count=m) for x, m in zip(blobs, n, strict=True)])
        _, code, count = np.unique(names, return_inverse=True, return_counts=True)
        shared = (count + np.bincount(code, weights=many)) > 1
        return np.split(shared[code], np.cumsum(n)[:-1])

    def meet_windows(blobs: list[bytes]) -> list[np.ndarray]:
        n = [len(x) // 24 for x in blobs]
        one, two, doc = (np.concatenate([np.frombuffer(x, t, m, 8 * m * k) for x, m in zip(blobs, n, strict=True)]) for k, t in enumerate((_U, _U, np.int64)))
        _, code, least = _least(one, two, doc)
        return np.split(least[code] < doc, np.cumsum(n)[:-1])

    answers: list[DataFrame] = []
    for k in range(rounds):

        def ask_names(b: pa.RecordBatch, r: int, k: int = k) -> tuple:
            piece, _, p = _opened(b, r, window, k)
            names, many = p.names()
            return piece, names, lambda i, j: np.int64(j - i).tobytes() + names[i:j].tobytes() + np.packbits(many[i:j]).tobytes()

        answers.append(_exchange(with_answers(answers), ask_names, meet_names, groups))

    def ask_windows(b: pa.RecordBatch, r: int) -> tuple:
        piece, _, p = _opened(b, r, window, rounds)
        one, two, _, _, doc = p.windows()
        at, _, least = _least(one, two, doc)
        one, two = one[at], two[at]
        return piece, one, lambda i, j: one[i:j].tobytes() + two[i:j].tobytes() + least[i:j].tobytes()

    answers.append(_exchange(with_answers(answers), ask_windows, meet_windows, groups))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                _, keys, p = _opened(b, r, window, rounds)
                one, two, row, place, doc = p.windows()
                at, code, least = _least(one, two, doc)
                gone = (doc > least[code]) | _bits(b.column(5 + rounds)[r].as_py(), len(at))[code] if len(at) else np.empty(0, bool)
                row, place = row[gone], place[gone]
                order = np.lexsort((place, row))
                row, place = row[order], place[order].astype(np.uint32)
                cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
                starts = [x.tobytes() for x in np.split(place, cut[1:])] if len(cut) else []
                yield pa.RecordBatch.from_arrays([pa.array(keys[row[cut]], pa.int64()), pa.array(starts, pa.binary())], ["_k", "starts"])

    return with_answers(answers).mapInArrow(mark, "_k long, starts binary").groupBy("_k").agg(F.first("starts").alias("starts"))


def kept_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False, untouched: bool = False, rounds: int | None = None) -> DataFrame:
    """Every row with n_words, n_removed and kept_text, the words left joined by single blanks.

    digest: only doc_id and the SHA-256 of kept_text. untouched: texts that lose nothing keep their white space.
    """
    hits = written(repeats(docs, doc_id=doc_id, text=text, window=window, rounds=rounds), "repeats", keep=True)
    kept = "kept_sha256" if digest else "kept_text"
    rest = [doc_id] if digest else [c for c in docs.columns if c not in (text, "n_words", "n_removed", kept)]
    rows = packed_rows(docs.select(*[quoted(c) for c in docs.columns]), quoted(text).alias("text"), _key(doc_id, text).alias("_k"), without=tuple(c for c in docs.columns if c not in rest))
    joined = rows.hint("merge").join(hits, "_k", "left").select("row", "text", "starts")
    schema = StructType([joined.schema["row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField(kept, StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = buffers(b.column(1))
            raw, out = data.tobytes(), []
            for i, blob in enumerate(b.column(2).to_pylist()):
                w = raw[offsets[i] : offsets[i + 1]].split()
                n = len(w)
                if blob:
                    mark = np.zeros(n + 1, np.int64)
                    at = np.frombuffer(blob, np.uint32).astype(np.int64)
                    mark[at] += 1
                    np.subtract.at(mark, at + window, 1)
                    w = list(compress(w, (np.cumsum(mark)[:-1] == 0).tolist()))
                left = raw[offsets[i] : offsets[i + 1]] if untouched and len(w) == n else b" ".join(w)
                out.append((n, n - len(w), hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["row", "n_words", "n_removed", kept])

    return joined.mapInArrow(cut, schema).select("row.*", "n_words", "n_removed", kept)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_texts(table(spark, sf_dir, "documents"), digest=True)


_WORDS = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) i FROM d WHERE len(w) >= 13)),
m AS (SELECT h, min(doc_id) least FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) p FROM g JOIN m USING (h) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) word, unnest(generate_series(1, len(w))) p FROM d),
kept AS (SELECT doc_id, count(*) n, string_agg(word, ' ' ORDER BY p) t FROM words LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
