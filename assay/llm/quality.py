"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Method: the units are code points and the order is four. Counts are taken over the trusted documents (labelled
of good quality and not toxic) but one in `HELD_OUT`. A gram of four code points is one long, sixteen bits for each, so contexts and
suffixes are shifts, and every level of the model is a table joined by its grams: raw counts at the highest order,
continuation counts below, three discounts for each order from its counts of counts. The probabilities are made
for all grams that any document has, joined back to the pieces of the corpus that hold them, and summed for each
document and each of its words. The thresholds are quantiles of trusted documents' scores in each language, of those that were held
out of the counts; where none was held out (a handful of trusted documents), of those that were counted.

Two scores are judged. `score` is the mean surprise in nats for each gram, drawn towards the language's trusted mean by `SHRINK` grams
so that a few words are not judged on chance; it is over its limit beyond the language's `QUANTILE` plus `SLACK` times the
distance from the language's mean. `worst` is the surprise of the document's least likely word of letters alone (numbers, addresses
and codes are no words here): a single word as trusted text never has it, an insult say, is lost in a mean. It is judged like the score, by its distance from
the language's mean, with `WORST_SLACK`. A document is rejected if either is over its limit.

A language's means and limits are drawn towards those of all languages together by the weight of `POOL` trusted documents, so that a
language of few trusted documents changes by degrees and one of none takes the common ones.

Scale: tasks send the distinct grams of a piece (about `PIECE_BYTES` of text) with counts, never the grams of
each document; the model's tables have a row for each distinct gram. Texts travel once, compressed; a longer text lies in several pieces,
whose grams overlap by three code points, and is summed up at the end.

Cases: null and empty texts score the language's mean and are kept; a null language is one of its own; labels of unknown documents,
null labels and repeated labels that disagree make nothing trusted; without trusted text all is kept with a null score;
repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, table, written
from .words import slices

ORDER = 4
PIECE_BYTES = 8_000_000
#: Trusted documents whose ids may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Bytes of text that a task turns into Python strings at once.
SLICE_BYTES = 2_000_000
#: Code points whose grams a task makes at once.
BLOCK_CHARS = 400_000
QUANTILE = 0.995
SLACK = 0.25
WORST_SLACK = 0.2
SHRINK = 60
#: Trusted documents of all languages together that count beside a language's own in its means and limits.
POOL = 20
#: Of so many trusted documents one is kept out of the counts, to set the thresholds.
HELD_OUT = 5
#: Scores are compared and counted in steps of this size.
STEP = 0.001


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point of sixteen bits: 1 for a letter, 2 for white space, 3 for digits, `@` and `_`, 0 for the rest."""
    out = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        out[i] = 1 if c.isalpha() else 2 if c.isspace() or i < 2 else 3 if c.isnumeric() or c in "@_" else 0
    return out


def _points(texts: list[str], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts and their bounds. ends: 1 if a text begins its document, plus 2 if it ends it.

    A beginning comes after three start marks (1), an end before an end mark (0); code points of more than sixteen bits share one place.
    """
    marked = [("\x01\x01\x01" if e & 1 else "") + t + ("\x00" if e & 2 else "") for t, e in zip(texts, ends, strict=True)]
    raw = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
    return np.where(raw > 0xFFFF, 0xFFFD, raw).astype(np.int64), bounds


def grams(texts: list[str], ends: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All grams of the texts as longs (as unsigned ones they are in order), the text of each and its last code point."""
    points, bounds = _points(texts, ends or [3] * len(texts))
    if len(points) < 4:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    g = (points[:-3] << 48) | (points[1:-2] << 32) | (points[2:-1] << 16) | points[3:]
    n = np.maximum(np.diff(bounds) - 3, 0)
    at = np.arange(n.sum()) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)
    return g[at], np.repeat(np.arange(len(texts)), n), points[at + 3]


def _worst(nats: np.ndarray, points: np.ndarray, text: np.ndarray, out: np.ndarray) -> None:
    """Raises `out` (by text) to the nats of each text's least likely word: letters between white space, with punctuation around them at most."""
    kind = _kinds()[points]
    inside = kind != 2
    edge = np.concatenate([[True], text[1:] != text[:-1]])
    start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | edge[1:]]))
    if not len(start):
        return
    end = np.minimum(np.append(start[1:], len(points)), _next(~inside | edge, start))
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    letters, numbers, sums = total(kind == 1), total(kind == 3), total(nats)
    place = np.arange(len(points))
    last = np.maximum.accumulate(np.where(kind == 1, place, -1))[end - 1] + 1
    ahead = np.where(kind == 1, place, len(points))
    first = np.minimum.accumulate(ahead[::-1])[::-1][start]
    ok = (last > first) & (letters[end] - letters[start] == last - first) & (numbers[end] == numbers[start])
    first, last = first[ok], last[ok]
    np.maximum.at(out, text[first], sums[np.minimum(last + 1, len(points))] - sums[first])


def _next(stop: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first place after each start where stop holds."""
    at = np.flatnonzero(stop)
    return np.append(at, len(stop))[np.searchsorted(at, start, "right")]


def _blocks(texts: list[str], ends: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams of some texts at a time, the place of each one's text and its last code point."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS or i == len(texts) - 1:
            g, text, points = grams(texts[first : i + 1], ends[first : i + 1])
            yield g, text + first, points
            first, size = i + 1, 0


def _pieces(docs: DataFrame) -> DataFrame:
    """Rows of texts, compressed, of about PIECE_BYTES each: piece, the rows' ids, numbers, languages and roles, and their texts' ends and lengths."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, number = TaskContext.get().partitionId() << 32, 0, 0
        squeeze = zstandard.ZstdCompressor(level=6)
        held: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            nonlocal held, size, piece
            cols = list(zip(*held, strict=True))
            out = {name: pa.array([cols[k]], pa.list_(kind)) for k, (name, kind) in enumerate(_ROW)}
            out["texts"] = pa.array([squeeze.compress("".join(cols[len(_ROW)]).encode("utf-8", "replace"))], pa.binary())
            held, size, piece = [], 0, piece + 1
            return pa.RecordBatch.from_pydict({"piece": pa.array([part | (piece - 1)], pa.int64())} | out)

        for b in batches:
            for part_ in slices(iter([b]), 3, SLICE_BYTES):
                for doc, lang, role, text, row in zip(*(c.to_pylist() for c in part_.columns), strict=True):
                    text, number = text or "", number + 1
                    cut = range(0, max(len(text), 1), PIECE_BYTES)
                    for a in cut:
                        t = text[max(a - 3, 0) : a + PIECE_BYTES]
                        ends = (a == 0) + 2 * (a == cut[-1])
                        held.append((doc, lang, role, row, part | number, ends, len(t), t))
                        size += len(t)
                        if size >= PIECE_BYTES:
                            yield full()
        if held:
            yield full()

    return docs.mapInArrow(pack, "piece long, ids array<long>, langs array<string>, roles array<int>, rows array<long>, numbers array<long>, ends array<int>, lengths array<int>, texts binary")


_ROW = (("ids", pa.int64()), ("langs", pa.string()), ("roles", pa.int32()), ("rows", pa.int64()), ("numbers", pa.int64()), ("ends", pa.int32()), ("lengths", pa.int32()))


def _texts(blob: bytes, lengths: list[int]) -> list[str]:
    whole = zstandard.ZstdDecompressor().decompress(blob).decode("utf-8")
    ends = np.cumsum(lengths).tolist()
    return [whole[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def _counted(pieces: DataFrame) -> DataFrame:
    """piece, gram and how often the piece's trusted texts have it, a row for each distinct gram of a piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                piece, roles, ends, lengths, blob = (b.column(k)[r].as_py() for k in range(5))
                good, held = np.array(roles) == 1, []
                for g, text, _ in _blocks(_texts(blob, lengths), ends):
                    code, names = pd.factorize(g)
                    held.append((names, np.bincount(code[good[text]], minlength=len(names))))
                names, code = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
                n = np.bincount(code, weights=np.concatenate([x for _, x in held]), minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(np.full(len(names), piece)), "gram": pa.array(names), "n": pa.array(n)})

    return pieces.select("piece", "roles", "ends", "lengths", "texts").mapInArrow(count, "piece long, gram long, n long")


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from how many grams have the counts one to four."""
    n = {r.c: r.n for r in counts.where("c BETWEEN 1 AND 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * after / now, 0.0), float(k)) if now else 0.5 * k for k, now, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _gram(k: int):
    """The last k code points of `gram` (all that is left of a gram of k)."""
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < ORDER else F.col("gram")


def _context():
    return F.shiftrightunsigned(F.col("gram"), 16)


def probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """gram and logp (nats) for each of the grams asked for; counts (gram, c): those of the training text."""
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: of how many grams a gram is the end
        tables[k] = written(tables[k + 1].select(_gram(k).alias("gram")).groupBy("gram").agg(F.count("*").alias("c")), "continuations")
    wanted = {ORDER: asked.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(_gram(k).alias("gram")).distinct()
    symbols = tables[1].count() + 1
    below = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(tables[k])
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).when(F.col("c") >= 3, d3).otherwise(0.0)
        of = tables[k].groupBy(_context().alias("context")).agg(F.sum("c").alias("total"), F.sum(discount).alias("spare"))
        level = wanted[k].hint("merge").join(tables[k], "gram", "left").withColumn("context", _context()).withColumn("shorter", _gram(k - 1) if k > 1 else F.lit(0))
        level = level.hint("merge").join(of, "context", "left")
        level = level.withColumn("q", F.lit(1.0 / symbols)) if below is None else level.hint("merge").join(below.select(F.col("gram").alias("shorter"), F.col("p").alias("q")), "shorter", "left")
        p = F.when(F.col("total") > 0, (F.greatest(F.coalesce("c", F.lit(0)) - discount, F.lit(0.0)) + F.col("spare") * F.col("q")) / F.col("total")).otherwise(F.col("q"))
        below = written(level.select("gram", p.alias("p")), "probabilities")
    return below.select("gram", F.log("p").alias("logp"))


def surprise(docs: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", row: str | None = None) -> DataFrame:
    """doc_id, row (the column of that name, a long), lang, role, n_grams, nats (the sum of surprise) and worst; trusted: doc_id of the trusted documents, role 1 if counted and 2 if held out."""
    ids = trusted.select(F.col(doc_id).cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(True))
    marks = docs.select(F.col(doc_id).cast("long").alias("doc_id")).distinct().hint("merge").join(ids, "doc_id", "left_semi").select("doc_id")
    trusted_ids = written(marks, "trusted")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"), (F.col(row) if row else F.lit(None).cast("long")).alias("row"))
    out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    role = F.when(F.col("trusted") & out, 2).when(F.col("trusted"), 1).otherwise(0)
    how = "broadcast" if trusted_ids.count() <= MOST_BROADCAST else "merge"
    joined = plain.join(trusted_ids.withColumn("trusted", F.lit(True)).hint(how), "doc_id", "left").select("doc_id", "lang", role.alias("role"), "text", "row")
    pieces = bucketed(_pieces(joined), "pieces", "piece")
    counted = written(_counted(pieces), "grams")
    asked = written(counted.groupBy("gram").agg(F.sum("n").alias("c")), "asked")
    logp = probabilities(asked.where("c > 0"), asked)
    answers = counted.select("piece", "gram").hint("merge").join(logp, "gram").groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("gram", F.col("logp").cast("float").alias("logp")))).alias("answers"))
    answers = answers.select("piece", F.col("answers.gram").alias("gram"), F.col("answers.logp").alias("logp"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, rows, langs, roles, numbers, ends, lengths, blob = (b.column(k)[r] for k in range(8))
                known = b.column(8)[r].values.to_numpy()
                value = b.column(9)[r].values.to_numpy()
                size = len(ids)
                nats, worst, n = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
                for g, text, points in _blocks(_texts(blob.as_py(), lengths.as_py()), ends.as_py()):
                    code, names = pd.factorize(g)
                    each = -value[np.searchsorted(known, names)][code].astype(np.float64)
                    nats += np.bincount(text, weights=each, minlength=size)
                    n += np.bincount(text, minlength=size)
                    _worst(each, points, text, worst)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.values, "row": rows.values, "lang": langs.values, "role": roles.values, "number": numbers.values, "whole": pa.array(np.array(ends.as_py()) == 3), "n_grams": pa.array(n), "nats": pa.array(np.round(nats, 3)), "worst": pa.array(np.round(worst, 3))})

    both = pieces.join(answers.hint("merge"), "piece").select("ids", "rows", "langs", "roles", "numbers", "ends", "lengths", "texts", "gram", "logp")
    found = written(both.mapInArrow(score, "doc_id long, row long, lang string, role int, number long, whole boolean, n_grams long, nats double, worst double"), "surprise")
    names = ["doc_id", "row", "lang", "role"]
    long = found.where("NOT whole").groupBy("number", *names).agg(F.sum("n_grams").alias("n_grams"), F.sum("nats").alias("nats"), F.max("worst").alias("worst"))
    return found.where("whole").select(*names, "n_grams", "nats", "worst").unionByName(long.drop("number"))


def thresholds(scored: DataFrame, quantile: float, by: list[str]) -> DataFrame:
    """The trusted documents' number and the quantiles of `over` and `worst_over`, exact to a step; only counts of steps meet."""
    at = lambda c, name: (F.percentile(F.floor(F.col(c) / STEP), F.lit(quantile)) * STEP + STEP).alias(name)
    return scored.where("trusted").groupBy(*by).agg(F.count("*").alias("n"), at("over", "limit"), at("worst_over", "worst_limit"))


def _pooled(own, n, common: float):
    """A language's value of n documents, drawn towards the common one; the common one where it has none."""
    return F.coalesce((n * own + POOL * F.lit(common)) / (n + POOL), F.lit(common))


def classified(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", row: str | None = None, quantile: float = QUANTILE) -> DataFrame:
    """Per row: doc_id, row if asked for (the column of that name, a long), n_grams, score, worst and kept."""
    names = ["doc_id", "row"] if row else ["doc_id"]
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"), F.count_if(F.col("quality").isNull()).alias("u"))
    trusted = agreed.where("q = 1 AND t = 0 AND u = 0")
    scored = surprise(docs, trusted.withColumnRenamed("doc_id", doc_id), doc_id=doc_id, text=text, lang=lang, row=row)
    scored = scored.withColumn("lang", F.coalesce("lang", F.lit("")))
    judges = 2 if not scored.where("role = 2").isEmpty() else 1
    scored = scored.withColumn("trusted", F.col("role") == judges)
    sums = [F.sum(c).alias(c) for c in ("nats", "n_grams", "worst")]
    mean = scored.where("trusted").groupBy("lang").agg(F.count("*").alias("docs"), *sums)
    every = mean.agg(*[F.sum(c).alias(c) for c in ("docs", "nats", "n_grams", "worst")]).first()
    if not every.docs:
        return scored.select(*names, "n_grams", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("worst"), F.lit(True).alias("kept"))
    centre, length = every.nats / every.n_grams, every.n_grams / every.docs
    means = mean.select("lang", _pooled(F.col("nats") / F.col("n_grams"), F.col("n_grams") / length, centre).alias("mean"), _pooled(F.col("worst") / F.col("docs"), F.col("docs"), every.worst / every.docs).alias("worst_mean"))
    s = scored.join(by_language(means), "lang", "left").na.fill({"mean": centre, "worst_mean": every.worst / every.docs})
    s = s.withColumn("score", F.when(F.col("n_grams") > 1, (F.col("nats") + SHRINK * F.col("mean")) / (F.col("n_grams") + SHRINK)).otherwise(F.col("mean")))
    s = s.withColumn("over", F.col("score") - F.col("mean")).withColumn("worst_over", F.col("worst") - F.col("worst_mean"))
    common = thresholds(s, quantile, []).first()
    limits = thresholds(s, quantile, ["lang"]).select("lang", *[_pooled(F.col(c), F.col("n"), common[c]).alias(c) for c in ("limit", "worst_limit")])
    done = s.join(by_language(limits), "lang", "left").na.fill({c: common[c] for c in ("limit", "worst_limit")})
    kept = (F.col("over") <= F.col("limit") * (1 + SLACK)) & (F.col("worst_over") <= F.col("worst_limit") * (1 + WORST_SLACK))
    return done.select(*names, "n_grams", F.round("score", 6).alias("score"), "worst", kept.alias("kept"))


#: Languages of which a table may be broadcast; more are joined by a shuffle.
MOST_LANGUAGES = 10_000


def by_language(rows: DataFrame) -> DataFrame:
    """A table with a row for each language, written and marked for the join that its size allows."""
    rows = written(rows, "languages")
    return rows.hint("broadcast" if rows.count() <= MOST_LANGUAGES else "merge")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
