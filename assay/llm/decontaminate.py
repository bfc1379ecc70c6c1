"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Method: every window of an item is a set of word shingles, ordered by their rarity over all documents.
A document that contains the window must contain its rarest shingle (the prefix that containment 1.0
makes necessary), so windows and documents are joined on that shingle alone. The shingle's place fixes where the window
would have to start (positional bound) and whether it fits in the document (length bound); the few places
left are verified word by word, on the words themselves.

Scale: windows, counts, prefixes and candidates are tables of Spark jobs. One scan of the documents finds the places of
shingles that any item has, by a sieve of `SIEVE_BITS` bits made of the benchmark's shingles; its size is fixed, and what it lets through by
chance falls out in the join. The texts of documents that have candidates are read again to verify them. A shingle, window or document that many
rows share only ever meets the other side of a merge join, which can be split.

Cases: null texts and texts without words give zero counts; a null doc_id or item_id is kept as it is
(null items count as one item, "null"); repeated document rows each get their own row, equal ones the same; repeated items give
one id; an empty benchmark or corpus gives no hits or no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table, written
from .words import ALNUM, LOWER, Chunk, chunks, gram_hashes

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 3
#: Bits of the sieve, as a power of two.
SIEVE_BITS = 26
#: Documents with candidates whose keys may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _spelled(c: Chunk, at: int, n: int, raw: bytes) -> bytes:
    return b" ".join(raw[s:e] for s, e in zip(c.starts[at : at + n].tolist(), c.ends[at : at + n].tolist(), strict=True))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, words (a window's, joined by blanks), n, and its shingles as arrays of hashes; items: item_id and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), ALNUM, LOWER):
                raw, rows = c.data.tobytes(), []
                for i in range(c.rows):
                    a, z = int(c.bounds[i]), int(c.bounds[i + 1])
                    n = min(z - a, window)
                    k = min(n, SHINGLE)
                    g = gram_hashes(c.hashes[a:z], k) if n else None
                    rows += [(c.first + i, _spelled(c, s, n, raw), n, g[s - a : s - a + n - k + 1].view(np.int64)) for s in range(a, z - n + 1 if n else a)]
                at, words, n, g = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.binary()), pa.array(n, pa.int32()), pa.array(list(g), pa.list_(pa.int64()))], ["item_id", "words", "n", "grams"])

    return items.mapInArrow(cut, "item_id string, words binary, n int, grams array<long>")


def _sieve(grams: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value that the leading bits of the grams take; of fixed size, whatever their number."""
    x = F.shiftrightunsigned("gram", 64 - bits) + 1
    rows = grams.select(F.bitmap_bucket_number(x).alias("bucket"), F.bitmap_bit_position(x).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(max(1 << bits, 1 << 15), bool)
    for r in rows.toLocalIterator():
        out[(r.bucket - 1) << 15 : r.bucket << 15] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    return np.packbits(out)


def _scan(docs: DataFrame, sieve, bits: int, sizes: list[int]) -> DataFrame:
    """key, doc_id, n_words and the places (first words) and hashes of shingles that pass the sieve; docs: key, doc_id, text."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(sieve.value).astype(bool)
        for b in batches:
            for c in chunks(b.column(2), ALNUM, LOWER):
                at, gram = [], []
                for k in sizes:
                    g = gram_hashes(c.hashes, k)
                    hit = np.flatnonzero(held[g >> np.uint64(64 - bits)])
                    row = np.searchsorted(c.bounds, hit, "right") - 1
                    hit = hit[hit + k <= c.bounds[row + 1]]
                    at.append(hit)
                    gram.append(g[hit])
                at, gram = np.concatenate([np.empty(0, np.int64), *at]), np.concatenate([np.empty(0, np.uint64), *gram])
                order = np.argsort(at, kind="stable")
                at, gram = at[order], gram[order].view(np.int64)
                ends = pa.array(np.searchsorted(at, c.bounds).astype(np.int32))
                place = at - c.bounds[np.searchsorted(c.bounds, at, "right") - 1]
                part = b.slice(c.first, c.rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(c.bounds)), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(gram))], ["key", "doc_id", "n_words", "at", "grams"])

    return docs.mapInArrow(look, f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, at array<int>, grams array<long>")


def _verified(texts: DataFrame) -> DataFrame:
    """key, n_hit (words inside a verified window) and the windows found; texts: key, text and candidates (start, n, words)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), ALNUM, LOWER):
                raw, hits, found = c.data.tobytes(), [], []
                for i in range(c.rows):
                    covered, own = np.zeros(int(c.bounds[i + 1] - c.bounds[i]), bool), set()
                    for x in b.column(2)[c.first + i].as_py():
                        if _spelled(c, int(c.bounds[i]) + x["start"], x["n"], raw) == x["words"]:
                            covered[x["start"] : x["start"] + x["n"]] = True
                            own.add(x["words"])
                    hits.append(int(covered.sum()))
                    found.append(sorted(own))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.rows), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.binary()))], ["key", "n_hit", "found"])

    return texts.mapInArrow(check, "key long, n_hit long, found array<binary>")


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of an item's window) and the items found."""
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), F.col(item_text).alias("text"))
    own = written(item_windows(items, window), "windows")
    windows = own.dropDuplicates(["words"]).select("words", "n", "grams")
    shingles = written(windows.select("words", "n", F.posexplode("grams").alias("offset", "gram")), "shingles")
    sizes = [r.k for r in own.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect()]  # three rows at most
    sieve = spark.sparkContext.broadcast(_sieve(shingles, SIEVE_BITS))
    rows = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scan = written(_scan(rows, sieve, SIEVE_BITS, sorted(sizes)), "scan")
    places = scan.where(F.size("at") > 0).select("key", "n_words", F.explode(F.arrays_zip("at", "grams")).alias("p")).select("key", "n_words", "p.at", F.col("p.grams").alias("gram"))
    counts = written(places.groupBy("gram").agg(F.count("*").alias("held")), "counts")
    # a window of which any shingle has no count is in no document
    ranked = shingles.hint("merge").join(counts, "gram", "left")
    rarest = ranked.groupBy("words", "n").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "offset", "gram")).alias("r")).where("r.held > 0")
    prefixes = written(rarest.select("words", "n", F.col("r.offset").alias("offset"), F.col("r.gram").alias("gram")), "prefixes")
    start = F.col("at") - F.col("offset")
    near = places.hint("merge").join(prefixes, "gram").where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("key", start.alias("start"), "n", "words").distinct()
    # a document's candidates are bounded by its own words and the windows that share a prefix
    candidates = written(near.groupBy("key").agg(F.collect_list(F.struct("start", "n", "words")).alias("candidates")), "candidates")
    few = candidates.count() <= MOST_BROADCAST
    texts = rows.select("key", "text")
    if few:
        texts = texts.join(F.broadcast(candidates.select("key")), "key", "left_semi")
    verified = written(_verified(texts.hint("merge").join(candidates, "key").dropDuplicates(["key"]).select("key", "text", "candidates")).where("n_hit > 0"), "verified")
    names = verified.select("key", F.explode("found").alias("words")).hint("merge").join(own.select("words", "item_id").distinct(), "words")
    found = names.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = written(verified.select("key", "n_hit").hint("merge").join(found, "key"), "hits")
    out = scan.select("key", "doc_id", "n_words").hint("merge").join(hits, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> F.Column:
    """At least a twentieth of the words lie in benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') g
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
