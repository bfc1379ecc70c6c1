"""Near-duplicate groups by min-max hashing, banding and exact confirmation.

Method: each of `PERMUTATIONS` hash functions gives a document two signature values, its smallest and its
largest, so half the hash evaluations make a signature. Bands of six values (three functions) propose
pairs; the sets of every proposed pair are compared in full. A pair of long texts at similarity 0.8 is missed by all 46 bands
with probability 1e-6, one at 0.9 with less than 1e-15; of a pair of five shingles in all, four of them shared, the two values depend
on each other and the probability is 1.4e-5. Sets too different in size to be linked do not share buckets.

Documents with the same words are joined first. In the first round one member of each bucket, the pivot, is compared
with the others: the one that shares its buckets with most texts, so a group of copies costs a comparison for each copy
and not for each pair. In the second, members of one bucket that are not yet in one component are compared with each other. In buckets of
more than `SMALL` rows that is done by an exact prefix filter with a positional bound instead, which proposes every pair that can
reach the threshold and few others, so no link is lost.

Cases: null texts and texts without words have n_shingles 0 and stay alone; texts of one to three words
have one shingle, their whole sequence; repeated rows of a doc_id each get a row, and its texts are linked one by one if they differ; rows of null doc_id are kept,
alone; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .components import stars
from .words import LOWER, NON_SPACE, Chunk, chunks, gram_hashes, gram_places, mix

SHINGLE = 4
BANDS = 46
#: Hash functions in a band; each gives two of its values.
PER_BAND = 3
PERMUTATIONS = BANDS * PER_BAND
#: Similarity of linked documents, as a fraction.
THRESHOLD = (80, 100)
#: Rows of a bucket that may all be compared; of larger ones the prefix filter makes new buckets after the first round.
SMALL = 32

_RNG = np.random.default_rng(77003)
_XOR = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
_ODD = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles, and bounds of the rows in them; rows of fewer than n words have one."""
    at = gram_places(c.bounds, n)
    hashes = gram_hashes(c.hashes, n)
    count = np.diff(c.bounds)
    sizes = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(bounds[-1], np.uint64)
    whole = np.repeat(count >= n, sizes)
    out[whole] = hashes[at] if len(at) else 0
    for r in np.flatnonzero((count > 0) & (count < n)):
        out[bounds[r]] = gram_hashes(c.hashes[c.bounds[r] : c.bounds[r + 1]], int(count[r]))[0] ^ np.uint64(count[r])
    return out, bounds


def distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, as one mixed value each, and their rows."""
    mixed = mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
    value, at = np.unique(mixed, return_index=True)
    return value, row[at]


def sequence_keys(c: Chunk) -> np.ndarray:
    """Two hashes of each row's whole word sequence; zeros without words."""
    keys = np.zeros((2, c.rows), np.uint64)
    if len(c.hashes):
        full = np.flatnonzero(np.diff(c.bounds))
        place = np.arange(len(c.hashes)) - np.repeat(c.bounds[:-1], np.diff(c.bounds))
        for k, salt in enumerate((0x1B873593, 0x2545F4914F6CDD1D)):
            keys[k, full] = np.add.reduceat(mix(mix(c.hashes + np.uint64(salt)) + place.astype(np.uint64)), c.bounds[:-1][full])
    return keys.view(np.int64)


def hashed(rows: DataFrame) -> DataFrame:
    """Rows (id, text) with k1 and k2, the hashes of the text's word sequence."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), NON_SPACE, LOWER):
                keys = sequence_keys(c)
                part = b.slice(c.first, c.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys[0]), pa.array(keys[1])], ["id", "text", "k1", "k2"])

    return rows.mapInArrow(add, "id long, text string, k1 long, k2 long")


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """doc_id, n (size of the shingle set), k1 and k2 (hashes of the word sequence) and the bands' hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), NON_SPACE, LOWER):
                h, bounds = shingles(c, shingle)
                row = np.repeat(np.arange(c.rows), np.diff(bounds))
                n = np.bincount(distinct(h, row)[1], minlength=c.rows) if len(h) else np.zeros(c.rows, np.int64)
                full = np.flatnonzero(np.diff(bounds))
                first = bounds[:-1][full]
                bands = np.zeros((len(full), BANDS), np.uint64)
                v = np.empty_like(h)
                for j in range(PERMUTATIONS if len(full) else 0):
                    np.bitwise_xor(h, _XOR[j], out=v)
                    np.multiply(v, _ODD[j], out=v)
                    band = bands[:, j // PER_BAND]
                    np.copyto(band, mix(band * np.uint64(0xA0761D6478BD642F) + np.minimum.reduceat(v, first) + np.uint64(j)))
                    np.copyto(band, mix(band * np.uint64(0xE7037ED1A0B428DB) + np.maximum.reduceat(v, first)))
                keys = sequence_keys(c)
                signed = bands.view(np.int64)
                sizes = np.zeros(c.rows, np.int64)
                sizes[full] = BANDS
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.first, c.rows), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed.reshape(-1)))],
                    ["doc_id", "n", "k1", "k2", "bands"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(sign, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose whole shingle sets are as similar as the threshold asks."""
    up, down = threshold

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = 256
            for first in range(0, b.num_rows, step):
                part = b.slice(first, step)
                sets = []
                for column in (2, 3):
                    value, row = [], []
                    for c in chunks(part.column(column), NON_SPACE, LOWER):
                        h, bounds = shingles(c, shingle)
                        v, r = distinct(h, np.repeat(np.arange(c.rows), np.diff(bounds)) + c.first)
                        value.append(v)
                        row.append(r)
                    sets.append((np.concatenate(value), np.concatenate(row)))
                (va, ra), (vb, rb) = sets
                _, ia, _ = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
                both = np.bincount(ra[ia], minlength=part.num_rows)
                union = np.bincount(ra, minlength=part.num_rows) + np.bincount(rb, minlength=part.num_rows) - both
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array((down * both >= up * union) & (union > 0)))

    left, right = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    joined = left.join(pairs, "a").join(right, "b")  # pairs and texts are tables whose sizes are known
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def prefix_buckets(texts: DataFrame, members: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """Buckets (bucket, rep, n, pos) of members (rep, n) by the shingles of their prefixes, which linked texts must share.

    A text's shingles are ordered by how many members have them, rarest first. Two sets that are similar enough
    share one of their first n - ceil(t n) + 1 shingles; those that no other member has count, but need no bucket.
    pos is the shingle's place in the order: at the first one that two sets share, what comes after bounds their overlap.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), NON_SPACE, LOWER):
                h, bounds = shingles(c, shingle)
                row = np.repeat(np.arange(c.rows), np.diff(bounds))
                _, at = np.unique(mix(h ^ mix(row.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))), return_index=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.rows).take(pa.array(row[at])), pa.array(h[at].view(np.int64))], ["rep", "gram"])

    up, down = threshold
    rows = written(members.join(texts, "rep").select("rep", "text").mapInArrow(spell, "rep long, gram long"), "grams")
    held = rows.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")
    common = rows.hint("merge").join(held, "gram").withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("held", "gram"))).withColumn("c", F.count("*").over(Window.partitionBy("rep")))
    prefix = F.col("n") - F.ceil(F.col("n") * up / down) + 1
    kept = common.hint("merge").join(members, "rep").where(F.col("i") + F.col("n") - F.col("c") <= prefix)
    size = F.floor(F.log("n") / F.log(F.lit(down / up)) + 1e-9).cast("int")
    pos = (F.col("i") + F.col("n") - F.col("c")).alias("pos")
    return kept.select("rep", "n", "gram", pos, F.explode(F.array(size, size + 1)).alias("size")).select(F.xxhash64("gram", "size", F.lit(1)).alias("bucket"), "rep", "n", "pos")


def open_buckets(live: DataFrame, tied: DataFrame) -> DataFrame:
    """Rows of buckets in which more than one component is left, with their components as label and the bucket's size."""
    at = live.hint("merge").join(tied.select(F.col("a").alias("rep"), F.col("b").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = at.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("held")).where("x < y").select("bucket", "held")
    return written(at.hint("merge").join(mixed, "bucket").select("bucket", "rep", "n", "pos", "label", "held"), "open")


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    signed = written(signatures(docs, doc_id, text, shingle), "signatures")
    # a text is known by a hash of its words, not by a doc_id: one id may have several texts
    same = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    same = written(same.withColumnRenamed("k1", "rep"), "texts")
    rows = same.select("rep", "n", F.explode("bands").alias("band"))
    shared = written(rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band"), "shared")
    up, down = threshold
    # linked sets differ in size by the threshold at most, so they share a size class or have neighbouring ones
    size = F.floor(F.log("n") / F.log(F.lit(down / up)) + 1e-9).cast("int")
    members = rows.hint("merge").join(shared, "band").select(F.explode(F.array(size, size + 1)).alias("size"), "band", "rep", "n")
    held = written(members.select(F.xxhash64("band", "size").alias("bucket"), "rep", "n"), "held")
    # a text that shares its buckets with many is likely to be linked to many: it becomes a pivot first
    sizes = written(held.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "sizes")  # written, so that a large bucket's join can be split
    fame = held.hint("merge").join(sizes, "bucket").groupBy("rep").agg(F.sum("c").alias("fame"))
    live = written(held.hint("merge").join(fame, "rep").select("bucket", "rep", "n", (-F.col("fame")).alias("turn")), "buckets")
    wanted = live.select("rep").distinct()
    # of each text wanted, one row that holds it
    holders = written(same.hint("merge").join(wanted, "rep", "left_semi").select(F.col("least").alias("id"), F.col("rep").alias("k1"), "k2"), "holders")
    held_by = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).hint("merge").join(holders.select("id").distinct(), "id", "left_semi")
    texts = written(hashed(held_by).hint("merge").join(holders, ["id", "k1", "k2"]).dropDuplicates(["k1"]).select(F.col("k1").alias("rep"), "text"), "members")
    first = live.groupBy("bucket").agg(F.min(F.struct("turn", "rep", "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
    pivots = written(first.select("bucket", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n")), "pivots")
    near = F.least("n", "pivot_n") * down >= F.greatest("n", "pivot_n") * up
    pairs = live.hint("merge").join(pivots, "bucket").where((F.col("rep") != F.col("pivot")) & near).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    tied = stars(confirmed(written(pairs, "pairs"), texts, shingle, threshold))
    rest = live.hint("merge").join(pivots.select("bucket", F.col("pivot").alias("rep")), ["bucket", "rep"], "left_anti")
    left = open_buckets(rest.withColumn("pos", F.lit(1).cast("long")), tied)
    crowd = written(left.where(F.col("held") > SMALL).select("rep", "n").distinct(), "crowd")
    left = left.where(F.col("held") <= SMALL).unionByName(open_buckets(prefix_buckets(texts, crowd, shingle, threshold), tied))
    # the overlap that the threshold asks for, against what is left of both sets from their places in the bucket's order
    other = left.select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("rep", "n", "pos", "label")])
    reach = (F.least(F.col("n") - F.col("pos"), F.col("other_n") - F.col("other_pos")) + 1) * (up + down) >= (F.col("n") + F.col("other_n")) * up
    pairs = left.hint("merge").join(other, "bucket").where((F.col("rep") < F.col("other_rep")) & (F.col("label") != F.col("other_label")) & reach).select(F.col("rep").alias("a"), F.col("other_rep").alias("b")).distinct()
    tied = stars(tied.unionByName(confirmed(written(pairs, "pairs"), texts, shingle, threshold)))
    joined = same.select("rep", "k2", "least").hint("merge").join(tied.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").select(F.col("rep").alias("k1"), "k2", "least", F.coalesce("root", "rep").alias("root"))
    joined = written(joined, "rooted")
    least = written(joined.groupBy("root").agg(F.min("least").alias("label")), "labels")
    groups = joined.hint("merge").join(least, "root").select("k1", "k2", "label")
    out = signed.select("doc_id", "n", "k1", "k2").hint("merge").join(groups, ["k1", "k2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("label")).alias("component_id"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


_WORDS = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id a, doc_id b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_shingles, c component_id, d.doc_id = c kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a doc_id, min(b) c FROM r GROUP BY a) USING (doc_id)
"""
