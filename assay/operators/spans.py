"""Spans, byte windows and their metrics, signatures and thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions import fixed, text


def segments(corpus: DataFrame) -> DataFrame:
    """Spans between blank lines: path, line_number and text; lines keep their indent in code, lose it elsewhere."""
    rows = corpus.select("path", "source_type", F.posexplode(text.lines(F.col("content"))).alias("line", "raw"))
    code = F.col("source_type").isin("code", "test")
    rows = rows.withColumn("line_text", F.when(code, F.rtrim("raw")).otherwise(F.trim("raw")))
    blank = (F.trim("raw") == "").cast("int")
    rows = rows.withColumn("island", F.sum(blank).over(Window.partitionBy("path").orderBy("line")))
    kept = rows.where(F.trim("raw") != "").groupBy("path", "island").agg(F.min("line").alias("first"), F.array_sort(F.collect_list(F.struct("line", "line_text"))).alias("l"))
    return kept.select("path", (F.col("first") + 1).alias("line_number"), F.array_join(F.transform("l", lambda x: x["line_text"]), "\n").alias("text"))


def span_ids(spans: DataFrame) -> DataFrame:
    return spans.withColumn("span_id", F.sha2(F.concat_ws(":", "path", "line_number", "text"), 256))


def occurrences(spans: DataFrame) -> DataFrame:
    """How often each normalized text occurs among all spans; counted before the shuffle, no span list is kept."""
    return spans.withColumn("norm", text.normalized(F.col("text"))).groupBy("norm").agg(F.count("*").alias("occurrences"))


#: Bytes of texts whose windows are cut at a time: what a task holds does not grow with its batches.
SLICE_BYTES = 1 << 20


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts in slices of about `SLICE_BYTES`, nulls as empty ones: first and last row, where each begins among the slice's bytes, and the bytes."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, a = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, "right")) - 1)
        yield a, b, at[a : b + 1] - at[a], data[at[a] : at[b]]
        a = b


def _cut(at: np.ndarray, raw: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts that lie one after the other: whose they are, their number in the text, first and last byte, and the share of bit changes in them."""
    size = np.diff(at)
    plain = np.where(size > 0, np.maximum(size - width, 0) // stride + 1, 0)
    n = plain + ((size > width) & ((plain - 1) * stride + width < size))
    of = np.repeat(np.arange(len(size)), n)
    index = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = at[of] + np.where(index < plain[of], index * stride, size[of] - width)
    end = np.minimum(start + width, at[of + 1])
    # changes between the bits of a byte, and between a byte's last and the next one's first
    inner = np.concatenate([[0], np.cumsum(np.bitwise_count((raw ^ raw >> 1) & 0x7F), dtype=np.int64)])
    across = np.concatenate([[0, 0], np.cumsum((raw[:-1] & 1) != raw[1:] >> 7, dtype=np.int64)])
    changes = inner[end] - inner[start] + across[end] - across[start + 1]
    return of, index, start, end, changes / (8 * (end - start) - 1)


def windows(df: DataFrame, key: str, content: str, width: int = fixed.WINDOW_BYTES, stride: int = fixed.STRIDE_BYTES) -> DataFrame:
    """Byte windows with coverage of the tail: key, window_index, byte_start, byte_end, the characters char_start to char_end that they begin and end in, and the metrics of their bits.

    entropy is that of the share of ones, rupture the share of bit changes; coherence and stability are what they leave of 1.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, _, at, raw in _slices(b.column(1)):
                of, index, start, end, rupture = _cut(at, raw, width, stride)
                if not len(of):
                    continue
                ones = np.concatenate([[0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)])
                p = (ones[end] - ones[start]) / (8 * (end - start))
                with np.errstate(divide="ignore", invalid="ignore"):
                    entropy = np.minimum(np.nan_to_num(-(p * np.log2(p) + (1 - p) * np.log2(1 - p))), 1.0)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin in the bytes before
                from_, places = at[of], (pa.int32(),) * 4
                cols = (start - from_, end - from_, chars[start] - chars[from_], chars[end] - chars[from_])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(a + of)), pa.array(index, pa.int32()), *map(pa.array, cols, places), pa.array(entropy), pa.array(1 - entropy), pa.array(1 - rupture), pa.array(rupture)],
                    [key, "window_index", "byte_start", "byte_end", "char_start", "char_end", "entropy", "coherence", "stability", "hazard"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInArrow(cut, f"{key} {kind}, window_index int, byte_start int, byte_end int, char_start int, char_end int, entropy double, coherence double, stability double, hazard double")


def with_hazards(df: DataFrame, content: str, width: int = fixed.WINDOW_BYTES, stride: int = fixed.STRIDE_BYTES) -> DataFrame:
    """The rows with the hazards of their own windows, in order, as an array: nothing is shuffled to bring them together."""
    place = df.columns.index(content)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, at, raw in _slices(b.column(place)):
                of, _, _, _, rupture = _cut(at, raw, width, stride)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=last - first))])
                hazards = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rupture, pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.slice(first, last - first).columns, hazards], names=[*b.schema.names, "hazards"])

    return df.mapInArrow(add, df.select("*", F.array().cast("array<double>").alias("hazards")).schema)


def calmed(table: DataFrame, threshold: float) -> DataFrame:
    """Rows with hazards (an array) with their mean as hazard, the share of them at or under the threshold as coverage, and whether the hazard is calm."""
    n = F.size("hazards")
    hazard = F.round(F.aggregate("hazards", F.lit(0.0), lambda a, x: a + x) / n, 6)
    covered = F.round(F.size(F.filter("hazards", lambda x: F.round(x, 6) <= threshold)) / n, 6)
    out = table.select("*", F.when(n > 0, hazard).otherwise(1.0).alias("hazard"), F.when(n > 0, covered).otherwise(0.0).alias("coverage")).drop("hazards")
    return out.withColumn("calm", F.col("hazard") <= max(threshold, fixed.HAZARD_FLOOR))


def signature():
    part = lambda letter, c: F.concat(F.lit(letter), (F.rint(F.col(c) * 100) / 100).cast("string"))
    return F.concat_ws("_", part("c", "coherence"), part("s", "stability"), part("e", "entropy"))


def span_metrics(w: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Per key its windows' means, first signature and number; keys without windows (empty texts) have coherence and stability 0, entropy and hazard 1."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("coherence", "stability", "entropy", "hazard")]
    got = w.groupBy(key).agg(*means, F.min_by("signature", "window_index").alias("signature"), F.count("*").alias("n_windows"))
    return keys.select(key).hint("merge").join(got, key, "left").na.fill({"coherence": 0.0, "stability": 0.0, "entropy": 1.0, "hazard": 1.0, "n_windows": 0})


def signature_index(w: DataFrame, key: str) -> DataFrame:
    """Per signature: occurrences, hazard range and mean, and the first occurrence as prototype."""
    h = [F.round(f("hazard"), 6).alias(f"hazard_{n}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    first = F.min(F.struct(key, "window_index"))
    return w.groupBy("signature").agg(F.count("*").alias("occurrences"), *h, first[key].alias("prototype"), first["window_index"].alias("prototype_window"))


def hazard_threshold(w: DataFrame, percentile: float = fixed.HAZARD_PERCENTILE, n=None) -> DataFrame:
    """The value at place floor(p (n - 1)) of all sorted hazards, from counts of the few distinct values; n: how to count rows that stand for several."""
    counts = w.groupBy("hazard").agg((F.count("*") if n is None else n).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("hazard"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return upto.where(F.col("upto") > F.floor(percentile * (F.col("all") - 1))).agg(F.round(F.min("hazard"), 6).alias("threshold"), F.max("all").alias("n_windows"))


def hazard_thresholds(w: DataFrame, key: str, percentile: float = fixed.HAZARD_PERCENTILE) -> DataFrame:
    """Per text the value at place floor(p (n - 1)) of its sorted hazards, and how many of its windows are at or under it: counts of distinct values, no global order."""
    by = Window.partitionBy(key)
    counts = w.groupBy(key, "hazard").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(by.orderBy("hazard"))).withColumn("all", F.sum("n").over(by))
    last = upto.where(F.col("upto") > F.floor(percentile * (F.col("all") - 1))).groupBy(key).agg(F.min(F.struct("hazard", "upto")).alias("m"), F.max("all").alias("n_windows"))
    return last.select(key, F.round("m.hazard", 6).alias("threshold"), F.col("m.upto").alias("n_calm"), "n_windows")


def coverage(w: DataFrame, limit: DataFrame, key: str) -> DataFrame:
    """Per span: share of windows at or under the threshold (a one-row table)."""
    return w.join(F.broadcast(limit.select("threshold").limit(1)), how="cross").groupBy(key).agg(F.round(F.avg((F.round("hazard", 6) <= F.col("threshold")).cast("double")), 6).alias("coverage"), F.count("*").alias("n_windows"))


def verified(w: DataFrame, index: DataFrame, limit: float, key: str) -> DataFrame:
    """External texts against an index: share of windows whose signature is known, share known and safe."""
    known = w.hint("merge").join(index.select("signature", "occurrences", "hazard_min"), "signature", "left")
    hit = F.col("occurrences").isNotNull()
    safe = hit & (F.col("hazard_min") <= limit)
    return known.groupBy(key).agg(F.count("*").alias("n_windows"), F.round(F.avg(hit.cast("double")), 6).alias("match_ratio"), F.round(F.avg(safe.cast("double")), 6).alias("coverage")).withColumn("verified", F.col("coverage") >= fixed.COVERAGE_MIN)
