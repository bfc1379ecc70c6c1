"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Method: rows are numbered, and belong to blocks by a hash of their number. How many rows of each block go to each shard is drawn
exactly from the multivariate hypergeometric law with the blocks' and the shards' sizes as margins. Each block
is permuted and its first rows go to shard 0, the next to shard 1 and so on, as the matrix says; after that exchange each
shard is permuted again. The law is `rows`: shard sizes are at most one apart.

Scale: the matrix has a row for each block of about `BLOCK_ROWS` rows (of more, where there are over `MOST_BLOCKS` such blocks); it is drawn on the driver from one
count for each block, written as a table and joined. Ranks are taken inside blocks, and inside strips of a shard that a second hash makes, never over a whole
shard. Numbers do not depend on what rows hold, so rows of null id or copies of one row crowd nowhere. The numbered rows are written
once, so that a lost executor does not number them anew; the exchange moves the columns that the caller asks for.

Cases: a null text has size 16 and the checksum of no bytes; rows of null id and repeated rows are placed like
others; an empty table gives no rows; other columns pass unchanged, and names that this operator uses (`shard`, `slot`) are
replaced. The order depends on the seed and on how the input is partitioned. Equal texts are not kept together: no uniform shuffle does that,
and a group that is larger than a shard could not be.
"""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed_rows, table, written

SHARDS = 40
SEED = 20240611
BLOCK_ROWS = 20_000
#: Blocks whose draws the driver makes; more rows make larger blocks.
MOST_BLOCKS = 1 << 16
#: Blocks whose draws may be broadcast.
MOST_BROADCAST = 10_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items, taken without return from good + bad ones, are good; by inversion from the mode."""
    from math import lgamma

    total = good + bad
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(max((draws + 1) * (good + 1) // (total + 2), lo), hi)
    ln = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    from math import exp

    p = exp(ln(good, mode) + ln(bad, draws - mode) - ln(total, draws))
    u = rng.random() - p
    if u <= 0:
        return mode
    up = down = mode
    p_up = p_down = p
    while up < hi or down > lo:  # outwards from the mode, one step to each side in turn
        if up < hi:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def matrix(blocks: dict[int, int], sizes: list[int], seed: int) -> dict[int, list[int]]:
    """Rows of each block for each shard; blocks: their sizes."""
    rng, left, out = random.Random(seed), list(sizes), {}
    for b in sorted(blocks):
        draws, rest, row = blocks[b], sum(left), []
        for j, n in enumerate(left):
            k = hypergeometric(rng, n, rest - n, draws)
            rest -= n
            draws -= k
            row.append(k)
            left[j] -= k
        out[b] = row
    return out


def sharded(df: DataFrame, *, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows with `shard` and `slot`: a uniform random order, cut into shards of sizes at most one apart."""
    spark = df.sparkSession
    numbered = written(packed_rows(df.drop("shard", "slot")).withColumn("_number", F.monotonically_increasing_id()), "numbered")
    n = numbered.count()
    blocks = min(max(1, -(-n // BLOCK_ROWS)), MOST_BLOCKS)
    draw = lambda k: F.xxhash64("_number", F.lit(seed + k))
    keyed = numbered.withColumn("_block", F.pmod(draw(0), F.lit(blocks)).cast("int"))
    held = {r._block: r["count"] for r in keyed.groupBy("_block").count().toLocalIterator()}
    drawn = matrix(held, [n // shards + (j < n % shards) for j in range(shards)], seed)
    # ends[j]: the rank in its block at which shard j's rows end
    rows = [(b, list(accumulate(r))) for b, r in drawn.items()]
    bounds = written(spark.createDataFrame(rows, "_block int, _ends array<int>"), "matrix")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy(draw(1), "_number")))
    placed = ranked.join(bounds.hint("broadcast" if blocks <= MOST_BROADCAST else "merge"), "_block").withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
    # the second permutation: by another hash, in strips so that no task ranks a whole shard
    strips = max(1, -(-n // (shards * BLOCK_ROWS)))
    placed = placed.withColumn("_again", draw(2)).withColumn("_strip", F.floor((F.shiftrightunsigned("_again", 32)) * F.lit(strips) / F.lit(1 << 32)).cast("int"))
    if strips == 1:
        slot = F.row_number().over(Window.partitionBy("shard").orderBy("_again", "_number")) - 1
        return placed.withColumn("slot", slot.cast("long")).select("row.*", "shard", "slot")
    counts = placed.groupBy("shard", "_strip").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = placed.withColumn("_in", F.row_number().over(Window.partitionBy("shard", "_strip").orderBy("_again", "_number")))
    out = inside.hint("merge").join(before, ["shard", "_strip"]).withColumn("slot", (F.col("_before") + F.col("_in") - 1).cast("long"))
    return out.select("row.*", "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharded(narrow).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
