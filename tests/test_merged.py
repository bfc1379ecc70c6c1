import random
import re

from pyspark.sql import functions as F

from assay.operators import merged, upkeep

SCHEMA = "id long, value string, extra string"


def rows(spark, *pairs):
    return spark.createDataFrame([(k, v, None) for k, v in pairs], SCHEMA)


def held(spark, base):
    return {r.id: r.value for r in merged.current(spark, base, "id").collect()}


def test_batches_against_a_dictionary(spark, tmp_path):
    base, want, rng = str(tmp_path / "t"), {}, random.Random(5)
    for step in range(9):
        if step % 4 == 3:
            gone = rng.sample(range(40), 8)
            merged.retract(spark.createDataFrame([(k,) for k in gone], "id long"), base, "id")
            want = {k: v for k, v in want.items() if k not in gone}
        else:
            batch = {rng.randrange(40): f"{step}" for _ in range(12)}
            merged.append(rows(spark, *batch.items()), base, "id", "value", parts=3)
            want |= batch
        if step in (4, 6, 8):
            merged.compact(spark, base, "id", 2)
    assert held(spark, base) == want
    runs = merged.live(spark, base).groupBy("part", "level").count().collect()
    assert all(r["count"] < 2 for r in runs) and max(r.level for r in runs) > 1
    swept = merged.swept(spark, base)
    assert swept and held(spark, base) == want and merged.swept(spark, base) == []


def test_lookup_reads_only_its_parts(spark, tmp_path):
    base = str(tmp_path / "t")
    merged.append(rows(spark, *[(i, str(i)) for i in range(200)]), base, "id", "value", parts=8)
    merged.append(rows(spark, (7, "new")), base, "id", "value")
    found = merged.lookup(spark.createDataFrame([(7,), (7,), (999,)], "id long"), base, "id")
    assert [(r.id, r.value) for r in found.collect()] == [(7, "new")]
    parts = {r.part for r in spark.createDataFrame([(7,), (999,)], "id long").select(merged.part_of(F.col("id"), 8).alias("part")).collect()}
    plan = merged.lookup(spark.createDataFrame([(7,), (999,)], "id long"), base, "id")._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[[^\]]*part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert filters and all({*(a or b).split(",")} <= {str(p) for p in parts} for a, b in filters), plan


def test_null_keys_repeats_and_empty_batches(spark, tmp_path):
    base = str(tmp_path / "t")
    merged.append(rows(spark), base, "id", "value", parts=2)
    assert merged.live(spark, base).count() == 0
    merged.append(rows(spark, (None, "a"), (None, "b"), (1, "x"), (1, "x"), (1, "w")), base, "id", "value", parts=2)
    assert held(spark, base) == {None: "a", 1: "w"}
    merged.append(rows(spark, (None, "c")), base, "id", "value")
    merged.compact(spark, base, "id", 2)
    assert held(spark, base) == {None: "c", 1: "w"}


def test_a_run_that_fails_counts_for_nothing(spark, tmp_path):
    base = str(tmp_path / "t")
    merged.append(rows(spark, (1, "a")), base, "id", "value", parts=2)
    bad = rows(spark, (1, "b"), (2, "b")).withColumn("part", F.lit(0)).withColumn("_gone", F.lit(False))
    bad.write.partitionBy("part").parquet(f"{base}/rows/run=2")  # its listing was never written
    assert held(spark, base) == {1: "a"} and upkeep.last_version(spark, f"{base}/live") == 1
    merged.append(rows(spark, (3, "c")), base, "id", "value")
    assert held(spark, base) == {1: "a", 3: "c"}


def test_before_the_first_batch(spark, tmp_path):
    assert merged.live(spark, str(tmp_path / "none")).count() == 0
    merged.compact(spark, str(tmp_path / "none"), "id")
