"""Hashed vectors, planned queries and the fusion of hits."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions import paths, text
from assay.sources.tables import sized


#: Added before rounding, so that sums of rounded values do not sit on a rounding boundary.
TIE = 1e-9


def bucket(token):
    """One of 256 buckets: the first byte of the token's MD5."""
    return F.conv(F.left(F.md5(token), F.lit(2)), 16, 10).cast("int")


def vectors(df: DataFrame, key: str, content) -> DataFrame:
    """key, bucket, weight: token counts by bucket, of length one."""
    counts = text.token_rows(df, content, key).groupBy(key, bucket(F.col("token")).alias("bucket")).agg(F.count("*").alias("c"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norm, key).select(key, "bucket", (F.col("c") / F.col("norm")).alias("weight"))


def cosines(corpus: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, path, cosine; the requests' vectors are broadcast only if they are few."""
    q = vectors(requests, "request_id", F.col("query")).withColumnRenamed("weight", "q")
    d = vectors(corpus, "path", F.col("content"))
    dots = d.join(sized(q), "bucket").groupBy("request_id", "path").agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))
    return dots.select("request_id", "path", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dot"))), 6).alias("score"))


def fused(hits: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """Hits to one row for each path: noisy-or of weighted scores, plus boosts; the best hit, verified ones first, gives snippet and line."""
    weighted = F.round(F.least(F.lit(1.0), F.col("score") * F.col("weight")) + TIE, 6)
    best = F.max(F.struct("verified", "w", (-F.col("plan")).alias("p"), (-F.col("line_number")).alias("l"), "snippet"))
    out = hits.withColumn("w", weighted).groupBy("request_id", "path", "source_type").agg(F.round(1 - F.product(1 - F.col("w")) + TIE, 6).alias("score"), F.bool_or("verified").alias("verified"), best.alias("b"))
    out = out.select("request_id", "path", "source_type", "score", "verified", F.col("b.snippet").alias("snippet"), (-F.col("b.l")).alias("line_number"))
    if boosts is not None:
        most = boosts.groupBy("request_id", "path").agg(F.max("boost").alias("boost"))
        out = out.hint("merge").join(most, ["request_id", "path"], "left").withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + F.coalesce("boost", F.lit(0.0))), 6)).drop("boost")
    return out


def ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(F.desc("verified"), F.desc("score"), "path")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def planned_queries(requests: DataFrame) -> DataFrame:
    """Each request's queries: its own (weight 1), and of the words of its first four changed paths a test query (0.75) and, if one is a component, a component query (0.65)."""
    first = F.slice("changed_paths", 1, 4)
    words = F.slice(F.array_distinct(F.flatten(F.transform(first, paths.anchor_words))), 1, 8)
    front = F.exists(first, lambda p: p.rlike(r"\.(jsx|tsx)$"))
    plan = lambda i, q, w, s: F.struct(F.lit(i).alias("plan"), q.alias("query"), F.lit(w).alias("weight"), F.lit(s).alias("support_only"))
    query = lambda *last: F.array_join(F.concat("words", F.array(*[F.lit(x) for x in last])), " ")
    rows = requests.select("request_id", "query", words.alias("words"), front.alias("front"))
    test = F.when(F.size("words") > 0, plan(1, query("test", "regression", "spec"), 0.75, True))
    part = F.when((F.size("words") > 0) & F.col("front"), plan(2, query("component", "render", "test"), 0.65, True))
    return rows.select("request_id", F.explode(F.array_compact(F.array(plan(0, F.col("query"), 1.0, False), test, part))).alias("p")).select("request_id", "p.*")
