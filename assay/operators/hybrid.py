"""Hybrid search of many requests over the spans of a corpus.

A span is a paragraph or code block, or a document's path, kind and first eight lines. Every span that shares a token with a
planned query is a candidate (all spans are, of a query none of whose tokens occurs), scored on its whole text by shared 3-grams, hashed-vector cosine and
path words; `span_search` finds the best ones by an index. Lexical hits and those of spans are fused per path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import fixed, paths, text
from assay.operators import fusion, spans
from assay.sources.shared import written
from assay.sources.tables import sized


def span_table(corpus: DataFrame) -> DataFrame:
    """path, source_type, kind (0 for the summary), line_number, text and search_text of all spans."""
    found = spans.segments(corpus).withColumn("kind", F.lit(1))
    lines = F.filter(F.transform(text.lines(F.col("content")), lambda x, i: F.struct(F.trim(x).alias("t"), (i + 1).alias("i"))), lambda x: x["t"] != "")
    head = corpus.select("path", "source_type", lines.alias("l")).where(F.size("l") > 0)
    first = head.select("path", F.element_at("l", 1)["i"].alias("line_number"), F.concat_ws("\n", F.col("path"), F.col("source_type"), F.array_join(F.transform(F.slice("l", 1, 8), lambda x: x["t"]), "\n")).alias("text"), F.lit(0).alias("kind"))
    every = found.unionByName(first).withColumn("source_type", paths.source_type(F.col("path")))
    return every.withColumn("span", F.concat_ws("#", "path", "kind", "line_number")).withColumn("search_text", F.concat_ws(" ", "path", "source_type", "text"))


def indexed(corpus: DataFrame) -> DataFrame:
    """The spans with occurrences (of their normalized text), hazard, coverage, calm and a number: all that a search reads, to be written once."""
    table = written(spans.with_hazards(span_table(corpus).withColumn("norm", F.md5(text.normalized(F.col("text")))), "text"), "spans")
    limit = spans.hazard_threshold(table.select(F.explode("hazards").alias("hazard")))
    threshold = limit.first().threshold or 0.0
    facts = spans.calmed(table, threshold)
    counts = written(table.groupBy("norm").agg(F.count("*").cast("int").alias("occurrences")), "occurrences")
    out = facts.hint("merge").join(counts, "norm").drop("norm")
    near = out.repartitionByRange("path", "kind", "line_number").sortWithinPartitions("path", "kind", "line_number")  # spans of a path lie in one block
    return near.withColumn("id", F.monotonically_increasing_id())


def evaluated(best: DataFrame) -> DataFrame:
    """The spans with their retrieval score, whether they are verified, and a snippet."""
    pattern = 1 - F.col("hazard")
    score = F.least(F.lit(1.0), 0.45 * F.col("final") + 0.25 * F.col("coverage") + 0.15 * pattern + 0.15 * F.col("cosine"))
    ok = (F.col("coverage") >= fixed.COVERAGE_MIN) & F.col("calm") & ((F.col("cosine") >= fixed.SEMANTIC_MIN) | (pattern >= fixed.PATTERN_MIN))
    return best.withColumn("score", F.round(score + fusion.TIE, 6)).withColumn("verified", ok).withColumn("snippet", F.left(text.collapsed(F.col("text")), F.lit(240)))


def search(structural: DataFrame, lexical: DataFrame, planned: DataFrame, support: DataFrame, boosts: DataFrame, k: int) -> DataFrame:
    """request_id, path, source_type, score, verified, snippet, line_number and rank.

    structural and lexical: hits by request_id and plan with score, verified, snippet and line_number. Plans that are support-only keep
    hits on support paths (request_id, path) alone; lexical hits weigh 0.75 at most; boosts (request_id, path, boost) are added last.
    """
    columns = ["request_id", "plan", "path", "source_type", "score", "verified", "snippet", "line_number"]
    both = structural.select(*columns, F.lit(1.0).alias("most")).unionByName(lexical.select(*columns, F.lit(0.75).alias("most")))
    hits = both.join(sized(planned).select("request_id", "plan", "weight", "support_only"), ["request_id", "plan"]).withColumn("weight", F.least("weight", "most"))
    allowed = support.select("request_id", "path").distinct().withColumn("support", F.lit(True))
    hits = hits.hint("merge").join(allowed, ["request_id", "path"], "left").where("NOT support_only OR support").where("snippet <> ''")
    return fusion.ranked(fusion.fused(hits, boosts), k)
