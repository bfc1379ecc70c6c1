"""Evaluation: confusion metrics, rates by group, concentration, samples and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions import fixed, text
from assay.sources.shared import written


def rate(condition, of=None):
    """Share of rows (of those that `of` selects) for which a condition holds; 0 of none."""
    n = F.count("*") if of is None else F.count_if(of)
    return F.round(F.count_if(condition if of is None else condition & of) / F.greatest(F.lit(1), n), 4)


def confusion(results: DataFrame, *names: str) -> DataFrame:
    """results (should_admit, and by back-end its admission and, as <name>_hit, whether it found an expected path) to the rates of each back-end."""
    y, out = F.col("should_admit"), [F.count("*").alias("n"), F.count_if("should_admit").alias("positives")]
    for name in names:
        p = F.col(name)
        out += [rate(p == y).alias(f"{name}_accuracy"), rate(p, y).alias(f"{name}_true_admit"), rate(p, ~y).alias(f"{name}_false_admit")]
        if f"{name}_hit" in results.columns:
            out.append(rate(F.col(f"{name}_hit"), y).alias(f"{name}_path_hit"))
    return results.agg(*out)


def wins(results: DataFrame, one: str, two: str) -> DataFrame:
    """Cases that one back-end decides right and the other wrong."""
    right = lambda c: F.col(c) == F.col("should_admit")
    return results.where(right(one) != right(two)).select("case_id", F.when(right(one), one).otherwise(two).alias("winner"))


def focused(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request the structural rule's support and decision, over hits that share a focus word with the query.

    Focus words are the query's tokens without FOCUS_IGNORE. Admits on verified hits with a pull request and verified code at 0.38, on two verified
    code-like hits with a pull request at 0.42, or on a signature word and two verified hits at 0.45.
    """
    without = lambda c, words: F.array_except(c, F.array(*[F.lit(w) for w in words]))
    q = requests.select("request_id", without(F.array_distinct(text.tokens(F.col("query"))), fixed.FOCUS_IGNORE).alias("focus"))
    h = hits.hint("merge").join(q, "request_id").withColumn("tokens", text.tokens(F.concat_ws(" ", "path", "snippet"))).where(F.arrays_overlap("focus", "tokens"))
    h = h.withColumn("pr", F.col("source_type") == "pr").withColumn("place", F.row_number().over(Window.partitionBy("request_id", "pr").orderBy("rank")))
    plain = ~F.col("pr")
    code = plain & F.col("verified") & F.col("source_type").isin("code", "test", "runbook")
    got = h.groupBy("request_id").agg(
        F.round(F.coalesce(F.avg(F.when(plain & (F.col("place") <= 3), F.col("score"))), F.lit(0.0)) + 1e-9, 6).alias("support"), F.count_if(plain & F.col("verified")).alias("n_verified"), F.count_if(code).alias("n_code"),
        F.bool_or("pr").alias("any_pr"), F.bool_or(plain & F.arrays_overlap(without(F.col("focus"), fixed.SIGNATURE_IGNORE), F.col("tokens"))).alias("signature"),
    )
    s, pr = F.col("support"), F.col("any_pr")
    admit = ((F.col("n_verified") > 0) & pr & (F.col("n_code") > 0) & (s >= 0.38)) | ((F.col("n_code") >= 2) & pr & (s >= 0.42)) | (F.col("signature") & (F.col("n_verified") >= 2) & (s >= 0.45))
    out = requests.select("request_id").hint("merge").join(got.withColumn("admit", admit), "request_id", "left")
    return out.na.fill(0, ["support", "n_verified", "n_code"]).na.fill(False, ["admit"]).select("request_id", "support", "n_verified", "n_code", "admit")


def selected(instances: DataFrame, preferred: tuple[str, ...], *, pilot: bool, most: int | None = None, repos: int | None = None) -> DataFrame:
    """instances (repo, instance_id, has_test, n_paths) chosen: repositories by preference, size and name; of each its items with tests first, then fewer paths, then id.

    pilot takes one of each repository; otherwise repositories are taken whole, in order, until there are `most`.
    """
    order = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in preferred]), F.col("repo")).cast("int"), F.lit(0))
    sizes = instances.groupBy("repo").agg(F.count("*").alias("size")).withColumn("preference", F.when(order == 0, len(preferred)).otherwise(order - 1))
    # repositories are few: a row for each is ranked
    by_repo = written(sizes.withColumn("repo_rank", F.row_number().over(Window.orderBy("preference", "size", "repo"))).withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("repo_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "repos")
    item = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("has_test"), "n_paths", "instance_id"))
    rows = instances.withColumn("item", item).join(by_repo.hint("broadcast" if by_repo.count() <= 10_000 else "merge"), "repo")
    rows = rows.where(F.col("repo_rank") <= repos) if repos else rows
    rows = rows.where("item = 1").withColumn("place", F.col("repo_rank")) if pilot else rows.withColumn("place", F.col("before") + F.col("item"))
    rows = rows.where(F.col("place") <= most) if most else rows
    return rows.select("repo", "instance_id", F.col("place").cast("int").alias("place"))


def rates(results: DataFrame, by: str) -> DataFrame:
    """Rates of each group and of all (where the group is null)."""
    return results.rollup(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"), F.grouping(by).cast("int").alias("is_total"))


def concentration(df: DataFrame, by: str) -> DataFrame:
    """Share of each group, and of the first two together."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    all_, order = Window.partitionBy(), Window.orderBy(F.desc("n"), by)
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(all_), 6)).withColumn("rank", F.row_number().over(order)).withColumn("top2", F.round(F.sum(F.when(F.col("rank") <= 2, F.col("n"))).over(all_) / F.sum("n").over(all_), 6))


def precedents(notes: DataFrame, topics: DataFrame, most: int = 3) -> DataFrame:
    """notes (line, text) and topics (topic, term) to each topic's first pull-request references, by line, each number once; lines on translations do not count."""
    low = F.lower("text")
    pattern = F.lit(r"PR \[#(\d+)\]\(([^)]+)\)")
    translation = low.contains("translation") | (F.col("text").contains("\U0001f310") & ~F.col("text").contains("docs/en/docs/")) | F.col("text").rlike("docs/(?!en/)[a-z-]+/docs/")
    found = notes.where(~translation & F.col("text").rlike(r"PR \[#\d+\]\([^)]+\)")).select("line", low.alias("low"), F.regexp_extract("text", r"PR \[#(\d+)\]", 1).cast("long").alias("number"), F.regexp_extract_all("text", pattern, F.lit(2))[0].alias("url"))
    hit = found.join(topics.hint("broadcast"), F.contains(F.col("low"), F.lower("term"))).groupBy("topic", "number").agg(F.min(F.struct("line", "url")).alias("f"))
    rows = hit.select("topic", "number", "f.line", "f.url")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("line", "number"))).where(F.col("rank") <= most)


def decoys(requests: DataFrame, paths_: DataFrame) -> DataFrame:
    """request_id and path: the first path, by name, that is not the request's own and shares no token with its query; tests/ and docs/ are out.

    Paths are numbered in order; a request's touched ones leave the first gap in the numbers. paths_: path and place.
    """
    tokens = text.token_rows(paths_, F.col("path"), "path", "place").distinct()
    asked = text.token_rows(requests, F.col("query"), "request_id").distinct()
    own = requests.select("request_id", F.explode("changed_paths").alias("path")).hint("merge").join(paths_, "path").select("request_id", "place")
    hit = tokens.hint("merge").join(asked, "token").select("request_id", "place").unionByName(own).distinct()
    ranked = hit.withColumn("k", F.row_number().over(Window.partitionBy("request_id").orderBy("place")))
    gap = ranked.groupBy("request_id").agg(F.min(F.when(F.col("place") != F.col("k"), F.col("k"))).alias("free"), (F.count("*") + 1).alias("after"))
    free = requests.select("request_id").hint("merge").join(gap, "request_id", "left").select("request_id", F.coalesce("free", "after", F.lit(1)).alias("place"))
    return free.hint("merge").join(paths_, "place", "left").select("request_id", "path")


def expected_rank(ranked: DataFrame, hints: DataFrame) -> DataFrame:
    """The first rank whose path holds any hint, -1 if none does."""
    both = hints.hint("merge").join(ranked, "request_id", "left")
    hit = F.exists("hints", lambda h: F.contains(F.col("path"), h))
    return both.groupBy("request_id").agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(-1)).alias("rank"))
