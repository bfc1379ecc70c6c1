"""Decisions over ranked hits: evidence and precedents, gaps, notes, hazard, confidence, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions import fixed, paths


def split(ranked: DataFrame) -> DataFrame:
    """Marks ranked hits as evidence (at most 5) or twin (pull requests and incidents, at most 3), with `place` among their kind.

    A request of which all hits are twins has its first five as evidence as well.
    """
    twin = F.col("source_type").isin("pr", "incident")
    w = Window.partitionBy("request_id", "twin").orderBy("rank")
    rows = ranked.withColumn("twin", twin).withColumn("place", F.row_number().over(w)).withColumn("plain", F.count_if(~F.col("twin")).over(Window.partitionBy("request_id")))
    own = rows.where((F.col("twin") & (F.col("place") <= fixed.TOP_TWINS)) | (~F.col("twin") & (F.col("place") <= fixed.TOP_EVIDENCE)))
    again = rows.where((F.col("plain") == 0) & (F.col("rank") <= fixed.TOP_EVIDENCE)).withColumn("twin", F.lit(False)).withColumn("place", F.col("rank"))
    return own.unionByName(again).drop("plain")


def features(parts: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: counts and flags of its evidence and twins (with snippets); requests without hits have zeros."""
    ev, tw = ~F.col("twin"), F.col("twin")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    nth = Window.partitionBy("request_id", "twin").orderBy(F.desc("score"), "path")
    rows = parts.withColumn("best", F.row_number().over(nth))
    warn = F.lower(F.concat_ws(" ", "path", "snippet")).rlike("|".join(fixed.WARNING_TERMS))
    got = rows.groupBy("request_id").agg(
        F.count_if(ev).alias("n_evidence"), F.count_if(tw).alias("n_twins"), F.round(F.coalesce(F.avg(F.when(ev & (F.col("best") <= 3), F.col("score"))), F.lit(0.0)) + 1e-9, 6).alias("support"),
        has(ev & F.col("verified")).alias("any_verified"), has(ev & (F.col("source_type") == "test")).alias("test_support"), has(ev & (F.col("source_type") == "runbook")).alias("runbook_support"),
        has(ev & F.col("verified") & F.col("source_type").isin("code", "test", "runbook")).alias("verified_code_like"), has(ev & F.col("verified") & (F.col("source_type") == "code")).alias("verified_code"),
        has(ev & F.col("verified") & F.col("source_type").isin("doc", "test")).alias("verified_second"), has(tw & (F.col("source_type") == "incident")).alias("incident_twin"),
        has(ev & (F.col("place") <= 3) & warn).alias("warning"),
    )
    kind = lambda k: F.exists("changed_paths", lambda p: paths.source_type(p) == k)
    changed = requests.select("request_id", "changed_paths", kind("test").alias("changes_test"), kind("runbook").alias("changes_runbook"), F.exists("changed_paths", paths.is_frontend).alias("changes_frontend"))
    out = changed.hint("merge").join(got, "request_id", "left")
    return out.na.fill(0, ["n_evidence", "n_twins", "support"]).na.fill(False)


def query_text(summary, diff):
    """What an action is decided on: its summary, and its diff summary where it has one."""
    return F.when(F.coalesce(F.trim(diff), F.lit("")) == "", summary).otherwise(F.concat(summary, F.lit("\n\nDiff summary:\n"), diff))


def alignment(requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """request_id and gap: there are changed paths, and no hit has one of them, or its stem."""
    keys = lambda c: F.explode(F.array(paths.normalized(F.col(c)), F.concat(F.lit("stem:"), paths.stem(F.col(c))))).alias("key")
    changed = requests.select("request_id", F.explode("changed_paths").alias("changed")).select("request_id", keys("changed"))
    fits = changed.hint("merge").join(ranked.select("request_id", keys("path")), ["request_id", "key"], "left_semi").select("request_id").distinct().withColumn("fits", F.lit(True))
    return requests.select("request_id", "changed_paths").hint("merge").join(fits, "request_id", "left").select("request_id", (F.col("fits").isNull() & (F.size("changed_paths") > 0)).alias("gap"))


def focus(requests: DataFrame, parts: DataFrame, most: int = fixed.FOCUS_PATHS) -> DataFrame:
    """request_id and node: the changed paths, or else the first code paths of the evidence."""
    own = requests.select("request_id", F.explode("changed_paths").alias("node"))
    code = parts.where("NOT twin AND source_type = 'code'").withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("place"))).where(F.col("n") <= most)
    bare = code.hint("merge").join(requests.where(F.size("changed_paths") == 0).select("request_id"), "request_id", "left_semi")
    return own.unionByName(bare.select("request_id", F.col("path").alias("node"))).distinct()


def missing(f: DataFrame) -> DataFrame:
    """`missing`: the ordered notes on what evidence lacks; needs gap and impacted_tests."""
    note = lambda c, t: F.when(c, F.lit(t))
    no_test = ~(F.col("test_support") | F.col("changes_test"))
    front = F.col("changes_frontend") & (F.col("impacted_tests") > 0)
    notes = F.array(
        note(F.col("n_evidence") == 0, fixed.NOTE_NO_EVIDENCE), note((F.col("n_evidence") > 0) & ~F.col("any_verified"), fixed.NOTE_UNVERIFIED), note(F.col("gap"), fixed.NOTE_GAP), note(F.col("warning"), fixed.NOTE_WARNING),
        note(no_test & front, fixed.NOTE_NO_FRONTEND_TEST), note(no_test & ~front, fixed.NOTE_NO_TEST), note(~(F.col("runbook_support") | F.col("changes_runbook")), fixed.NOTE_NO_RUNBOOK), note(F.col("n_twins") == 0, fixed.NOTE_NO_PRECEDENT),
    )
    return f.withColumn("missing", F.array_compact(notes))


def decided(f: DataFrame) -> DataFrame:
    """hazard, confidence, recurrence and decision; needs missing, gap and impacted_files."""
    files, lack = F.col("impacted_files"), F.size("missing")
    clamp = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) + 1e-9, 6)
    part = lambda c: F.when(c, 0.05).otherwise(0.0)
    f = f.withColumn("hazard", clamp(0.65 - F.col("support") + 0.08 * lack + 0.02 * F.greatest(F.lit(0), files - 5)))
    f = f.withColumn("confidence", clamp(F.col("support") + part(F.col("n_twins") > 0) + part(F.col("test_support")) + part(F.col("runbook_support")) - 0.03 * F.greatest(F.lit(0), files - 4)))
    precedent = F.col("n_twins") > 0
    strong = (F.col("n_evidence") >= fixed.ADMIT_COUNT) & (F.col("support") >= fixed.ADMIT_SCORE) & (precedent | (F.col("test_support") & F.col("runbook_support")))
    decision = (
        F.when(F.col("gap"), "escalate").when(F.col("warning") & ~(F.col("verified_code_like") & F.col("test_support") & precedent), "escalate").when(strong & (lack <= 1), "admit")
        .when((F.col("n_evidence") >= fixed.ESCALATE_COUNT) & (F.col("support") >= fixed.ESCALATE_SCORE), "escalate").otherwise("abstain")
    )
    return f.withColumn("recurrence", F.col("n_evidence") + F.col("n_twins")).withColumn("decision", decision)


def explained(f: DataFrame) -> DataFrame:
    return f.withColumn("explanation", F.format_string("Decision %s based on support score %.2f, blast radius of %d files, and %d missing evidence flags.", "decision", "support", "impacted_files", F.size("missing")))


POLICY_SCHEMA = "policy string, profile string, max_files int, max_hazard double, min_confidence double, need_test boolean, need_runbook boolean, need_precedent boolean, need_incident boolean, block_incident boolean"


def policies(spark, *overrides) -> DataFrame:
    """The presets, each column overridden by the first later table (policy and some columns) that has a value."""
    out = spark.createDataFrame(list(fixed.POLICIES), POLICY_SCHEMA)
    for o in overrides:
        names = [c for c in o.columns if c != "policy"]
        out = out.hint("merge").join(o.select("policy", *[F.col(c).alias(f"_{c}") for c in names]), "policy", "left")
        out = out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in out.columns if not c.startswith("_")])
    return out


def recalibrated(f: DataFrame) -> DataFrame:
    """Under the open-source profile runbook and precedent notes do not count, and verified code with a second source admits."""
    open_ = F.col("profile") == "open_source"
    f = f.withColumn("missing", F.when(open_, F.array_except("missing", F.array(F.lit(fixed.NOTE_NO_RUNBOOK), F.lit(fixed.NOTE_NO_PRECEDENT)))).otherwise(F.col("missing")))
    blocked = F.arrays_overlap("missing", F.array(F.lit(fixed.NOTE_GAP), F.lit(fixed.NOTE_WARNING), F.lit(fixed.NOTE_NO_FRONTEND_TEST)))
    enough = (F.col("n_evidence") >= fixed.ADMIT_COUNT) & (F.col("support") >= fixed.ADMIT_SCORE) & F.col("verified_code") & F.col("verified_second")
    tested = ~F.col("need_test") | F.col("test_support") | F.col("changes_test")
    return f.withColumn("decision", F.when(open_ & ~blocked & enough & tested, "admit").otherwise(F.col("decision")))


def violations(f: DataFrame) -> DataFrame:
    """`violations`: the policy's checks that fail, in order."""
    v = lambda c, t: F.when(c, t)
    test, book = F.col("test_support") | F.col("changes_test"), F.col("runbook_support") | F.col("changes_runbook")
    return f.withColumn("violations", F.array_compact(F.array(
        v(F.col("impacted_files") > F.col("max_files"), F.format_string(fixed.BREACH_FILES, "impacted_files", "max_files")), v(F.col("hazard") > F.col("max_hazard"), F.format_string(fixed.BREACH_HAZARD, "hazard", "max_hazard")),
        v(F.col("confidence") < F.col("min_confidence"), F.format_string(fixed.BREACH_CONFIDENCE, "confidence", "min_confidence")), v(F.col("need_test") & ~test, F.lit(fixed.BREACH_TEST)), v(F.col("need_runbook") & ~book, F.lit(fixed.BREACH_RUNBOOK)),
        v(F.col("need_precedent") & (F.col("n_twins") == 0), F.lit(fixed.BREACH_PRECEDENT)), v(F.col("need_incident") & ~F.col("incident_twin"), F.lit(fixed.BREACH_NO_INCIDENT)), v(F.col("block_incident") & F.col("incident_twin"), F.lit(fixed.BREACH_INCIDENT)),
    )))


def acted(f: DataFrame, block_on=("abstain", "escalate")) -> DataFrame:
    """Any violation escalates and is noted; allowed says whether the decision is one that does not block."""
    bad = F.size("violations") > 0
    f = f.withColumn("decision", F.when(bad, "escalate").otherwise(F.col("decision")))
    f = f.withColumn("missing", F.array_union("missing", F.transform("violations", lambda x: F.concat(F.lit("Safety policy violation: "), x))))
    return f.withColumn("allowed", ~F.col("decision").isin(*block_on))


def retry_text(f: DataFrame) -> DataFrame:
    """What a blocked request needs: its first three notes."""
    todo = F.concat(F.lit("Blocked: "), F.col("decision"), F.lit(". Resolve: "), F.array_join(F.slice("missing", 1, 3), "; "))
    return f.withColumn("prompt", F.when(~F.col("allowed"), todo))


def healing_step(f: DataFrame, parts: DataFrame, most: int = 3) -> DataFrame:
    """What comes after each decision: next_step, and the strongest evidence and twins by place.

    An allowed action proceeds; one that is not is repaired and tried again if anything is noted that it lacks, else its evidence is to be inspected.
    """
    step = F.when(F.col("allowed"), "proceed").when(F.size("missing") > 0, "repair_and_retry").otherwise("inspect_evidence")
    first = lambda twin: F.transform(F.array_sort(F.collect_list(F.when(F.col("twin") == twin, F.struct("place", "path")))), lambda x: x["path"])
    near = parts.where(F.col("place") <= most).groupBy("request_id").agg(first(False).alias("strongest_evidence"), first(True).alias("strongest_twins"))
    none = F.array().cast("array<string>")
    out = f.withColumn("next_step", step).hint("merge").join(near, "request_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("strongest_evidence", "strongest_twins")})
