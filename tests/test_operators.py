import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assay.functions import paths, text
from assay.operators import catalog, decide, fusion, graph, hybrid, ledger, lexical, span_search, spans, upkeep
from assay.plans import evaluate
from assay.plans import upkeep as builds
from assay.sources.shared import written


def test_paths(spark):
    rows = ["tests/test_a.py", "src/x.test.ts", "docs/runbook_a.md", "incidents/i.md", "prs/pr_1.md", "src/a.py", "a.md", "a.bin", "e2e/x.js"]
    df = spark.createDataFrame([(p,) for p in rows], ["p"])
    assert [r[0] for r in df.select(paths.source_type(df.p)).collect()] == ["test", "test", "runbook", "incident", "pr", "code", "doc", "other", "test"]
    assert spark.range(1).select(paths.anchor_words(F.lit("src/billing/BillingButton.tsx"))).first()[0] == ["billing", "billingbutton", "button"]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.tokens(F.lit("If we change auth_token or A the"))) == ["we", "change", "auth_token"]
    assert one(text.patch_paths(F.lit("+++ b/a.py\n+++ /dev/null\n+++ b/a.py\n+++ b/c/d.ts"))) == ["a.py", "c/d.ts"]
    assert one(text.slug(F.lit(" A b/c "))) == "A-b-c" and one(text.slug(F.lit("//"))) == "record"
    assert one(text.timestamp(F.lit("x"), F.lit("1700000000"))).year == 2023
    assert one(text.qgrams(F.lit("Ab"))) == [" ab", "ab "]


def test_closures_go_by_request_and_end_on_cycles(spark):
    edges = spark.createDataFrame([("k", "m"), ("l", "k"), ("m", "l"), ("n", "m"), ("z", "y")], ["src", "dst"])
    got = graph.closure(edges, spark.createDataFrame([(1, "k"), (2, "y"), (3, "gone")], ["request_id", "node"]))
    assert {(r.request_id, r.node): r.depth for r in got.collect()} == {(1, "k"): 0, (1, "l"): 1, (1, "m"): 2, (1, "n"): 3, (2, "y"): 0, (2, "z"): 1, (3, "gone"): 0}
    assert {r.request_id: (r.impacted_files, r.max_depth) for r in graph.impact(got).collect()} == {1: (4, 3), 2: (2, 1), 3: (1, 0)}


def test_walks_and_edges_are_dealt_out_by_their_number(spark, monkeypatch):
    """More edges and walks make more tasks, and least depths stay those of the frontier loop; two ways to a node are two walks."""
    monkeypatch.setattr(graph, "PART_ROWS", 25)
    a = spark.createDataFrame([(f"m{i}", f"k{i % 7}") for i in range(300)] + [(f"k{i}", "top") for i in range(7)] + [("k1", "k1")], ["src", "dst"])
    b = spark.createDataFrame([(f"m{i}", "top") for i in range(0, 300, 9)] + [("m0", "k0")], ["src", "dst"])
    united = graph.unioned(a, b)
    assert united.rdd.getNumPartitions() == 14 and united.count() == 341
    edges, start = written(united), spark.createDataFrame([(1, "top"), (2, "k3"), (3, "gone")], ["request_id", "node"])
    got = graph.shallow_closure(edges, start, 2)
    assert got.rdd.getNumPartitions() == 16 and got.columns == ["request_id", "node", "depth"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.closure(edges, start, 2).collect()))


def test_imports_resolve(spark):
    files = spark.createDataFrame(
        [
            ("pkg/a.py", "from .b import x\nimport pkg.c, os as o\n"), ("pkg/b.py", ""), ("pkg/c.py", "import os"), ("web/App.tsx", "import {x} from './lib/util'\nconst y = import('../pkg')\nimport k from '@org/kit'\nimport s from 'kit/store'"), ("web/lib/util.ts", ""),
            ("packages/kit/package.json", '{"name": "@org/kit"}'), ("packages/kit/src/index.ts", ""), ("packages/kit/src/store.ts", "export * from './'"), ("c/x.c", '#include "y.h"'), ("c/y.h", ""),
        ],
        ["path", "content"],
    )
    got = {tuple(r) for r in graph.resolved(graph.imports(files), files).collect()}
    assert got == {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/c.py"), ("web/App.tsx", "web/lib/util.ts"), ("web/App.tsx", "pkg/a.py"), ("web/App.tsx", "packages/kit/src/index.ts"), ("web/App.tsx", "packages/kit/src/store.ts"), ("packages/kit/src/store.ts", "packages/kit/src/index.ts"), ("c/x.c", "c/y.h")}
    assert {r.alias: r.root for r in graph.workspaces(files).collect()} == {"@org/kit": "packages/kit", "kit": "packages/kit"}


def test_tests_of_common_words_are_not_lost(spark):
    """Words that many tests share, against all pairs."""
    import random

    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "solo1", "solo2", "solo3"])
    rows = [(f"src/{word()}/{word()}_{word()}.py",) for _ in range(30)] + [(f"tests/{word()}/test_{word()}_{word()}.py",) for _ in range(200)]
    p = spark.createDataFrame(rows, ["path"])
    key = lambda df: sorted(tuple(r) for r in df.collect())
    s = p.where("path LIKE 'src%'")
    assert key(graph.linked_tests(s, p, hot=5, most=3)) == key(graph.linked_tests(s, p, hot=10**6, most=3))


def test_pairs_of_sources_and_tests_are_made_once_in_parts(spark, monkeypatch):
    """A word of all sources and tests is dealt out to many tasks; the best are those of all pairs, with and without edges."""
    import random

    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "solo1", "solo2"])
    rows = sorted({f"src/all/{word()}_{word()}.py" for _ in range(60)} | {f"web/{word()}/AllPanel.tsx" for _ in range(5)} | {f"tests/all/test_{word()}_{word()}{rng.randrange(3)}.py" for _ in range(60)} | {"src/none.py", "tests/test_other.py"})
    p = spark.createDataFrame([(r,) for r in rows], ["path"])
    s, t = p.where(~paths.is_test(F.col("path"))), p.where(paths.is_test(F.col("path")))
    edges = spark.createDataFrame([rng.sample(rows, 2) for _ in range(80)] + [("src/none.py", "tests/test_other.py")] * 2, "src string, dst string")
    monkeypatch.setattr(graph, "PART_PAIRS", 100)
    a, b = (x.select(F.col("path").alias(n), F.explode(paths.anchor_words(F.col("path"))).alias("word")) for x, n in ((s, "source"), (t, "test")))
    dealt = graph._pairs(a, b)
    sizes = [r[0] for r in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == a.join(b, "word").count() and dealt.rdd.getNumPartitions() >= sum(sizes) / 100 and max(sizes) < sum(sizes) / 4
    near = edges.select(F.col("src").alias("source"), F.col("dst").alias("test")).unionByName(edges.select(F.col("dst").alias("source"), F.col("src").alias("test"))).distinct().withColumn("near", F.lit(0.8))
    every = s.select(F.col("path").alias("source")).crossJoin(t.select(F.col("path").alias("test")))
    for e in (None, edges):
        scored = (every.withColumn("near", F.lit(0.0)) if e is None else every.join(near, ["source", "test"], "left")).collect()
        link = spark.createDataFrame(scored, "source string, test string, near double").withColumn("score", F.round(F.greatest(F.coalesce("near", F.lit(0.0)), paths.link_score(F.col("source"), F.col("test"), paths.anchor_words(F.col("source")), paths.anchor_words(F.col("test")))), 6))
        want = {}
        for r in sorted(link.where("score >= 0.45").collect(), key=lambda r: (r.source, -r.score, r.test)):
            want.setdefault(r.source, []).append((r.test, r.score))
        for hot in (4, 10**6):
            got = graph.linked_tests(s, p, e, most=3, hot=hot).collect()
            assert sorted((r.source, r["rank"], r.test, r.score) for r in got) == sorted((k, i + 1, *x) for k, v in want.items() for i, x in enumerate(v[:3]))


def _search(index, q, most=20):
    made = written(span_search.blocks(index), "blocks")
    return span_search.best(index, made, written(span_search.lists(made), "lists"), q, most).collect()


def test_hybrid_search_falls_back_to_all_spans(spark):
    c = spark.createDataFrame([("docs/a.md", "doc", "one two three\n\nfour five six"), ("docs/b.md", "doc", "zzz yyy")], ["path", "source_type", "content"])
    index = written(hybrid.indexed(c), "index")
    assert {(r.path, r.kind, r.line_number) for r in index.collect()} == {("docs/a.md", 0, 1), ("docs/a.md", 1, 1), ("docs/a.md", 1, 3), ("docs/b.md", 0, 1), ("docs/b.md", 1, 1)}
    q = spark.createDataFrame([(1, 0, "four five"), (2, 0, "qqq"), (3, 0, " ")], "request_id long, plan int, query string")
    got = _search(index, q)
    assert {(r.path, r.kind, r.line_number) for r in got if r.request_id == 1} == {("docs/a.md", 0, 1), ("docs/a.md", 1, 3)} and not [r for r in got if r.request_id == 3]
    assert [r.line_number for r in got if r.request_id == 1 and r["rank"] == 1] == [3]


def test_bounds_change_the_work_and_not_the_best(spark, monkeypatch):
    """Small blocks and groups against one large block, with ties, hot words, words that are nowhere and odd texts."""
    import random

    rng = random.Random(6)
    words = [f"word{i}" for i in range(40)] + ["hot"] * 20
    spans = [(i, f"src/{rng.choice(words)}/f{i % 60}.py", i % 2, i // 60, rng.randrange(3), " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(400)]
    spans += [(400, "a.py", 1, 1, 0, ""), (401, "b.py", 1, 1, 0, "Ünïcode \U0001f600 hot"), (402, "b.py", 1, 2, 0, "x " * 20_000)] + [(403 + i, f"same{i}.py", 1, 1, 1, "equal text of hot word1") for i in range(30)]
    df = spark.createDataFrame(spans, "id long, path string, kind int, line_number int, occurrences int, search_text string")
    rest = {c: F.lit("") for c in ("span", "source_type", "text")} | {c: F.lit(0.0) for c in ("hazard", "coverage")} | {"calm": F.lit(True)}
    index = written(df.withColumns(rest), "index")
    asked = [(i, 0, " ".join(rng.choices([*words, "nowhere"], k=rng.randrange(1, 6)))) for i in range(40)] + [(40, 0, "nowhere at all"), (41, 0, "the of"), (42, 1, "hot"), (43, 0, "\n")]
    q = spark.createDataFrame(asked, "request_id long, plan int, query string")
    key = lambda rows: sorted((r.request_id, r.plan, r["rank"], r.path, r.line_number, r.kind, r.structural, r.cosine, r.final) for r in rows)
    monkeypatch.setattr(span_search, "BLOCK_SPANS", 10_000)
    whole = key(_search(index, q, 7))
    for spans_, blocks, queries in ((8, 2, 5), (1, 16, 100)):
        for name, value in (("BLOCK_SPANS", spans_), ("GROUP_BLOCKS", blocks), ("TASK_QUERIES", queries)):
            monkeypatch.setattr(span_search, name, value)
        assert key(_search(index, q, 7)) == whole
    rows = [r.asDict() for r in span_search.blocks(index.orderBy("id")).collect()]
    asked = span_search.Queries([{"query": "word1 word2 word3", "everywhere": False, "floor": None}], 3)
    for row in rows:
        block = span_search.Block(row)
        asked.visit(block, asked.bound(block), np.ones(1, bool))
    assert asked.scored < asked.offered / 2 and len(asked.best[0]) == 3


def test_queries_meet_blocks_in_parts_of_fixed_size(spark, monkeypatch):
    """A frequent word brings every query to every block: the pairs are dealt to more tasks, by either join, and the best stay the same."""
    df = spark.createDataFrame([(i, f"src/f{i}.py", 1, 1, 1, "code", "s", "t", 0.5, 0.5, True, f"hot word{i % 9}") for i in range(60)], "id long, path string, kind int, line_number int, occurrences int, source_type string, span string, text string, hazard double, coverage double, calm boolean, search_text string")
    q = spark.createDataFrame([(i, 0, f"hot word{i}") for i in range(12)] + [(12, 0, "nowhere")], "request_id long, plan int, query string")
    index, dealt, write = written(df.coalesce(1)), [], span_search.written
    monkeypatch.setattr(span_search, "BLOCK_SPANS", 2)
    monkeypatch.setattr(span_search, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(span_search, "written", lambda d, name="table", *a: (dealt.append(d.rdd.getNumPartitions()) if name == "met" else None, write(d, name, *a))[1])
    key = lambda: sorted((r.request_id, r["rank"], r.path, r.final) for r in _search(index, q, 3))
    whole = key()
    monkeypatch.setattr(span_search, "PART_PAIRS", 20)
    for few in (True, False):
        monkeypatch.setattr(span_search, "small", lambda d, few=few: few)
        assert key() == whole
    assert dealt[1:] == [20, 20] and len(whole) == 36


def test_symbols_and_linked_tests(spark):
    d = spark.createDataFrame([("x/y/a.ts", "S"), ("z/b.ts", "S")], ["path", "symbol"])
    u = spark.createDataFrame([("x/y/c.ts", "S")], ["path", "symbol"])
    assert [tuple(r) for r in graph.symbol_edges(d, u).collect()] == [("x/y/c.ts", "x/y/a.ts", "S")]
    p = spark.createDataFrame([("src/cache_store.py",), ("tests/test_cache_store.py",), ("tests/test_other.py",)], ["path"])
    got = graph.linked_tests(p.where("path LIKE 'src%'"), p).collect()
    assert [r.test for r in got] == ["tests/test_cache_store.py"]


def test_twins_stand_in_for_evidence(spark):
    hits = spark.createDataFrame([(1, f"prs/pr_{i}.md", "pr", 0.9 - i / 10, True, i) for i in range(1, 5)], ["request_id", "path", "source_type", "score", "verified", "rank"])
    got = decide.split(hits).groupBy("twin").count().collect()
    assert {r.twin: r["count"] for r in got} == {True: 3, False: 4}


def test_policies_override(spark):
    over = spark.createDataFrame([("strict", 9)], "policy string, max_files int")
    assert {r.policy: r.max_files for r in decide.policies(spark, over).collect()} == {"strict": 9, "agile": 25}


def test_decoys_use_all_tokens_and_number_paths_in_ranges(spark):
    plan = evaluate.decoy_selection(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    got = evaluate._places(spark.createDataFrame([(f"p{i:03}",) for i in range(200)] * 2, ["path"])).collect()
    assert sorted((r.path, r.place) for r in got) == [(f"p{i:03}", i + 1) for i in range(200)]


def test_fusion_is_noisy_or(spark):
    hits = spark.createDataFrame([(1, "a", "doc", 0.5, 1.0, False), (1, "a", "doc", 0.5, 1.0, True), (1, "a", "doc", 0.0, 1.0, False)], ["request_id", "path", "source_type", "score", "weight", "verified"]).selectExpr("*", "0 plan", "1 line_number", "CAST(score AS STRING) snippet")
    r = fusion.fused(hits).first()
    assert r.score == 0.75 and r.verified and r.snippet == "0.5"


def test_healing_reopens_and_ignores_plain_allows(spark):
    rows = [(i, i, 1, b) for i, b in enumerate([False, True, True, False, False, True])]
    led = spark.createDataFrame(rows, ["decision_id", "t", "fingerprint", "blocked"]).select("decision_id", F.timestamp_seconds("t").alias("created_at"), "fingerprint", "blocked")
    got = sorted((r.first_blocked, r.healed, r.blocked_attempts) for r in ledger.sequences(led).collect() if r.healed is not None)
    assert got == [(1, 3, 2)] and ledger.sequences(led).where("healed IS NULL").first().first_blocked == 5


def test_builds_are_kept_by_corpus(spark, tmp_path):
    d = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3")], ["corpus", "path"])
    m = lambda df: df.groupBy("corpus").count()
    base = str(tmp_path)
    catalog.persist({"documents": d}, m(d), base)
    one = d.where("path = 'p1'")
    catalog.persist({"documents": one}, m(one), base)
    assert sorted((r.corpus, r.path) for r in catalog.read(spark, base, "documents").collect()) == [("a", "p1"), ("b", "p3")]
    catalog.drop(spark, base, ["documents"], ["a", "none"])
    catalog.drop(spark, base, ["documents"], ["a"])
    assert [r.path for r in catalog.read(spark, base, "documents").collect()] == ["p3"] and catalog.read(spark, base, "manifests").count() == 1


def test_lookback_clauses(spark):
    df = spark.createDataFrame([(0,), (61,), (3599,), (3601,), (86401,), (None,)], "s long")
    assert [r[0] for r in df.select(ledger.lookback(F.col("s"), 7)).collect()] == ["-1m", "-2m", "-1h", "-2h", "-2d", "-7d"]


def test_retries_of_a_batch_replace_it(spark, tmp_path):
    from assay.streaming import ledger as streams

    for i in range(2):
        spark.createDataFrame([("a", i), (f"k{i}", 0)], "key string, version long").write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema("key string, version long").parquet(f"{tmp_path}/in")
        streams.upserted(s, f"{tmp_path}/out", "key", "version", f"{tmp_path}/at").awaitTermination()
    got = lambda p: sorted(tuple(r) for r in streams.latest(spark, p, "key", "version").collect())
    assert got(f"{tmp_path}/out") == [("a", 1), ("k0", 0), ("k1", 0)]
    streams.compacted(spark, f"{tmp_path}/out", f"{tmp_path}/small", "key", "version")
    assert got(f"{tmp_path}/small") == got(f"{tmp_path}/out")


def test_shared_tables_follow_their_files(spark, tmp_path):
    from assay.sources import shared

    put = lambda n: spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    count = lambda: shared.once(spark, str(tmp_path), "rows", lambda: spark.read.parquet(f"{tmp_path}/t.parquet")).count()
    put(3)
    assert count() == 3 and count() == 3
    put(5)
    assert count() == 5
    made = shared._made[(spark.sparkContext.applicationId, str(tmp_path), "rows")][1].inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.exists(made)
    shared.forget(spark)
    assert not os.path.exists(made) and not [k for k in shared._made if k[0] == spark.sparkContext.applicationId] and count() == 5


def test_updates_equal_rebuilds_and_read_what_changed(spark, tmp_path):
    def tree(n, texts):
        rows = [(f"pkgs/m{i}.py", texts.get(i, f"import os, pkgs.m{i + 1}\n")) for i in n]
        return spark.createDataFrame(rows, "path string, content string")

    seen = []

    def run(files):
        listing = files.select("path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("changed"))

        def derive(new):
            seen.append({r.path for r in new.collect()})
            return graph.imports(files.join(new, "path", "left_semi"))

        changes = {r.path: r.change for r in upkeep.updated(listing, str(tmp_path), derive).collect()}
        now = upkeep.derived(spark, str(tmp_path))
        key = lambda df: sorted(map(tuple, df.collect()))
        assert key(now) == key(graph.imports(files))
        assert key(graph.resolved(now, files)) == key(graph.resolved(graph.imports(files), files))
        return changes

    assert set(run(tree(range(20), {})).values()) == {"added"}
    got = run(tree([*range(1, 20), 30], {4: "import changed\n"}))
    assert {p: c for p, c in got.items() if c != "kept"} == {"pkgs/m0.py": "removed", "pkgs/m4.py": "changed", "pkgs/m30.py": "added"}
    assert seen[1] == {"pkgs/m4.py", "pkgs/m30.py"}
    run(tree(range(1, 20), {}))
    upkeep.compacted(spark, str(tmp_path))
    assert set(run(tree(range(1, 20), {})).values()) == {"kept"} and seen[3] == set()


def test_two_builders_and_a_failed_build(spark, tmp_path):
    def wanted(mark):
        return spark.createDataFrame([("a", mark, "s"), ("b", "1", "s")], "corpus string, fingerprint string, signature string")

    rows = lambda tag: {"t": lambda todo: todo.select("corpus", F.lit(tag).alias("tag"))}
    plan = lambda df: {r.corpus: r.action for r in df.collect()}
    assert plan(upkeep.materialized(wanted("1"), str(tmp_path), rows("one"))) == {"a": "built", "b": "built"}
    try:
        upkeep.materialized(wanted("2"), str(tmp_path), rows("lost") | {"u": lambda todo: todo.select("nowhere")})
        raise AssertionError
    except Exception as e:
        assert "nowhere" in str(e)
    read = lambda: {r.corpus: r.tag for r in upkeep.current(spark, str(tmp_path), "t").collect()}
    assert read() == {"a": "one", "b": "one"}
    assert plan(upkeep.materialized(wanted("2"), str(tmp_path), rows("two"))) == {"a": "refreshed", "b": "reused"}
    assert read() == {"a": "two", "b": "one"}
    assert plan(upkeep.materialized(wanted("2"), str(tmp_path), rows("three"))) == {"a": "reused", "b": "reused"} and read()["a"] == "two"


def test_cursors_advance_and_polling_ends(spark, tmp_path):
    from assay.streaming import sync

    landed = lambda name: spark.readStream.schema("k long, v long").parquet(f"{tmp_path}/in/{name}")
    put = lambda name, rows: spark.createDataFrame(rows, "k long, v long").write.mode("append").parquet(f"{tmp_path}/in/{name}")
    put("x", [(1, 1), (2, 1)])
    put("y", [(1, 5)])
    for number in (1, 2):
        sync.run({"x": landed("x"), "y": landed("y")}, f"{tmp_path}/out", "k", "v", number)
        put("x", [(1, 2)])
    got = {r.source: r for r in sync.cursors(spark, f"{tmp_path}/out").collect()}
    assert {n: (r.run, r.rows, r.rows_total, r.error) for n, r in got.items()} == {"x": (2, 1, 3, None), "y": (2, 0, 1, None)}
    assert got["x"].cursor == got["y"].cursor
    assert sorted(tuple(r) for r in sync.latest(spark, f"{tmp_path}/out", "x", "k", "v").collect()) == [(1, 2), (2, 1)]
    assert sync.polled(landed("x"), f"{tmp_path}/polled", "k", "v", every="1 second", runs=1, timeout=60) == 4


def test_blocks_of_spans_are_small(spark):
    """A block of short spans takes far less than a dense vector and 64-bit values for each, and row groups hold few blocks."""
    import pyarrow.parquet as pq

    text_ = lambda i: " ".join(f"word{(i * 7 + j * j) % 900}" for j in range(40))
    df = spark.createDataFrame([(i, f"src/f{i // 8}.py", 1, i % 8, 1, text_(i)) for i in range(512)], "id long, path string, kind int, line_number int, occurrences int, search_text string").coalesce(1)
    rows = [r.asDict() for r in span_search.blocks(df).collect()]
    held = sum(len(v) for r in rows for v in r.values() if isinstance(v, (bytes, bytearray)))
    assert sum(r["n"] for r in rows) == 512 and held < 512 * 1_000
    block = span_search.Block(rows[0])
    assert np.allclose((block.weights**2).sum(1), 1) and (block.gram[block.gram_at[block.gram_of == 3]] == span_search.grams(text_(3))).all()
    wide = written(spark.range(400).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 1_000).alias("x")).coalesce(1), "wide", 1_000_000)
    f = pq.ParquetFile(next(x for x in wide.inputFiles()).replace("file://", ""))
    assert f.num_row_groups > 1


def test_fitting_files_are_found_by_keys_as_by_pairs(spark, monkeypatch):
    """Front-end tests and definers of symbols, against all pairs; common words pair nothing by themselves."""
    import random

    rng = random.Random(8)
    monkeypatch.setattr(graph, "HOT", 5)
    word = lambda: rng.choice(["Card", "Card", "Panel", "Grid", "Solo1", "Solo2"])
    files = [(f"web/components/{word().lower()}/{rng.choice([word() + word(), 'index', word()])}.tsx",) for _ in range(40)] + [(f"web/specs/{word().lower()}/{word()}{word()}.test.tsx",) for _ in range(60)]
    p = spark.createDataFrame(sorted(set(files)), ["path"])
    w = {r.path: (set(r.w), r.s, r.t) for r in p.select("path", paths.frontend_words(p.path).alias("w"), F.lower(paths.stem(p.path)).alias("s"), paths.source_type(p.path).alias("t")).collect()}
    want = set()
    for t, (a, _, kind) in w.items():
        for c, (b, stem, other) in w.items():
            if kind == "test" and other != "test" and a & b:
                generic = stem == "index"
                if (not generic and stem in a) or (generic and c.split("/")[-2] in a & b) or len(a & b) > 1 or len(b) == 1:
                    want.add((t, c))
    got = [tuple(r) for r in graph.frontend_edges(p).collect()]
    assert len(got) == len(want) and set(got) == want
    folder = lambda: "/".join(rng.choice("ab") for _ in range(rng.randrange(4)))
    rows = lambda n: sorted({((folder() + f"/f{rng.randrange(9)}.py").lstrip("/"), rng.choice("ST")) for _ in range(n)})
    d, u = rows(40), rows(60)
    head = lambda x: x.split("/")[:-1]
    best = {}
    for s, k in u:
        found = sorted((-len(set(head(s)) & set(head(x))), len(head(x)), len(x), x) for x, y in d if y == k and x != s)
        if found:
            best[s, k] = found[0][-1]
    got = graph.symbol_edges(spark.createDataFrame(d, ["path", "symbol"]), spark.createDataFrame(u, ["path", "symbol"])).collect()
    assert {(r.src, r.symbol): r.dst for r in got} == best and len(got) == len(best)


def test_workspace_files_meet_by_keys(spark, monkeypatch):
    """Of a package's many files only those that fit meet an import: the last join's sides hold no pair of every importer and file."""
    sizes = {}
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="table", *a: sizes.setdefault(name, real(df, name, *a)))
    rows = [("packages/kit/package.json", "{}")] + [(f"packages/kit/deep/item{i}.ts", "") for i in range(60)] + [(f"app/a{i}.ts", f"import x from 'kit/em{i}'") for i in range(60)]
    files = spark.createDataFrame(rows, ["path", "content"])
    got = {r.src: r.dst for r in graph.resolved(graph.imports(files), files).collect()}
    best = lambda i: min((f"packages/kit/deep/item{k}.ts" for k in range(60) if f"item{k}".endswith(f"em{i}")), key=lambda x: (len(x), x))
    assert got == {f"app/a{i}.ts": best(i) for i in range(60)} and sizes["firsts"].count() == 2


def test_windows_of_texts_cut_together_equal_those_of_each(spark, monkeypatch):
    """Texts are cut in slices of bytes; no bit change is counted across texts, and empty ones have no windows."""
    def each(body):
        raw = np.frombuffer((body or "").encode(), np.uint8)
        bits, last = np.unpackbits(raw), max(len(raw) - 96, 0)
        for i, a in enumerate(sorted({*range(0, last + 1, 48), last}) if len(raw) else ()):
            w = bits[8 * a : 8 * (a + 96)]
            yield i, a, min(a + 96, len(raw)), float((w[1:] != w[:-1]).sum() / (len(w) - 1))

    texts = [None, "", "a", "é" * 50, "ab" * 48, "x" * 97, "é漢😀z" * 40, "\n" * 500]
    for size in (spans.SLICE_BYTES, 100, 1):
        monkeypatch.setattr(spans, "SLICE_BYTES", size)
        got = [(first + int(o), int(i), int(s - at[o]), int(e - at[o]), float(r)) for first, _, at, raw in spans._slices(pa.array(["", *texts])[1:]) for o, i, s, e, r in zip(*spans._cut(at, raw, 96, 48), strict=True)]
        assert got == [(k, *w) for k, t in enumerate(texts) for w in each(t)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    assert {r.id: r.hazards for r in spans.with_hazards(df, "text").collect()} == {k: [w[3] for w in each(t)] for k, t in enumerate(texts)}


def test_tokens_are_counted_in_parts_by_path(spark, monkeypatch):
    """Rows of one path count together, in as many tasks as the texts need; the scores of a path come about in one task."""
    rows = [("src/İx_1.py", "Auth auth the x, Ü AUTH_token"), ("src/İx_1.py", "auth src"), (None, "auth"), ("b.md", ""), *[(f"d/{i}.md", f"auth w{i % 7} w{i % 5}") for i in range(50)]]
    docs = spark.createDataFrame(rows, "path string, content string")
    monkeypatch.setattr(lexical, "PART_CHARS", 50)
    monkeypatch.setattr(lexical, "PART_PAIRS", 10)
    post = lexical.postings(docs)
    assert post.rdd.getNumPartitions() > 8
    both = text.token_rows(docs, F.col("content"), "path").withColumn("c", F.lit(1)).unionByName(text.token_rows(docs.select("path").distinct(), F.replace("path", F.lit("/"), F.lit(" ")), "path").withColumn("c", F.lit(0)))
    want = both.groupBy("path", "token").agg(F.sum("c").alias("tf"), F.sum(1 - F.col("c")).alias("path_tf"))
    assert sorted(map(str, post.collect())) == sorted(map(str, want.collect()))
    ask = spark.createDataFrame([(1, "auth w1 w2"), (2, "the x"), (3, "src auth_token w3")], "request_id long, query string")
    post = written(post.where("path IS NOT NULL"))
    scored = {}
    for few in (True, False):
        monkeypatch.setattr(lexical, "small", lambda df, few=few: few)
        rows = lexical.scores(post, 53, ask)
        scored[few] = sorted(map(tuple, rows.collect()))
        assert rows.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 11)
    assert scored[True] == scored[False] and len({r[1] for r in scored[True]}) == 51


def test_texts_of_few_corpora_are_not_dealt_by_corpus(spark):
    """A language's texts are read by all tasks, not by one."""
    docs = spark.createDataFrame([("de", 1, "a\n\nb"), ("en", 2, "c"), ("de", 3, None)], "corpus string, doc_id long, text string")
    rows = builds._lines(docs)(written(spark.createDataFrame([("de", "f")], "corpus string, fingerprint string")))
    assert {(r.corpus, r.doc_id, r.line, r.body) for r in rows.collect()} == {("de", 1, 0, "a"), ("de", 1, 2, "b")}
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
