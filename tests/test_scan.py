import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from assay.operators import hybrid, lexical, span_scan, span_search
from assay.plans import decisions, lexical as words
from assay.sources import shared
from assay.sources.shared import written

KEYS = ("request_id", "plan")


def _corpus(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "beta", "Gamma_1", "delta", "the", "of", "x", "éclair", "naïve", "İz", "日本語", "ß", "KelvinK"])
    line = lambda: rng.choice([" ", "\t", ""]).join([rng.choice(["", "  ", "\t"]), " ".join(word() for _ in range(rng.randint(0, 9)))])
    text = lambda: rng.choice(["\n", "\r\n", "\n\n", "\x0b", " ", "\x85"]).join(line() for _ in range(rng.randint(0, 12)))
    texts = [text() for _ in range(70)] + ["alpha beta\n\nalpha beta delta\n"] * 40 + ["", " \n ", "\t", "one\x1ctwo\n\n" * 30]
    kinds = [("src/a/doc_%d.py", "code"), ("tests/b/test_doc_%d.py", "test"), ("docs/c/doc_%d.md", "doc"), ("prs/pr_%d.md", "pr")]
    return written(spark.createDataFrame([(kinds[i % 4][0] % i, kinds[i % 4][1], t) for i, t in enumerate(texts)], "path string, source_type string, content string").repartition(5))


def _queries(spark):
    texts = ["alpha beta", "gamma_1 delta naïve", "doc test", "no such words anywhere", "éclair ß 日本語", "?!", "alpha " * 300, "  ", "kelvin z", "delta delta alpha the of"]
    return written(spark.createDataFrame([(i, p, q) for i, q in enumerate(texts) for p in (0, 1)], "request_id long, plan int, query string"))


def _same(a, b):
    rows = lambda df: sorted(map(str, df.select(sorted(a.columns)).collect()))
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b) and a.count()


def test_reading_the_texts_finds_what_the_index_finds(spark, monkeypatch):
    c, q = _corpus(spark), _queries(spark)
    index = written(hybrid.indexed(c), "index")
    made = written(span_search.blocks(index), "blocks")
    want = written(span_search.best(index, made, written(span_search.lists(made), "lists"), q, 4), "want")
    monkeypatch.setattr(span_scan, "FACTS", 50)
    found = written(span_scan.facts(c), "facts")
    assert abs(span_scan.threshold(found) - spans_threshold(c)) < 1e-9
    for first, block, cells in ((16, 256, 1 << 22), (2, 3, 0)):
        for name, value in (("FIRST", first), ("BLOCK_SPANS", block), ("TABLE_CELLS", cells)):
            monkeypatch.setattr(span_scan, name, value)
        _same(span_scan.best(c, found, q, 4), want)


def spans_threshold(c):
    table = hybrid.spans.with_hazards(hybrid.span_table(c), "text")
    return hybrid.spans.hazard_threshold(table.select(F.explode("hazards").alias("hazard"))).first().threshold


def test_ties_of_one_score_are_ordered_by_occurrences(spark):
    one = span_scan.Asked([(0, 0, "alpha beta", None)], 2, False)
    one._keep(0, [(-0.5, -0.5, -0.5, norm, f"p{i}", 1, 1) for i in range(9) for norm in (1, 2)])
    assert len(one.best[0]) == 4 and {x[3] for x in one.best[0]} == {1, 2} and one.floor[0] == 0.5


def test_lexical_scores_without_postings(spark, monkeypatch):
    c, q = _corpus(spark), _queries(spark)
    monkeypatch.setattr(lexical, "ROWS", 3)
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", 4)
    want = written(lexical.top(lexical.scores(written(lexical.postings(c), "postings"), c.count(), q, KEYS), 5, KEYS), "want")
    _same(lexical.scanned(c, written(lexical.word_counts(c), "counts"), c.count(), q, 5, KEYS), want)
    lines = written(lexical.best_lines(c, q, want, KEYS), "lines")
    monkeypatch.setattr(lexical, "small", lambda *a: False)
    assert lexical.scanned(c, c, 1, q, 5, KEYS) is None
    _same(lines, lexical.best_lines(c, q, want, KEYS))


def test_half_of_the_last_digit_is_rounded_up(spark):
    c = spark.createDataFrame([("a.md", "doc", "w0 w1 w2")], "path string, source_type string, content string")
    q = written(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(128)))], "request_id long, query string"))
    want = lexical.top(lexical.scores(written(lexical.postings(c)), 1, q), 3)
    _same(lexical.scanned(c, written(lexical.word_counts(c)), 1, q, 3), want)


def test_searches_write_neither_index_nor_postings(spark):
    """F3-F15: decisions wrote some twenty times the documents."""
    d, at = "/root/testdata/sf0.01", Path(shared.folder(spark).removeprefix("file:"))
    shared.forget(spark)
    before = set(at.glob("assay-*"))
    assert decisions.healing_prompt(spark, d).count()
    new = [p for p in at.glob("assay-*") if p not in before]
    assert not [p.name for p in new if p.name.startswith(("assay-spans", "assay-span-index", "assay-span-blocks", "assay-span-lists", "assay-postings"))]
    assert sum(f.stat().st_size for p in new if "corpus" not in p.name for f in p.rglob("part-*")) < 2 * Path(d, "documents.parquet").stat().st_size


def test_paths_of_several_documents_are_taken_together(spark, tmp_path):
    for name in ("documents", "benchmark"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (df.unionByName(df.limit(3)) if name == "documents" else df.limit(4)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert not words.distinct(spark, str(tmp_path)) and words.distinct(spark, "/root/testdata/sf0.001")
    got = decisions._spans(spark, str(tmp_path))
    assert got.count() and got.where("kind = 1").groupBy("request_id", "plan", "span").count().where("count > 1").isEmpty()
    assert np.isfinite([r.score for r in words.ranked(spark, str(tmp_path), decisions.requests(spark, str(tmp_path)), 5).collect()]).all()


def test_kinds_searched_together_find_what_each_finds_alone(spark):
    """the replay read and cut the texts anew for each kind of requests, and for each use of their words."""
    d = "/root/testdata/sf0.001"
    read = lambda k: [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in (decisions._spans(spark, d, k), decisions.words(spark, d, k))]
    shared.forget(spark)
    alone = {k: read(k) for k in ("change", "query")}
    shared.forget(spark)
    assert not shared.made(spark, d, "lexical-query")
    decisions.together(spark, d, "change", "query")
    assert shared.made(spark, d, "lexical-query") and {k: read(k) for k in alone} == alone and all(map(all, alone.values()))
    _same(decisions.own_words(spark, d, 12), words.lexical_topk(spark, d))
