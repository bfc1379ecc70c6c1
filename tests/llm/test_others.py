"""Top-k, chat, pages, the pipeline and the SQL of the queries."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from assay.llm import chat, components, pages, queries, topk


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_topk_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = random.Random(2)
    vectors = {i: [rng.gauss(0, 1) for _ in range(6)] for i in range(150)}
    for i in range(60, 120):
        vectors[i] = vectors[0]
    rows = [*vectors.items(), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (0, vectors[0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").select("id", topk.integers(F.col("embedding")).alias("v")).where("v IS NOT NULL").dropDuplicates(["id"])
    got = {}
    for r in topk.nearest(df, df.where("id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    for q in range(0, 150, 20):
        s = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:20]
        assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    none = df.limit(0)
    assert topk.nearest(none, none).count() == 0


def test_chat_reads_back_what_it_wrote(spark):
    rng = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "~", "~1", "~0", "\n", " ", "x", "é", "[ROLE a] ", "<", "["]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to]ol~[", None]), rng.choice([None, "".join(rng.choices(parts, k=rng.randrange(12)))])) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(41, 1, "user", "a"), (41, 1, "user", "a"), (None, 0, "user", "q"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    done = chat.formatted(df)
    got = {r.conv_id: r for r in done.withColumn("read", chat.parsed(done.formatted)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].read] == [(r, t) for _, r, t in turns]
        assert [s.text for s in got[c].segments if s.loss] == [t.replace("~", "~0").replace("<", "~1").replace("[", "~2") for _, r, t in turns if r == "assistant"]
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_machine(spark):
    rows = [(1, 0, "system", ""), (1, 1, "user", ""), (1, 2, "assistant", ""), (2, 0, "assistant", ""), (3, 0, "user", ""), (4, 0, "user", ""), (4, 1, "user", ""), (4, 2, "assistant", "")]
    got = {r.conv_id: r.valid for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


PAGE = """<html><head><title>t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><header>Site name here</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site</div><{0}><h1>Title &amp;&nbsp;more</h1><p>One <b>bo</b>ld   word<br>next<p>Two &lt;x&gt;<aside>skip this</aside><form><input><button>Send it</button></form><!-- <p>no</p> --></{0}>
<div class="comments"><p>First! so good</p></div><footer>&copy; us</footer>{1}"""


def test_pages(spark):
    rows = [(1, PAGE.format("article", "</body></html>")), (2, PAGE.format("article", "")), (3, PAGE.format("div", "</body></html>")), (4, None), (5, ""), (6, "plain words only"), (7, "<p>unclosed <script>x"), (1, PAGE.format("article", "</body></html>"))]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text) for r in pages.main_texts(df).collect()]
    want = "Title & more One bold word next Two <x>"
    assert got[0][1] == got[1][1] == got[2][1] == want and got[7] == got[0]
    assert [t for _, t in got[3:7]] == ["", "", "plain words only", "unclosed"]
    assert pages.main_texts(df.limit(0)).count() == 0


def test_broken_pages():
    model = pages.Weights(np.zeros(pages.SLOTS), np.zeros(pages.SLOTS))
    model.tags[:] = 0
    text = lambda html: pages.extract(html, model)
    assert text('<article><p>one <a href="foo>link</a> two</p><p>three</p></article>') == "one link two three"
    assert text('<p>one <a href="x>y">link</a> two</p>') == "one link two"
    assert text("<p title='a>b' don't>it's one</p>") == "it's one"
    assert text("<p>one</p><p clas") == "one" and text("one <!-- two") == "one" and text("<p>one<script>two") == "one"
    assert text("<p>1 < 2 <3 </ x>end</p>") == "1 < 2 <3 end" and text("<p>a<?php b ?>c<!doctype x>d</p>") == "acd"
    assert text("<SCRIPT>var a = '</scripty>'</Script >words") == "words"
    for part in ("<script ", "<a ", '<a "', "<a href=\"x ", "<p>a ", "<b>a ", "<div>a ", "</x>", "<!--", "<!-", "<title>", "= ", "<a =", "<i><p>a", "</div ", "<", "<a href='>", "<div class="):
        html = part * (1_000_000 // len(part))
        for page in (html, "<div>" * 1000 + html, html + "</b>" * 100_000 + "</x>" * 100_000):
            began = time.process_time()
            assert not re.search(r"<[a-z]", text(page))
            assert time.process_time() - began < 5, part


def test_page_classes_are_learned(spark):
    """Classes that speak of furniture on elements that hold the article do not lose it."""
    body = "<p>" + " ".join(f"word{i}" for i in range(80)) + "</p>"
    odd = [f'<body class="home no-sidebar"><article>{body}</article></body>', f'<body><article class="post has-header-image comment-open">{body}</article></body>', f'<body class="sidebar"><div class="header">{body}</div><div class="sidebar">side text here</div></body>']
    plain = [f'<body><div class="sidebar">some side text</div><article>{body}</article><div class="comment-list"><p>well said</p></div></body>'] * 5
    df = spark.createDataFrame(list(enumerate([*odd, *plain])), "page_id long, html string")
    got = {r.page_id: r.text for r in pages.main_texts(df).collect()}
    want = " ".join(f"word{i}" for i in range(80))
    assert all(got[i] == want for i in range(8))


def test_pages_whose_label_is_hidden(spark):
    """F1 of the words of pages that do not mark their article, with weights of others."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    model = pages.weights(df.where("page_id % 3 > 0"))
    scores = []
    for r in df.where("page_id % 3 = 0").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)
        want = Counter(pages.unescape(re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner[1]).replace("<b>", "").replace("</b>", "")).split())
        found = Counter(pages.extract(r.html.replace("<article>", "<div>").replace("</article>", "</div>"), model).split())
        both = sum((want & found).values())
        scores.append(2 * both / max(1, sum(want.values()) + sum(found.values())))
    assert sum(scores) / len(scores) > 0.97, sum(scores) / len(scores)


def test_best_run_is_the_best(spark):
    """The linear scan against all runs."""
    rng = random.Random(12)
    names = ["p", "div", "nav", "li"]
    model = pages.Weights(np.zeros(pages.SLOTS), np.zeros(pages.SLOTS))
    for _ in range(200):
        html = "".join(rng.choice(["", f"<{n}>"]) + "w " * rng.randrange(5) + rng.choice(["", f"</{n}>"]) for n in rng.choices(names, k=rng.randrange(1, 12)))
        page = pages.Page(html)
        words = model.blocks(page)
        value = [model.tag(n) if n else len(t.split()) * words[b] for n, t, b in page.parts]
        best = max((sum(value[i:j]) for i in range(len(value)) for j in range(i, len(value) + 1)), default=0)
        kept = pages.extract(html, model).split()
        runs = [sum(len(t.split()) for n, t, b in page.parts[i:j] if not n and words[b] > pages.DROP) for i in range(len(value)) for j in range(i, len(value) + 1) if abs(sum(value[i:j]) - best) < 1e-9]
        assert best <= 0 or len(kept) in runs


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 1), (20, 21), (22, 21), (7, 7)], "a long, b long")
    assert {(r.a, r.b) for r in components.stars(edges).collect()} == {(3, 1), (4, 1), (5, 1), (9, 1), (21, 20), (22, 20)}
    assert components.stars(edges.limit(0)).count() == 0


def test_stages_drop_row_by_row(spark, tmp_path):
    """Rows of null or repeated ids are dropped or kept by what they hold themselves; of equal rows one stays."""
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in ("ba", "co", "di") for b in ("len", "mar", "nos", "ter") for c in ("", "a", "ion")]
    plain = [" ".join(rng.choices(words, k=40)) for _ in range(480)]
    junk = ["#@%^" * 60, "{}|~" * 60]
    item = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [*enumerate(plain[:470]), (None, junk[0]), (None, plain[470]), (465, junk[1]), (None, item), (466, item), (None, plain[471]), (None, plain[471]), (467, plain[472]), (467, plain[472]), (None, plain[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    left = set(key(stages["quality"](spark, docs, str(tmp_path))))
    assert not left & {(None, junk[0]), (465, junk[1])} and {(None, plain[470]), (None, plain[471]), (465, plain[465])} <= left
    assert key(stages["near_dedup"](spark, docs, str(tmp_path))) == sorted((set(rows) - {(None, plain[0]), (None, item)}), key=str)
    assert key(stages["decontaminate"](spark, docs, str(tmp_path))) == sorted([r for r in rows if r[1] != item], key=str)


def test_stages_take_odd_tables(spark, docs, empty, tmp_path):
    """Nulls, empty texts, ties, repeated rows and clashing columns pass each stage; empty tables give none; a stage can be called twice."""
    spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "mit license")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = docs.withColumns({"starts": F.lit(1), "n_words": F.lit(2), "kept_text": F.lit("x"), "_k": F.lit(3), "_corpus_row": F.lit(4), "tags": F.create_map(F.lit("a"), F.lit(1)), "_text": F.array(F.create_map(F.lit(1), F.lit("b"))), "free": F.parse_json(F.lit('{"a": [1, "x"]}'))}).drop("n_chars")
    for name, stage in corpus_pipeline.STAGES:
        one, two = stage(spark, more, str(tmp_path)), stage(spark, more, str(tmp_path))
        assert one.count() == two.count() > 0
        assert stage(spark, empty, str(tmp_path)).count() == 0
        if name != "packing":
            assert one.columns == more.columns and one.dtypes == more.dtypes
            assert {2, 3, 4} <= {r.doc_id for r in one.collect()}
            want = (3, 4, {"a": 1}, [{1: "b"}], '{"a":[1,"x"]}', "clash")
            assert {(r._k, r._corpus_row, str(r.tags), str(r._text), r.j, r["a`tick"]) for r in one.withColumn("j", F.to_json("free")).collect()} == {tuple(str(x) if isinstance(x, (dict, list)) else x for x in want)}


def test_pipeline_against_its_parts(spark):
    """What each stage keeps follows from its own input by brute force where that is plain: near copies and passages."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        docs = corpus_pipeline.common.written(after, "test", keep=True)
        rows = {r.doc_id: r for r in docs.collect()}
        assert rows and set(rows) <= set(before)
        if name == "near_dedup":
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, r in before.items() if (w := r.text.lower().split())}
            for i in set(before) - set(rows):
                assert any(j != i and 100 * len(sets[i] & s) >= 80 * len(sets[i] | s) for j, s in sets.items())
            kept = [i for i in rows if i in sets]
            assert not any(i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i in kept for j in kept)
        if name == "substring_dedup":
            assert all(len(r.text) == r.n_chars for r in rows.values())
        if name == "decontaminate":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
            windows = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if (w := words(r.text)) for k in range(max(len(w) - 12, 1))}
            sizes = sorted({len(w) for w in windows})
            for i, r in before.items():
                w = words(r.text)
                hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
                assert (i in rows) == (not hit or 20 * len(hit) < len(w))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert "pipeline" in __spark_entry__.queries()
