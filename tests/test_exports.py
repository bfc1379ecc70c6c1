import json

from assay.sources import exports


def put(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(folder)


def test_tickets_take_nested_names(spark, tmp_path):
    p = put(tmp_path, "t.json", {"issues": [{"key": "KEY-31", "summary": "Slow queue", "description": "<p>Drain &amp; refill</p>", "status": {"name": "Done"}, "issuetype": {"name": "Bug"}, "labels": ["a", "b"], "creator": {"displayName": "Kim"}, "updated": "2025-01-02T03:04:05Z"}]})
    r = exports.tickets(spark, p).first()
    assert r.path == "external_jira/KEY-31.md" and r.source_type == "doc" and "Status: Done" in r.content and "Drain & refill" in r.content and r.author == "Kim" and r.time.year == 2025


def test_pull_requests_and_incidents(spark, tmp_path):
    p = put(tmp_path / "a", "p.json", {"pulls": [{"number": 7, "title": "T", "body": "B", "labels": [{"name": "x"}], "files": [{"filename": "a.py"}, {"path": "b.py"}], "user": {"login": "u"}}]})
    r = exports.pull_requests(spark, p).first()
    assert r.path == "external_github_prs/pr_7.md" and "Labels: x" in r.content and "Files: a.py, b.py" in r.content
    q = put(tmp_path / "b", "i.json", [{"incident_number": 88, "title": "Down", "service": {"summary": "S"}, "created_at": "2025-02-03T00:00:00Z"}])
    assert exports.pager_incidents(spark, q).first().path == "external_pagerduty/88.md"
    assert exports.sources(spark, [("github", p), ("prs", p), ("pager", q)]).count() == 2


def test_wiki_url_is_base_and_webui(spark, tmp_path):
    p = put(tmp_path, "w.json", {"results": [{"title": "Queue Layout", "body": {"storage": {"value": "<h1>x</h1>"}}, "space": {"key": "OPS"}, "_links": {"base": "https://w/", "webui": "/p/1"}}]})
    r = exports.wiki_pages(spark, p).first()
    assert r.path == "external_confluence/OPS/Queue-Layout.md" and r.external_url == "https://w/p/1"


def test_chat_threads(spark, tmp_path):
    put(tmp_path / "ops", "c.json", [{"ts": "2.0", "thread_ts": "1.0", "text": "later", "user": "b"}, {"ts": "1.0", "text": "first", "user": "a"}, {"ts": "3.0", "text": " "}])
    r = exports.chat_threads(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].content == "a: first\nb: later" and r[0].author == "a" and r[0].path == "external_slack/ops/1.0.md"


def test_repository_skips_folders_below_the_root(spark, tmp_path):
    root = tmp_path / "build" / "repo"
    put(root / "src", "a.py", "x = 1")
    put(root / "node_modules", "b.js", "y")
    put(root / "docs", "e.md", "  ")
    put(root / "docs", "i.png", "z")
    assert [(r.path, r.source_type) for r in exports.repository(spark, str(root)).collect()] == [("src/a.py", "code")]


def test_graph_dumps(spark, tmp_path):
    rows = [
        {"id": "1", "type": "vertex", "label": "document", "uri": "file:///repo/app/start.ts"}, {"id": "2", "type": "vertex", "label": "document", "uri": "file:///repo/app/queue.ts"},
        {"id": "5", "type": "edge", "label": "contains", "outV": "1", "inVs": ["10"]}, {"id": "6", "type": "edge", "label": "contains", "outV": "2", "inVs": ["11"]},
        {"id": "7", "type": "edge", "label": "next", "outV": "10", "inV": "20"}, {"id": "8", "type": "edge", "label": "textDocument/definition", "outV": "20", "inV": "30"}, {"id": "9", "type": "edge", "label": "item", "outV": "30", "inVs": ["11"]},
    ]
    p = put(tmp_path / "l", "dump.lsif", "\n".join(map(json.dumps, rows)))
    assert [tuple(r) for r in exports.lsif_edges(spark, p).collect()] == [("app/start.ts", "app/queue.ts", "graph reference")]
    q = put(tmp_path / "s", "i.json", {"documents": [{"relative_path": "a.ts", "occurrences": [{"symbol": "S"}]}, {"relative_path": "b.ts", "symbols": [{"symbol": "S", "relationships": []}]}]})
    assert [tuple(r) for r in exports.scip_edges(spark, q).collect()] == [("a.ts", "b.ts", "S", "occurrence")]


def test_rich_text_and_merge(spark):
    node = lambda kind, *inner, **more: {"type": kind, "content": list(inner), **more}
    leaf = lambda t: {"type": "text", "text": t}
    trees = {
        "spaced": ({"content": [leaf('a "q"'), {"content": [leaf("b")]}]}, 'a "q" b'),
        "paragraphs": (node("doc", node("paragraph", leaf("one "), leaf("two")), node("heading", leaf("three"), leaf("four"))), "one\ntwo three\nfour"),
        "breaks": (node("paragraph", leaf("a"), {"type": "hardBreak"}, leaf("b")), "a\n\n\nb"),
        "own text": (node("paragraph", leaf("hidden"), text=" shown "), "shown"),
        "attributes": (node("doc", node("paragraph", leaf("seen"), attrs={"text": "unseen"})), "seen"),
        "blank text": (node("doc", leaf("  "), leaf("x"), text=" "), "x"),
        "list": ([leaf("a"), [leaf("b"), []], "  c "], "a\nb\nc"),
        "deep": (node("doc", node("list", node("item", node("item", node("paragraph", leaf("down")))), node("item")), leaf("up")), "down up"),
        "number": (7, ""), "empty": ({}, ""), "string": (" s ", "s"), "odd": ({"content": "no list"}, ""),
    }
    df = spark.createDataFrame([(k, json.dumps(t)) for k, (t, _) in trees.items()] + [("broken", '{"text": '), ("null", None)], "key string, tree string")
    assert {r.key: r.text for r in exports.rich_texts(df, "key", "tree").collect()} == {k: t for k, (_, t) in trees.items()} | {"broken": "", "null": ""}
    h, r = spark.createDataFrame([("c", "1", "old")], ["channel", "ts", "text"]), spark.createDataFrame([("c", "1", "new")], ["channel", "ts", "text"])
    assert exports.merged_messages(h, r).first().text == "new"


def test_notes_of_both_kinds(spark, tmp_path):
    put(tmp_path / "a", "n.json", {"name": "Outage", "details": "All down", "owner": "Lee", "occurred_at": "2025-01-02T03:04:05Z"})
    put(tmp_path / "a", "m.md", "# Later\n")
    got = {r.path: r for r in exports.incident_notes(spark, str(tmp_path)).collect()}
    assert got["external_incidents/a/n.md"].content.startswith("# Incident: Outage\n\n- Author: Lee\n- Timestamp: 2025-01-02") and got["external_incidents/a/n.md"].content.endswith("\n\nAll down")
    assert got["external_incidents/a/m.md"].content == "# Later\n"


def test_roots_with_signs_and_bad_bytes(spark, tmp_path):
    root = tmp_path / "c++"
    put(root / "src", "a.cc", "int a;")
    (root / "src" / "b.md").write_bytes(b"ok \xff\xfe end")
    assert {(r.path, r.content) for r in exports.repository(spark, str(root)).collect()} == {("src/a.cc", "int a;"), ("src/b.md", "ok  end")}


def test_chains_and_cycles_end(spark):
    n = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("p", "q"), ("q", "r"), ("t", "u"), ("u", "b"), *[(f"x{i:02}", f"x{i + 1:02}") for i in range(20)], ("x20", "y1"), ("y1", "y2"), ("y2", "y1")], "a string, b string")
    got = {r.a: r.b for r in exports.chain_ends(n).collect()}
    assert [got[x] for x in "abcpqtu"] == ["a", "a", "a", "r", "r", "a", "a"] and {got[x] for x in got if x[0] in "xy"} == {"y1"}


def test_payloads_become_records(spark):
    one = lambda f, p: json.loads(f(spark.createDataFrame([(json.dumps(p),)], "record string")).first().record)
    assert one(exports.flattened_pulls, {"number": 3, "title": "T", "user": {"login": "u"}, "labels": [{"name": "x"}, {"name": ""}], "other": 1})["labels"] == [{"name": "x"}]
    t = one(lambda df: exports.flattened_tickets(df, "https://h/"), {"key": "K-1", "fields": {"summary": "S", "description": {"content": [{"text": "deep"}]}}})
    assert t["description"] == "deep" and t["browse_url"] == "https://h/browse/K-1"
    p = one(lambda df: exports.flattened_pages(df, "https://h/wiki/"), {"content": {"title": "P", "_links": {"webui": "https://h/wiki/x/1"}}})
    assert p["_links"] == {"base": "https://h/wiki", "webui": "/wiki/x/1"} and p["body"]["storage"]["value"] == "No page body provided."
    assert one(exports.flattened_incidents, {"id": "7", "summary": "s", "service": {"name": "n"}})["service"] == {"summary": "n"}


def test_records_are_parsed_once(spark, tmp_path):
    p = put(tmp_path, "a.json", '{"pulls": null, "items": [{"number": 1, "number": 2, "title": "last"}, null, {"number": 3, "labels": ["x", null, {"name": "y"}, {"other": 1}]}]}')
    put(tmp_path, "b.json", "not json")
    put(tmp_path, "c.json", "")
    put(tmp_path, "d.json", {"number": 4, "title": "alone"})
    put(tmp_path, "e.json", "[]")
    docs = exports.pull_requests(spark, p)
    assert sorted((r.path, r.content) for r in docs.collect()) == [
        ("external_github_prs/pr_2.md", "# PR 2: last\n"), ("external_github_prs/pr_3.md", "# PR 3: \nLabels: x, y\n"), ("external_github_prs/pr_4.md", "# PR 4: alone\n"),
    ]
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    # once for files, once for the members of arrays too large for a VARIANT
    assert plan.count("parseJson(") == 2


def test_arrays_too_large_for_a_variant(spark, tmp_path, monkeypatch):
    p = put(tmp_path, "a.json", {"pulls": [{"number": 1, "title": "a"}, {"number": 2, "labels": [{"name": "x"}]}]})
    put(tmp_path, "b.json", [{"number": 3}])
    want = sorted((r.path, r.content) for r in exports.pull_requests(spark, p).collect())
    # as if no file fitted
    monkeypatch.setattr(exports, "parsed", lambda rows, column, name: rows.withColumn(name, exports.F.lit(None).cast("variant")))
    assert sorted((r.path, r.content) for r in exports.pull_requests(spark, p).collect()) == want and len(want) == 3


def test_summaries_keep_the_digits_that_lines_end_in(spark):
    files = spark.createDataFrame([("a.py", "call 10\nline 1  \n\nlast 22"), ("b.py", "x 0")], ["path", "content"])
    edges = spark.createDataFrame([("a.py", "b.py", "s", "occurrence")], ["src", "dst", "symbol", "kind"])
    got = {r.path: r.content for r in exports.graph_summaries(edges, files, "e").collect()}
    assert "call 10\nline 1\nlast 22" in got["a.py"] and "x 0" in got["b.py"]


def test_notes_are_written_in_place(spark, monkeypatch):
    """Files of notes are named by their writers: none is renamed by the driver."""
    from assay.plans import exports as plans

    assert not hasattr(plans, "_named")
    monkeypatch.setattr(plans, "TASK_FILES", 3)
    rows = {r.k: r for r in plans.export_notes(spark, "/root/testdata/sf0.001").collect()}
    n = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    assert len(rows) == n and {r.author for r in rows.values()} == {"ops", None}


def test_rounds_of_chains_go_by_the_longest_one(spark, monkeypatch):
    """Cycles end once they have been gone round, in far fewer rounds than there are nodes; tails, loops and ends without a next keep their ends."""
    rounds, write = [], exports.written
    monkeypatch.setattr(exports, "written", lambda df, name="table", *a: (rounds.append(name), write(df, name, *a))[1])
    nexts = {f"c{i}_{k}": f"c{i}_{(k + 1) % 3}" for i in range(40) for k in range(3)} | {"a0": "a1", "a1": "c1_2", "l": "l", "m": "l", "p": "q", "q": None}
    got = {r.a: r.b for r in exports.chain_ends(spark.createDataFrame(list(nexts.items()), "a string, b string")).collect()}
    assert got == {k: k[:-1] + "0" if k[0] == "c" else {"a0": "c1_0", "a1": "c1_0", "l": "l", "m": "l", "p": "q", "q": None}[k] for k in nexts}
    assert rounds.count("chain") <= 5
