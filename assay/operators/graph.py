"""Dependency graphs as edge tables: sources of edges, linked tests, neighbours, closure and impact."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions import paths
from assay.sources.shared import written
from assay.sources.tables import sized, tasks

#: Tests that may share a word before it pairs by kinds of tests.
HOT = 1000
#: Edges, or steps of walks, that a task takes: more of them make more tasks, so that a task's memory does not grow with the graph.
PART_ROWS = 500_000
#: Pairs of source and test that a task makes of the words that they share.
PART_PAIRS = 500_000


def closure(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """request_id, node and its least number of steps from the request's start nodes against the edges (src depends on dst), up to a depth; cycles end by themselves.

    edges are a written table. Each round joins only the nodes that are new, and is written so that the plan does not grow.
    """
    seen = frontier = written(start.select("request_id", "node").distinct().withColumn("depth", F.lit(0)), "frontier")
    step = 0
    while step != depth and not frontier.isEmpty():
        step += 1
        new = edges.hint("merge").join(frontier.select("request_id", F.col("node").alias("dst")), "dst").select("request_id", F.col("src").alias("node")).distinct()
        frontier = written(new.hint("merge").join(seen, ["request_id", "node"], "left_anti").withColumn("depth", F.lit(step)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def shallow_closure(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """`closure` up to a small depth by one recursive query, whose walks are written once. Paths, not nodes, are followed, so their number grows with the depth: beyond a few steps use `closure`.

    edges are a written table. Recursion hands out its rows in as many parts as there are cores, so least depths are taken only after the walks have been dealt out anew by their number.
    """
    spark, name = edges.sparkSession, uuid.uuid4().hex
    parts = tasks(edges, edges.count() / PART_ROWS)
    views = {f"edges_{name}": edges.select("src", "dst").repartition(parts, "dst"), f"start_{name}": start.select("request_id", "node").distinct()}
    for view, df in views.items():
        df.createOrReplaceTempView(view)
    walk = f"""WITH RECURSIVE walk(request_id, node, depth) AS (SELECT request_id, node, 0 FROM start_{name}
      UNION ALL SELECT /*+ MERGE(e) */ w.request_id, e.src, w.depth + 1 FROM walk w JOIN edges_{name} e ON e.dst = w.node WHERE w.depth < {depth})
    SELECT request_id, node, depth FROM walk"""
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        walks = written(spark.sql(walk), "walk")
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
        for view in views:
            spark.catalog.dropTempView(view)
    return walks.repartition(tasks(walks, walks.count() / PART_ROWS), "request_id", "node").groupBy("request_id", "node").agg(F.min("depth").alias("depth"))


def impact(reached: DataFrame) -> DataFrame:
    """Per request: how many files, tests, docs and runbooks are reached, and the greatest depth."""
    kind = paths.source_type(F.col("node"))
    of = lambda k: F.count_if(kind == k).cast("int").alias(f"impacted_{k}s")
    return reached.groupBy("request_id").agg(F.count("*").cast("int").alias("impacted_files"), of("test"), of("doc"), of("runbook"), F.max("depth").alias("max_depth"))


def unioned(*graphs: DataFrame) -> DataFrame:
    """Edges of all graphs without self loops, each once. The graphs are read twice: their edges are counted, then dealt out by their number."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.where("src <> dst").repartition(tasks(out, out.count() / PART_ROWS), "src", "dst").distinct()


def known(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of which both ends are files."""
    return edges.join(files.select(F.col("path").alias("src")), "src", "left_semi").join(files.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")


def summary(edges: DataFrame, most: int = 12) -> DataFrame:
    """Per node its first references and referrers by name, and how many there are; edges are distinct. A hub's neighbours are ranked before they are gathered."""
    def side(a: str, b: str, name: str) -> DataFrame:
        rows = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
        first = rows.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("other"))).where(F.col("n") <= most)
        some = first.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias(name))
        return rows.groupBy("node").agg(F.count("*").alias(f"n_{name}")).hint("merge").join(some, "node")

    return side("src", "dst", "references").hint("merge").join(side("dst", "src", "referrers"), "node", "full").na.fill(0).na.fill("")


def linked_tests(sources: DataFrame, tests: DataFrame, edges: DataFrame | None = None, *, least: float = 0.45, most: int = 5, hot: int = HOT) -> DataFrame:
    """Best tests of each source path: those that share an anchor word, or a graph edge (which scores 0.8 at least).

    Words that more than `hot` tests have would pair every source with every test. What a test scores by such words alone depends
    on which of them it has and on its folders, so of each such kind only the first paths, `most` of them, are candidates: no better test is left out.
    """
    s = written(sources.select(F.col("path").alias("source"), paths.anchor_words(F.col("path")).alias("source_words")).distinct(), "sources")
    t = written(tests.where(paths.is_test(F.col("path"))).select(F.col("path").alias("test"), paths.anchor_words(F.col("path")).alias("test_words")).distinct(), "tests")
    words = t.select("test", F.explode("test_words").alias("word"))
    common = written(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("word"), "common")
    rare = words.hint("merge").join(common, "word", "left_anti").select("test", "word")
    # tests by kind: their common words and their folders
    kinds = words.hint("merge").join(common, "word").groupBy("test").agg(F.array_sort(F.collect_set("word")).alias("hot_words"))
    kinds = kinds.withColumn("kind", F.struct("hot_words", F.array_join(F.slice(F.split("test", "/"), F.lit(1), F.size(F.split("test", "/")) - 1), "/").alias("folder")))
    firsts = kinds.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("test"))).where(F.col("n") <= most).select("test", F.explode("hot_words").alias("word"))
    # the words by which a test is met; a pair is made at the first that its source has, so no pairs are made distinct
    met = written(rare.unionByName(firsts).groupBy("test").agg(F.array_sort(F.collect_list("word")).alias("keys")).hint("merge").join(t, "test"), "met")
    first = F.get(F.array_intersect("source_words", "keys"), F.lit(0))
    pairs = _pairs(s.withColumn("word", F.explode("source_words")), met.withColumn("word", F.explode("keys"))).where(F.col("word") == first)
    score = lambda rows, near: rows.withColumn("score", F.round(F.greatest(F.lit(near), paths.link_score(F.col("source"), F.col("test"), F.col("source_words"), F.col("test_words"))), 6)).where(F.col("score") >= least).select("source", "test", "score")
    w = Window.partitionBy("source").orderBy(F.desc("score"), "test")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    found = best(score(pairs, 0.0))
    if edges is not None:  # what an edge raises was found before all that it passes, so the best found are enough
        both = edges.select(F.col("src").alias("source"), F.col("dst").alias("test")).unionByName(edges.select(F.col("dst").alias("source"), F.col("src").alias("test")))
        near = score(both.hint("merge").join(s, "source").hint("merge").join(t, "test"), 0.8)
        found = best(found.drop("rank").unionByName(near).groupBy("source", "test").agg(F.max("score").alias("score")))
    return found.select("source", "test", "score", "rank")


def _pairs(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """Sources and tests of equal word, PART_PAIRS in a task: the sources of a word that makes more of them are dealt out, and meet a copy of its tests in each part."""
    count = lambda rows, n: rows.groupBy("word").agg(F.count("*").alias(n))
    loads = written(count(sources, "n").hint("merge").join(count(tests, "m"), "word", "full").select("word", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)) + F.coalesce(F.col("n") * F.col("m"), F.lit(0))).alias("load")), "loads")
    parts = tasks(loads, (loads.agg(F.sum("load")).first()[0] or 0) / PART_PAIRS)
    # a fourth of a task each, so that tasks come out even
    heavy = sized(written(loads.where(F.col("load") > PART_PAIRS / 4).select("word", F.ceil(F.col("load") / (PART_PAIRS / 4)).alias("parts")), "heavy"))
    dealt = lambda rows, part: rows.join(heavy, "word", "left").withColumn("part", part(F.coalesce("parts", F.lit(1)))).drop("parts").repartition(parts, "word", "part")
    a = dealt(sources, lambda n: F.pmod(F.xxhash64("source"), n))
    return a.hint("merge").join(dealt(tests, lambda n: F.explode(F.sequence(F.lit(0), n - 1))), ["word", "part"])


def linked_test_edges(files: DataFrame, edges: DataFrame | None = None, *, front: float = 0.45, other: float = 0.6, most: int = 3) -> DataFrame:
    """Edges from tests (src) to what their paths link them to (dst): the best tests of every file that is none, of front-end code from the one score on, of other files from the other."""
    plain = files.where(paths.source_type(F.col("path")) != "test").select("path")
    found = linked_tests(plain, files.select("path"), edges, least=min(front, other), most=most)
    least = F.when(paths.is_frontend(F.col("source")), front).otherwise(other)
    return found.where(F.col("score") >= least).select(F.col("test").alias("src"), F.col("source").alias("dst"), "score")


def support(edges: DataFrame, requests: DataFrame, files: DataFrame, *, least: float = 0.4, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(request_id, path) that may support a request and their boosts: neighbours of its changed paths, and linked tests of both."""
    changed = written(requests.select("request_id", F.explode("changed_paths").alias("node")).distinct(), "changed")
    near = written(neighbours(edges, changed).hint("merge").join(files.select(F.col("path").alias("other")), "other", "left_semi"), "near")
    sources = changed.select(F.col("node").alias("path")).unionByName(near.select(F.col("other").alias("path"))).distinct()
    linked = written(linked_tests(sources, files, edges, least=least, most=most), "linked")
    of = lambda rows, c: rows.select("request_id", F.col(c).alias("source")).hint("merge").join(linked, "source")
    own = of(changed, "node")
    paths_ = near.select("request_id", F.col("other").alias("path")).unionByName(own.select("request_id", F.col("test").alias("path"))).unionByName(of(near, "other").select("request_id", F.col("test").alias("path")))
    paths_ = written(paths_.distinct(), "support")
    boosts = paths_.select("request_id", "path", F.when(paths.is_test(F.col("path")), 0.16).otherwise(0.1).alias("boost")).unionByName(own.select("request_id", F.col("test").alias("path"), (0.12 + 0.18 * F.col("score")).alias("boost")))
    return paths_, written(boosts.groupBy("request_id", "path").agg(F.max("boost").alias("boost")), "boosts")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return both.hint("merge").join(nodes, "node").distinct()


def symbol_edges(defined: DataFrame, referenced: DataFrame) -> DataFrame:
    """Edges from files that reference a symbol to the closest other file that defines it: most shared folders, least depth, shortest, first.

    Both tables hold each row once. Of the files of one folder only the best two can be chosen (one may be the reference itself), so the others leave before the join; and
    what is closest depends on the reference's folder, so the best two are chosen for each symbol and folder, and a reference meets one row.
    """
    folders = lambda c: F.slice(F.split(c, "/"), F.lit(1), F.size(F.split(c, "/")) - 1)
    folder = lambda c: F.array_join(folders(c), "/").alias("folder")
    first = Window.partitionBy("symbol", "folder").orderBy(F.length("dst"), "dst")
    best = defined.select(F.col("path").alias("dst"), "symbol", folder("path")).withColumn("n", F.row_number().over(first)).where("n <= 2").select("dst", "symbol")
    used = written(referenced.select(F.col("path").alias("src"), "symbol", folder("path")), "references")
    pairs = used.select("symbol", "folder").distinct().hint("merge").join(written(best, "definers"), "symbol")
    shared = F.size(F.array_intersect(F.split("folder", "/"), folders(F.col("dst"))))
    w = Window.partitionBy("symbol", "folder").orderBy(F.desc(F.when(F.col("folder") == "", 0).otherwise(shared)), F.size(folders(F.col("dst"))), F.length("dst"), "dst")
    two = pairs.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy("symbol", "folder").agg(F.min(F.when(F.col("n") == 1, F.col("dst"))).alias("one"), F.min(F.when(F.col("n") == 2, F.col("dst"))).alias("two"))
    dst = F.when(F.col("one") != F.col("src"), F.col("one")).otherwise(F.col("two")).alias("dst")
    return used.hint("merge").join(two, ["symbol", "folder"]).select("src", dst, "symbol").where("dst IS NOT NULL")


def imports(files: DataFrame) -> DataFrame:
    """path and module of each import in Python, script and C sources (by line patterns); `import a, b as c` gives a and b."""
    p, c = F.col("path"), F.col("content")
    rows = lambda cond, pattern: files.where(cond).select("path", F.explode(F.regexp_extract_all(c, F.lit(pattern), F.lit(1))).alias("module"))
    listed = rows(p.endswith(".py"), r"(?m)^[ \t]*import[ \t]+([^\n#;]+)")
    plain = listed.select("path", F.explode(F.split("module", ",")).alias("module")).select("path", F.regexp_extract(F.trim("module"), r"^([A-Za-z_][\w.]*)", 1).alias("module")).where("module <> ''")
    of = rows(p.endswith(".py"), r"(?m)^[ \t]*from[ \t]+(\.*[A-Za-z_][\w.]*|\.+)[ \t]+import")
    script = rows(paths.is_script(p), r"""(?:from|import|require\(|import\()\s*["']([^"']+)["']""")
    include = rows(p.rlike(_C), r'(?m)^[ \t]*#[ \t]*include[ \t]*"([^"]+)"')
    return plain.unionByName(of).unionByName(script).unionByName(include).distinct()


_C = r"\.(c|cc|cpp|h|hpp)$"
_CODE = r"\.(py|js|jsx|ts|tsx|mjs|cjs|mts|cts|c|cc|cpp|h|hpp|java|rb)$"
#: Suffixes that a relative import may leave out, in the order in which they are tried.
_ENDS = (".ts", ".tsx", ".js", ".jsx", ".mjs")
#: Entries of a workspace, best first.
ENTRIES = ("/src/index.ts", "/src/index.tsx", "/src/index.js", "/src/index.jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def workspaces(files: DataFrame) -> DataFrame:
    """alias and root of each package: its package.json's name, that without its scope, and the folder's name under packages, apps, libs or playground; the first root by name."""
    p = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select(F.regexp_replace("path", r"/?package\.json$", "").alias("root"), F.nullif(F.trim(F.get_json_object("content", "$.name")), F.lit("")).alias("name"))
    bare = F.when(F.col("name").startswith("@") & F.col("name").contains("/"), F.regexp_replace("name", "^[^/]*/", ""))
    folder = F.regexp_extract("root", "^(?:packages|apps|libs|playground)/([^/]+)", 1)
    aliases = p.select("root", F.explode(F.array_compact(F.array("name", bare, F.nullif(folder, F.lit(""))))).alias("alias"))
    return aliases.groupBy("alias").agg(F.min("root").alias("root"))


def _relative(imported: DataFrame) -> DataFrame:
    """Paths that relative imports may mean: src, module, dst and the place in which it is tried."""
    base = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    script = imported.where("module LIKE './%' OR module LIKE '../%' OR module IN ('.', '..')").withColumn("up", F.size(F.filter(F.split("module", "/"), lambda x: x == "..")))
    kept = F.slice(base, F.lit(1), F.greatest(F.size(base) - F.col("up"), F.lit(0)))
    target = F.array_join(F.filter(F.concat(kept, F.filter(F.split("module", "/"), lambda x: ~x.isin(".", "..", ""))), lambda x: x != ""), "/")
    bare = ~F.regexp_extract(F.col("target"), r"([^/]*)$", 1).rlike(r".\.[^.]+$")
    more = F.concat(*[F.array(F.concat("target", F.lit(e)), F.concat("target", F.lit("/index" + e))) for e in _ENDS])
    tries = script.withColumn("target", target).select(F.col("path").alias("src"), "module", F.posexplode(F.concat(F.array("target"), F.when(bare, more).otherwise(F.array().cast("array<string>")))).alias("place", "dst"))
    quoted = imported.where(F.col("path").rlike(_C)).select(F.col("path").alias("src"), "module", F.lit(0).alias("place"), F.array_join(F.filter(F.concat(base, F.array("module")), lambda x: x != ""), "/").alias("dst"))
    return tries.unionByName(quoted)


def resolved(imported: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges to known files, by the first rule that finds one.

    Relative paths, by folder and suffix candidates; the module of that name; a module that ends or begins with it; a workspace's file or entry. Of several
    files the shortest path wins, then the first.
    """
    known = written(files.where(F.col("path").rlike(_CODE)).select(F.col("path").alias("dst")).distinct(), "known")
    near = _relative(imported).hint("merge").join(known, "dst", "left_semi").select("src", "module", "dst", F.col("place").alias("rule"))
    # Python's leading dots name a package; other modules are written with slashes
    level = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    base = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    parents = F.array_join(F.slice(base, F.lit(1), F.greatest(F.size(base) - level + 1, F.lit(0))), ".")
    own = F.nullif(F.regexp_replace("module", r"^\.+", ""), F.lit(""))
    dotted = F.when(F.col("path").endswith(".py") & (level > 0), F.concat_ws(".", F.nullif(parents, F.lit("")), own)).otherwise(F.replace(F.regexp_replace("module", r"\.{1,2}/", ""), F.lit("/"), F.lit(".")))
    asked = written(imported.select(F.col("path").alias("src"), "module", dotted.alias("name")), "modules")
    parts = F.split(F.regexp_replace(paths.module_name(F.regexp_replace("dst", _CODE, ".py")), r"\.index$", ""), r"\.")
    cut = known.withColumn("parts", parts)
    n = F.size("parts")
    ends = cut.select("dst", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice("parts", i, n), ".").alias("name"), F.when(i == 1, 100).otherwise(101).alias("rule")))).alias("x"))
    begins = cut.where(n > 1).select("dst", F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.array_join(F.slice("parts", F.lit(1), i), ".").alias("name"), F.lit(102).alias("rule")))).alias("x"))
    # of the files that share a name only the best two are needed (one may be the importer)
    of_name = Window.partitionBy("name", "rule").orderBy(F.length("dst"), "dst")
    names = written(ends.unionByName(begins).select("dst", "x.name", "x.rule").withColumn("n", F.row_number().over(of_name)).where("n <= 2").drop("n"), "names")
    module = asked.hint("merge").join(names, "name").select("src", "module", "dst", "rule")
    # workspaces: alias, then the rest of the path
    scoped = F.col("module").startswith("@")
    seg = F.split("module", "/")
    package = F.array_join(F.slice(seg, F.lit(1), F.when(scoped, 2).otherwise(1)), "/")
    rest = F.array_join(F.slice(seg, F.when(scoped, 3).otherwise(2), F.size(seg)), "/")
    outside = imported.where("module NOT LIKE '.%'").select(F.col("path").alias("src"), "module", package.alias("package"), rest.alias("rest"))
    tries = outside.withColumn("alias", F.explode(F.array_distinct(F.array("package", F.when(F.col("package").startswith("@"), F.regexp_replace("package", "^[^/]*/", "")).otherwise(F.col("package"))))))
    roots = tries.hint("merge").join(written(workspaces(files), "workspaces"), "alias").groupBy("src", "module", "rest").agg(F.min_by("root", F.when(F.col("alias") == F.col("package"), 0).otherwise(1)).alias("root"))
    roots = written(roots, "package-imports")
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    ending = F.regexp_replace("rest", r"^(\./)+", "")
    # a file fits the rest of a module by its stem or by its end: keys to join by, not pairs to compare; of the files that share one, and of a root's, the best two are enough
    asked_roots = sized(written(roots.groupBy("root").agg(F.collect_set(F.when(F.col("rest") != "", F.length(ending))).alias("lengths")), "roots"))
    folders = known.select("dst", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("dst", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("dst", "/"), F.lit(1), i), "/"))).alias("root"))
    held = written(folders.join(asked_roots, "root"), "inside")
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    bare = F.regexp_replace("dst", _CODE, "")
    ends_of = F.transform("lengths", lambda n: key("end", F.substr(bare, F.greatest(F.length(bare) - n + 1, F.lit(1)), n)))
    of_key = Window.partitionBy("root", "kind", "key").orderBy(F.size(F.split("dst", "/")), F.length("dst"), "dst")
    wanted = roots.where("rest <> ''").select("src", "module", "root", F.explode(F.array(key("stem", stem("rest")), key("end", ending))).alias("k")).select("src", "module", "root", "k.*")
    keyed = held.select("dst", "root", F.explode(F.array_distinct(F.concat(F.array(key("stem", stem("dst"))), ends_of))).alias("k")).select("dst", "root", "k.*")
    keyed = keyed.hint("merge").join(wanted.select("root", "kind", "key").distinct(), ["root", "kind", "key"], "left_semi")
    fitting = wanted.hint("merge").join(keyed.withColumn("n", F.row_number().over(of_key)).where("n <= 2"), ["root", "kind", "key"]).select("src", "module", "dst", F.lit(103).alias("rule"))
    entry = F.coalesce(F.array_position(F.transform(F.array(*[F.lit(e) for e in ENTRIES]), lambda e: F.concat("root", e)), F.col("dst")), F.lit(0))
    other = F.when(F.contains("dst", F.lit("/src/")), 200).otherwise(300)
    of_root = Window.partitionBy("root").orderBy("rule", F.size(F.split("dst", "/")), F.length("dst"), "dst")
    firsts = held.select("dst", "root", F.when(entry > 0, 110 + entry).otherwise(other).cast("int").alias("rule")).withColumn("n", F.row_number().over(of_root)).where("n <= 2").drop("n")
    from_package = roots.join(sized(written(firsts, "firsts")), "root").select("src", "module", "dst", "rule").unionByName(fitting)
    hits = near.unionByName(module).unionByName(from_package)
    w = Window.partitionBy("src", "module").orderBy("rule", F.when(F.col("rule") >= 103, F.size(F.split("dst", "/"))).otherwise(0), F.length("dst"), "dst")
    return hits.where("src <> dst").withColumn("n", F.row_number().over(w)).where("n = 1").select("src", "dst").distinct()


def frontend_edges(files: DataFrame) -> DataFrame:
    """Edges from tests to the components that they fit: shared front-end words, of which the component's stem (or its folder, for generic stems) is one, or two, or its only one."""
    words = lambda c: paths.frontend_words(F.col(c))
    s = written(files.where((paths.source_type(F.col("path")) != "test") & paths.is_frontend(F.col("path"))).select(F.col("path").alias("dst"), words("path").alias("dst_words")).distinct(), "components")
    t = written(files.where(paths.source_type(F.col("path")) == "test").select(F.col("path").alias("src"), words("path").alias("src_words")).distinct(), "component-tests")
    stem = F.lower(paths.stem(F.col("dst")))
    generic = stem.isin("index", "page", "route", "layout", "loading", "error")
    parent = F.lower(F.element_at(F.split("dst", "/"), -2))
    both = F.array_intersect("dst_words", "src_words")
    # one shared word is enough if it is the stem, the folder or the only one: a join on that word
    keys = F.array_distinct(F.array_compact(F.array(F.when(generic, parent).otherwise(stem), F.when(F.size("dst_words") == 1, F.get("dst_words", F.lit(0))))))
    one = s.select("dst", "dst_words", F.explode(keys).alias("word")).hint("merge").join(t.select("src", "src_words", F.explode("src_words").alias("word")), "word")
    fits = (~generic & F.array_contains("src_words", stem)) | (generic & F.array_contains(both, parent)) | (F.size("dst_words") == 1)
    one = one.where((F.size(both) == 1) & fits).select("src", "dst").distinct()
    # two shared words: in an order of words, common ones last, the first shared one is not a file's last, so words that everything has pair nothing; a pair counts at its first
    every = s.select(F.explode("dst_words").alias("word")).unionByName(t.select(F.explode("src_words").alias("word")))
    common = sized(written(every.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "common-words"))

    def ordered(df: DataFrame, path: str, held: str) -> DataFrame:
        rows = df.select(path, F.explode(held).alias("word")).join(common, "word", "left")
        return rows.groupBy(path).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))), lambda x: x["word"]).alias(held)).where(F.size(held) > 1)

    early = lambda held: F.explode(F.slice(held, F.lit(1), F.size(held) - 1)).alias("word")
    two = ordered(s, "dst", "dst_words").select("dst", "dst_words", early("dst_words")).hint("merge").join(ordered(t, "src", "src_words").select("src", "src_words", early("src_words")), "word")
    two = two.withColumn("both", both).where((F.size("both") > 1) & (F.get("both", F.lit(0)) == F.col("word"))).select("src", "dst")
    return one.unionByName(two)
