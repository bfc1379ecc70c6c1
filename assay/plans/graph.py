"""Queries on dependency graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.functions import fixed, paths
from assay.operators import graph
from assay.plans.rules import link_sql, listed, stem_sql, words_sql
from assay.sources import exports
from assay.sources.shared import once
from assay.sources.tables import CORPUS_SQL, corpus, table


def key_graph(spark, d):
    """Keys as a graph, written once: orders depend on customers, customers and suppliers on nations, nations on regions, parts on suppliers."""
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    pair = lambda t, p, a, q, b: table(spark, d, t).select(n(p, a).alias("src"), n(q, b).alias("dst"))
    return once(spark, d, "key-graph", lambda: graph.unioned(
        pair("orders", "o", "o_orderkey", "c", "o_custkey"), pair("customer", "c", "c_custkey", "n", "c_nationkey"), pair("supplier", "s", "s_suppkey", "n", "s_nationkey"),
        pair("nation", "n", "n_nationkey", "r", "n_regionkey"), pair("lineitem", "p", "l_partkey", "s", "l_suppkey"),
    ))


def graph_union(spark, d):
    return key_graph(spark, d).groupBy(F.left("src", F.lit(1)).alias("src_kind"), F.left("dst", F.lit(1)).alias("dst_kind")).agg(F.count("*").alias("n_edges"), F.count_distinct("dst").alias("n_targets"))


def blast_radius_closure(spark, d):
    """All that each region reaches, as a request of its own."""
    start = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("request_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.closure(key_graph(spark, d), start).select("request_id", "node", "depth")


def dependency_depth(spark, d):
    """What each nation reaches in two steps at most, as one recursive query."""
    start = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("request_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.shallow_closure(key_graph(spark, d), start, 2)


def graph_documents(spark, d):
    return graph.summary(key_graph(spark, d))


def linked_tests_topk(spark, d):
    c = corpus(spark, d)
    sources = c.where("source_type = 'code'").select("path")
    return graph.linked_tests(sources, c.select("path"), least=0.3, most=3)


def linked_test_edges(spark, d):
    """Tests as dependents of all files that their paths link them to, by the floors for front-end and other files."""
    return graph.linked_test_edges(corpus(spark, d))


def symbol_edges(spark, d):
    """Suppliers define the parts that they deliver, orders reference them."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    sym = F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol")
    defined = li.select(F.concat(F.lit("lib/g"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/s"), F.col("l_suppkey").cast("string")).alias("path"), sym).distinct()
    used = li.select(F.concat(F.lit("app/g"), (F.col("l_orderkey") % 7).cast("string"), F.lit("/o"), F.col("l_orderkey").cast("string")).alias("path"), sym).distinct()
    return graph.symbol_edges(defined, used)


def sources(spark, d):
    """A source tree made of suppliers, customers and nations: Python modules, scripts, packages of a workspace, components and their tests."""
    t = lambda c: F.col(c).cast("string")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("k"))
    py = s.select(
        F.format_string("pkgs/n%d/mod%d.py", "k", "s").alias("path"),
        F.concat(F.format_string("import os, pkgs.n%d.mod%d as m  # one line\nfrom .mod%d import x\n", "k", F.col("s") + 1, F.col("s") + 2), F.format_string("from n%d.mod%d import y\nimport pkgs.n%d\n", (F.col("k") + 1) % 25, F.col("s") + 5, (F.col("k") + 2) % 25)).alias("content"),
    )
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("k"))
    kit = lambda p: F.concat(F.lit(p), ((F.col("k") + 1) % 25).cast("string"))
    ts = c.select(
        F.format_string("packages/kit%d/src/item%d.ts", "k", "c").alias("path"),
        F.concat(F.lit("import a from './item"), (F.col("c") + 1).cast("string"), F.lit("'\nimport b from '../../kit"), t("k"), F.lit("/src/item"), (F.col("c") + 2).cast("string"), F.lit("'\nimport {c} from '"), kit("@org/kit"), F.lit("'\nconst d = require('"), kit("lib"), F.lit("/item"), (F.col("c") + 3).cast("string"), F.lit("')\n")).alias("content"),
    )
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    package = n.select(F.format_string("packages/kit%d/package.json", "k").alias("path"), F.concat(F.lit('{"name": "@org/kit'), t("k"), F.lit('"}')).alias("content"))
    library = n.select(F.format_string("libs/lib%d/package.json", "k").alias("path"), F.lit("{}").alias("content"))
    within = c.select(F.format_string("libs/lib%d/deep/item%d.ts", "k", "c").alias("path"), F.lit("").alias("content"))
    entry = n.where("k % 2 = 0").select(F.format_string("packages/kit%d/src/index.ts", "k").alias("path"), F.lit("").alias("content"))
    ui = s.select(F.format_string("web/components/g%d/Panel%dCard.tsx", "k", "s").alias("path"), F.lit("").alias("content"))
    spec = s.select(F.format_string("web/specs/g%d/Panel%dCard.test.tsx", F.col("k"), F.col("s")).alias("path"), F.lit("").alias("content"))
    out = py
    for part in (ts, package, library, within, entry, ui, spec):
        out = out.unionByName(part)
    return once(spark, d, "sources", lambda: out)


def module_imports(spark, d):
    return graph.imports(sources(spark, d))


def resolved_imports(spark, d):
    files = sources(spark, d)
    return graph.resolved(graph.imports(files), files)


def package_aliases(spark, d):
    return graph.workspaces(sources(spark, d))


def frontend_test_edges(spark, d):
    return graph.frontend_edges(sources(spark, d))


def chain_ends(spark, d):
    """Orders as chains: each points to the next one of its customer, and a customer's last to its first where the key is even."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = o.select(F.col("o_orderkey").cast("string").alias("a"), F.lead("o_orderkey").over(w).alias("b"), F.min("o_orderkey").over(Window.partitionBy("o_custkey")).alias("first"), "o_custkey")
    return exports.chain_ends(n.withColumn("b", F.coalesce("b", F.when(F.col("o_custkey") % 2 == 0, F.col("first"))).cast("string")).where("b IS NOT NULL").select("a", "b"))


def path_words(spark, d):
    return sources(spark, d).select("path", F.array_join(paths.frontend_words(F.col("path")), ",").alias("frontend_words"), F.array_join(paths.anchor_words(F.col("path")), ",").alias("anchor_words"), paths.normalized(F.concat(F.lit("file:///"), F.replace("path", F.lit("/"), F.lit("%2F")))).alias("from_url"))


QUERIES = {f.__name__: f for f in (module_imports, resolved_imports, package_aliases, frontend_test_edges, chain_ends, path_words, graph_union, blast_radius_closure, dependency_depth, graph_documents, linked_tests_topk, linked_test_edges, symbol_edges)}

_KEYS = """edges AS (SELECT DISTINCT * FROM (SELECT 'o' || o_orderkey src, 'c' || o_custkey dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem))"""
_TREE = """s AS (SELECT s_suppkey s, s_nationkey k, 'pkgs/n' || s_nationkey || '/mod' || s_suppkey || '.py' path FROM supplier), c AS (SELECT c_custkey c, c_nationkey k, 'packages/kit' || c_nationkey || '/src/item' || c_custkey || '.ts' path FROM customer)"""
_FRONT = f"""list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(list_transform(list_concat(string_split(path, '/')[-4:], [CASE WHEN lower({stem_sql('path')}) IN ({listed(fixed.FRONTEND_WORDS)}) AND len(string_split(path, '/')) > 1 THEN string_split(path, '/')[-2] ELSE {stem_sql('path')} END]), lambda x: regexp_replace(x, '(.)\\.[^.]*$', '\\1')), lambda x: lower(x) NOT IN ({listed(fixed.FRONTEND_WORDS)})),
  lambda x: list_concat(list_transform(regexp_extract_all(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda y: lower(y)), [lower(array_to_string(regexp_extract_all(x, '[A-Za-z0-9]+'), ''))]))), lambda w: length(w) >= 3 AND w NOT IN ({listed(fixed.FRONTEND_WORDS)}))))"""
_ALL = """f AS (SELECT path FROM s UNION ALL SELECT path FROM c UNION ALL SELECT 'packages/kit' || n_nationkey || '/package.json' FROM nation UNION ALL SELECT 'libs/lib' || n_nationkey || '/package.json' FROM nation UNION ALL SELECT 'libs/lib' || k || '/deep/item' || c || '.ts' FROM c
  UNION ALL SELECT 'packages/kit' || n_nationkey || '/src/index.ts' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'web/components/g' || k || '/Panel' || s || 'Card.tsx' FROM s UNION ALL SELECT 'web/specs/g' || k || '/Panel' || s || 'Card.test.tsx' FROM s)"""
_RESOLVED = f"""WITH {_TREE},
z AS (SELECT k, min((length(path), path))[2] best FROM s GROUP BY k), kits AS (SELECT k, min((length(path), path))[2] best FROM c GROUP BY k), e AS (
  SELECT a.path src, b.path dst FROM s a JOIN s b ON b.s = a.s + 1 AND b.k = a.k UNION ALL SELECT a.path, b.path FROM s a JOIN s b ON b.s = a.s + 2 AND b.k = a.k UNION ALL SELECT a.path, b.path FROM s a JOIN s b ON b.s = a.s + 5 AND b.k = (a.k + 1) % 25
  UNION ALL SELECT a.path, best FROM s a JOIN z ON z.k = (a.k + 2) % 25 UNION ALL SELECT a.path, b.path FROM c a JOIN c b ON b.c = a.c + 1 AND b.k = a.k UNION ALL SELECT a.path, 'libs/lib' || b.k || '/deep/item' || b.c || '.ts' FROM c a JOIN c b ON b.c = a.c + 1 AND b.k <> a.k UNION ALL SELECT a.path, b.path FROM c a JOIN c b ON b.c = a.c + 2 AND b.k = a.k
  UNION ALL SELECT a.path, CASE WHEN (a.k + 1) % 25 % 2 = 0 THEN 'packages/kit' || ((a.k + 1) % 25) || '/src/index.ts' ELSE best END FROM c a LEFT JOIN kits ON kits.k = (a.k + 1) % 25 WHERE (a.k + 1) % 25 % 2 = 0 OR best IS NOT NULL
  UNION ALL SELECT a.path, coalesce('libs/lib' || b.k || '/deep/item' || b.c || '.ts', (SELECT min((length(x), x))[2] FROM (SELECT 'libs/lib' || o.k || '/deep/item' || o.c || '.ts' x FROM c o WHERE o.k = (a.k + 1) % 25))) FROM c a LEFT JOIN c b ON b.c = a.c + 3 AND b.k = (a.k + 1) % 25)"""
ORACLE_SQL = {
    "module_imports": f"""WITH {_TREE} SELECT path, unnest(['os', 'pkgs.n' || k || '.mod' || (s + 1), '.mod' || (s + 2), 'n' || ((k + 1) % 25) || '.mod' || (s + 5), 'pkgs.n' || ((k + 2) % 25)]) "module" FROM s
        UNION ALL SELECT path, unnest(['./item' || (c + 1), '../../kit' || k || '/src/item' || (c + 2), '@org/kit' || ((k + 1) % 25), 'lib' || ((k + 1) % 25) || '/item' || (c + 3)]) FROM c""",
    "resolved_imports": f"{_RESOLVED} SELECT DISTINCT src, dst FROM e WHERE src <> dst AND dst IS NOT NULL",
    "package_aliases": "SELECT unnest(['@org/kit' || n_nationkey, 'kit' || n_nationkey]) alias, 'packages/kit' || n_nationkey root FROM nation UNION ALL SELECT 'lib' || n_nationkey, 'libs/lib' || n_nationkey FROM nation",
    "frontend_test_edges": f"""WITH {_TREE}, {_ALL}, w AS (SELECT path, {_FRONT} w, path LIKE '%.test.tsx' test FROM f WHERE path LIKE '%.tsx')
        SELECT t.path src, p.path dst FROM w t, w p WHERE t.test AND NOT p.test AND (list_contains(t.w, lower({stem_sql('p.path')})) OR len(list_intersect(t.w, p.w)) >= 2 OR (len(p.w) = 1 AND len(list_intersect(t.w, p.w)) = 1))""",
    "chain_ends": """SELECT CAST(o_orderkey AS VARCHAR) a, CASE WHEN o_custkey % 2 = 0 THEN least_ ELSE CAST(last_ AS VARCHAR) END b FROM (SELECT o_orderkey, o_custkey, min(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey) least_, max(o_orderkey) OVER (PARTITION BY o_custkey) last_ FROM orders) WHERE o_custkey % 2 = 0 OR o_orderkey < last_""",
    "path_words": f"WITH {_TREE}, {_ALL} SELECT path, array_to_string({_FRONT}, ',') frontend_words, array_to_string({words_sql('path')}, ',') anchor_words, '/' || path from_url FROM f",
    "graph_union": f"WITH {_KEYS} SELECT src[1] src_kind, dst[1] dst_kind, count(*) n_edges, count(DISTINCT dst) n_targets FROM edges GROUP BY ALL",
    "blast_radius_closure": f"WITH RECURSIVE {_KEYS}, walk AS (SELECT CAST(r_regionkey AS BIGINT) request_id, 'r' || r_regionkey node, 0 depth FROM region UNION SELECT request_id, src, depth + 1 FROM walk JOIN edges ON dst = node) SELECT request_id, node, CAST(min(depth) AS INTEGER) depth FROM walk GROUP BY ALL",
    "dependency_depth": f"WITH RECURSIVE {_KEYS}, walk AS (SELECT CAST(n_nationkey AS BIGINT) request_id, 'n' || n_nationkey node, 0 depth FROM nation UNION SELECT request_id, src, depth + 1 FROM walk JOIN edges ON dst = node WHERE depth < 2) SELECT request_id, node, CAST(min(depth) AS INTEGER) depth FROM walk GROUP BY ALL",
    "graph_documents": f"""WITH {_KEYS}, a AS (SELECT src node, count(*) n, array_to_string(list_sort(list(dst))[:12], ',') x FROM edges GROUP BY src), b AS (SELECT dst node, count(*) n, array_to_string(list_sort(list(src))[:12], ',') x FROM edges GROUP BY dst)
        SELECT node, coalesce(a.n, 0) n_references, coalesce(a.x, '') "references", coalesce(b.n, 0) n_referrers, coalesce(b.x, '') referrers FROM a FULL JOIN b USING (node)""",
    "linked_tests_topk": f"""WITH {CORPUS_SQL}, s AS (SELECT path source, {words_sql('path')} sw FROM docs WHERE source_type = 'code'), t AS (SELECT path test, {words_sql('path')} tw FROM docs WHERE source_type = 'test'),
        p AS (SELECT source, test, round({link_sql('source', 'test', 'sw', 'tw')}, 6) score FROM s, t)
        SELECT source, test, CAST(score AS DOUBLE) score, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, test) rank FROM p WHERE score >= 0.3) WHERE rank <= 3""",
    "linked_test_edges": f"""WITH {CORPUS_SQL}, s AS (SELECT path source, {words_sql('path')} sw FROM docs WHERE source_type <> 'test'), t AS (SELECT path test, {words_sql('path')} tw FROM docs WHERE source_type = 'test'),
        p AS (SELECT source, test, round({link_sql('source', 'test', 'sw', 'tw')}, 6) score FROM s, t)
        SELECT test src, source dst, CAST(score AS DOUBLE) score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, test) rank FROM p WHERE score >= CASE WHEN source LIKE 'web/%.tsx' THEN 0.45 ELSE 0.6 END) WHERE rank <= 3""",
    "symbol_edges": """WITH l AS (SELECT DISTINCT 'lib/g' || (l_suppkey % 7) || '/s' || l_suppkey dst, 'P' || l_partkey symbol, l_suppkey % 7 dg FROM lineitem), u AS (SELECT DISTINCT 'app/g' || (l_orderkey % 7) || '/o' || l_orderkey src, 'P' || l_partkey symbol, l_orderkey % 7 sg FROM lineitem)
        SELECT src, dst, symbol FROM (SELECT src, dst, symbol, row_number() OVER (PARTITION BY src, symbol ORDER BY CASE WHEN sg = dg THEN 1 ELSE 0 END DESC, length(dst), dst) n FROM u JOIN l USING (symbol)) WHERE n = 1""",
}
