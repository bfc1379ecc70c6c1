import pytest
from oracle import same

from assay.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, registry.queries()[name], SQL[name], "/root/testdata/sf0.001")


def test_references_without_a_semicolon_equal_sql(spark, tmp_path):
    """A reference may end without its semicolon, and is decoded once."""
    html = ["<p>R&&amp To &amp;amp; x &ampy</p>", "a &lt b &gt;c &quotd&nbspe &copy f &middot;g &amplt;", "<b>&#39;&lt;&amp</b>&amp", None]
    rows = [(i, f"https://h.example.com/p/{i}", x) for i, x in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").where("html IS NOT NULL").coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    for name in ("html_pages", "export_wiki"):
        same(spark, registry.queries()[name], SQL[name], str(tmp_path))
