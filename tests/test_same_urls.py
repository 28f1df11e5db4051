"""Queries whose SQL joins or groups pages by URL, on pages that share one."""

import duckdb
import pytest

from pagewright.plans.registry import all_queries
from tests.oracle import _rows


def _page(*links):
    return "<html><body><p>words of the page</p>" + "".join(f'<a href="/{x}">{x}</a> ' for x in links) + "</body></html>"


ROWS = [
    (0, "https://a.example/x", _page("a", "b")),
    (1, "https://a.example/x", _page("a", "b", "a", "c")),
    (2, "https://a.example/x", "<p></p>"),
    (3, "https://a.example/y", _page("c", "c", "d")),
    (4, "https://b.example/", _page("a")),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("same_urls")
    spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["dom_page_links", "domain_detection_rollup", "link_dedup_cap", "regression_report"])
def test_pages_of_one_url(spark, folder, name):
    query = all_queries()[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    result = con.execute(query.sql)
    columns, want = [d[0] for d in result.description], result.fetchall()
    df = query.run(spark, folder)
    assert _rows(df.columns, df.collect()) == _rows(columns, want)
