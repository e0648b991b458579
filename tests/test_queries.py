"""Each registered query outside the training-data subpackage against its SQL."""

import sys

import pytest

import __spark_entry__
from noticelake import plans

from .oracle import DATA, check

QUERIES, SQL = plans.gather("noticelake.plans", plans.MODULES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_links_of_page_texts(spark, tmp_path):
    html = "<a href='/p/406-1-77,r7.php'>Real notice</a><a href='/p/403-1-78-1.php'>公告 list</a>"
    spark.createDataFrame([(1, "https://a.net/5", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {"5", "77"} <= {str(r["art_id"]) for r in QUERIES["article_links"](spark, str(tmp_path)).collect()}
    assert {"5", "78"} <= {str(r["number"]) for r in QUERIES["menu_links"](spark, str(tmp_path)).collect()}


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "title", "display_date", "remaining"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_registry_without_the_training_data_libraries(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("noticelake.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("xxhash", "noticelake.llm.simhash"):
        monkeypatch.setitem(sys.modules, name, None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
