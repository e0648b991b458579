import pytest
from pyspark.sql import functions as F

from noticelake.functions import text as X
from noticelake.operators import extract


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "z int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, category", [("第一次段考試場公告", "段考考試"), ("繁星推薦說明", "升學"), ("清寒獎學金申請", "獎助學金"), ("恭賀本校同學", "榮譽榜"), ("科展報名", "競賽"), ("社團成果", "社團"), ("職涯講座", "研習活動"), ("新生編班", "招生編班"), ("停車場施工", "行政公告"), ("其他", "一般")])
def test_classify(spark, text, category):
    assert one(spark, X.classify(F.col("t")), t=text) == category


@pytest.mark.parametrize("text, damaged", [("公告", False), ("�公告", True), ("a\x07b", True), ("a\tb\r\n", False), ("Ã©t", True), ("âx", False), ("", False)])
def test_mojibake(spark, text, damaged):
    assert one(spark, X.is_mojibake(F.col("t")), t=text) is damaged


def test_clean_text(spark):
    assert one(spark, X.clean_text(F.col("t")), t="　a \x0b\x1c b  ") == "a b"


@pytest.mark.parametrize("y, m, d, date", [("2024", "2", "31", "2024-02-31"), ("2024", "13", "1", None), ("2024", "6", "2", "2024-06-02"), ("2024", "6", "3", None), ("x", "6", "1", None)])
def test_valid_date(spark, y, m, d, date):
    assert one(spark, X.valid_date(F.col("y"), F.col("m"), F.col("d"), F.lit("2024-06-01").cast("date")), y=y, m=m, d=d) == date


@pytest.mark.parametrize("href, url", [("/p/1.php", "http://h/p/1.php"), ("x.php", "http://h/a/x.php"), ("https://o/z", "https://o/z"), ("//o/z", "http://o/z"), ("#t", "http://h/a/b?q=1#t"), ("?p=2", "http://h/a/b?p=2")])
def test_resolve_url(spark, href, url):
    assert one(spark, X.resolve_url(F.lit("http://h/a/b?q=1#f"), F.col("h")), h=href) == url


def test_small_expressions(spark):
    assert one(spark, X.normalize_url(F.col("u")), u="HTTP://x/A?b#c") == "http://x/A"
    assert one(spark, X.page_number_url(F.col("u"), F.lit(3)), u="/p/403-1-2-1.php") == "/p/403-1-2-3.php"
    assert one(spark, X.list_page_ids(F.col("u")), u="/p/403-1008-26-1.php")["category"] == "26"
    assert one(spark, X.category_slug(F.col("c")), c="升學") == "admission"
    assert one(spark, X.category_slug(F.col("c")), c="?") == "general"
    assert one(spark, X.parse_timestamp(F.col("t")), t="junk") is None
    assert one(spark, X.parse_timestamp(F.col("t")), t="2024-01-01T08:00:00+08:00") == one(spark, X.parse_timestamp(F.col("t")), t="2024-01-01T00:00:00Z")
    assert one(spark, X.page_label(F.lit("7"), F.col("c")), c="12") == "403-7-12"
    assert one(spark, X.page_label(F.lit("7"), F.col("c")), c="412-7-3") == "412-7-3"
    assert one(spark, X.feed_escape(F.col("t")), t="a,b;c" + chr(92) + "d\ne") == r"a\,b\;c\\d\ne"
    assert one(spark, X.canonical_map_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == '{"a":2,"b":1}'
    assert one(spark, X.hours_since(F.lit(None).cast("timestamp"), F.current_timestamp())) == float("inf")


PAGE = """<title>Units>Office>News</title><nav><a href="/p/406-1-9.php">Nav notice</a></nav>
<table><tr><td>2024-05-01</td><td><a href="/p/406-1-5,r26.php?x=1"> A&nbsp; notice\x0b here </a><a href="/p/406-1-5.php"><img></a></td></tr>
<tr><td>2031-05-01</td><td><a href="/p/406-1-6.php">MORE</a><a href="/p/406-1-7.php">Later one</a></td></tr></table>"""


def test_links_and_dates(spark):
    pages = spark.createDataFrame([(1, "http://h/p/403-1-26-1.php", PAGE), (2, "http://h", None), (3, None, "")], "page_id long, url string, html string")
    found = {r["art_id"]: r for r in extract.article_links(pages).collect()}
    assert set(found) == {"9", "5", "7"}
    assert found["5"]["title"] == "A notice here" and found["5"]["cat_ref"] == "26" and found["5"]["link"] == "http://h/p/406-1-5,r26.php"
    dates = {r["href"]: r["near_date"] for r in extract.nearest_date(pages, F.lit("2024-06-01").cast("date")).collect()}
    assert dates["/p/406-1-5,r26.php?x=1"] == "2024-05-01"
    assert dates["/p/406-1-7.php"] == "2024-05-01"  # its own row's date is in the future; the table's first one is taken
    assert one(spark, extract.page_title(F.col("t")), t=PAGE) == "News"


@pytest.mark.parametrize("html, date, source", [
    ("<p>發佈日期 : 2024-05-02</p><i class='mdate'>2024-05-01</i>", "2024-05-02", "publication"),
    ("<i class='x mdate'>2024/5/1</i>2024-01-01", "2024-05-01", "article_meta"), ("2024-01-01", None, None), ("<i class='mdate'>2024-07-01</i>", None, None),
])
def test_article_date(spark, html, date, source):
    r = one(spark, extract.article_date(F.col("h"), F.lit("2024-06-01").cast("date")), h=html)
    assert (r["date"], r["date_source"]) == (date, source)


def test_tabs(spark):
    html = '<a href="#t1">Exams</a><a href="#none">x</a><div id="t1">$.open("/app?Type=mobile_rcg_mstr&Nbr=401")</div>'
    pages = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    (row,) = extract.tab_links(pages, F.lit("1008")).collect()
    assert (row["label"], row["number"], row["list_url"]) == ("Exams", "401", "http://h/p/403-1008-401-1.php")
    assert one(spark, extract.tab_numbers(F.col("h")), h=html) == ["401"]


def test_article_body(spark):
    html = "<div>long long long long text</div><div class='a meditor'>Body <b>text</b><script>no</script></div>"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["snippet"] for r in extract.article_snippets(pages).collect()} == {1: "Body text", 2: None}


def test_article_body_keeps_cut_references(spark):
    """What has no semicolon is text, as in the patterned snippet."""
    html = "<article><h1>A&amp;&amp</h1><p>B &lt; C&lt &#39;d&#39 &copy e & f&nbsp;g</p></article>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    (row,) = extract.article_snippets(pages).collect()
    assert row["snippet"] == one(spark, extract.page_snippet(F.col("h")), h=html) == "A&&amp B < C&lt 'd&#39 &copy e & f g"
