"""Queries over the page corpus."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract, graph, quality, routing
from .views import clean_sql, strip_sql, table, unescape_sql

#: Every link text of the test pages is on 4 pages or more; common ones are on so many.
COMMON_PAGES = 6
TODAY = "2024-06-01"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, X5."""
    return _pages(spark, sf_dir).select("page_id", extract.page_title(F.col("html")).alias("title"), extract.article_title(F.col("html")).alias("article_title"))


def page_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 by patterns."""
    return _pages(spark, sf_dir).select("page_id", extract.page_snippet(F.col("html")).alias("snippet"))


def article_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 by the page's tree."""
    return extract.article_snippets(_pages(spark, sf_dir))


def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_structure(_pages(spark, sf_dir))


def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link, resolved."""
    found = extract.anchors(_pages(spark, sf_dir))
    return found.select("page_id", "pos", "href", "label", X.resolve_url(F.col("url"), F.col("href")).alias("link"))


def first_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's first acceptable link to each target."""
    found = extract.anchors(_pages(spark, sf_dir)).where(extract.acceptable(F.col("label")))
    return quality.first_by(found, ["page_id", "href"], F.col("pos")).select("page_id", "href", "pos", "label")


def article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' host and path numbers as article links, before the page's own text."""
    p = _pages(spark, sf_dir)
    number = F.regexp_extract("url", r"/(\d+)", 1)
    page = F.concat(F.lit("<a href='/p/406-1-"), number, F.lit(",r7.php?x=1'><b>Notice "), number, F.lit("</b></a><a href='/p/406-1-"), number, F.lit(".php'>again "), number, F.lit("</a>"), F.coalesce("html", F.lit("")))
    return extract.article_links(p.select("page_id", "url", page.alias("html"))).select("page_id", "art_id", "cat_ref", "title", "link")


def same_site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by page host, and how many stay on the site."""
    found = extract.anchors(_pages(spark, sf_dir)).withColumn("link", X.resolve_url(F.col("url"), F.col("href")))
    same = graph.same_site(F.col("link"), F.col("url"))
    return found.groupBy(X.host(F.col("url")).alias("host")).agg(F.count("*").alias("links"), F.count_if(same).alias("same_site"), F.count_distinct("page_id").alias("pages"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.anchors(_pages(spark, sf_dir)).select(F.col("page_id").alias("page"), F.col("label").alias("title"), "pos")


def common_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.common_titles(_titles(spark, sf_dir), COMMON_PAGES)


def page_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _titles(spark, sf_dir)
    return quality.page_sample(titles, quality.common_titles(titles, COMMON_PAGES))


def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages evaluated by their links; those of .com hosts count as gone, fragments as errors."""
    counts = extract.anchors(_pages(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("count"))
    err = F.when(X.host(F.col("url")).endswith(".com"), "404").when(F.col("url").contains("#"), "timeout").otherwise("")
    rows = _pages(spark, sf_dir).join(counts, "page_id", "left").select(err.alias("err"), F.coalesce("count", F.lit(0)).alias("count"))
    return quality.page_stats(rows)


def menu_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers as list and menu links, before the page's own text."""
    p = _pages(spark, sf_dir)
    n = F.regexp_extract("url", r"/(\d+)", 1)
    page = F.concat(F.lit("<a href='/p/403-1-"), n, F.lit("-2.php'>公告 "), n, F.lit("</a><a href='/p/412-1-"), n, F.lit(".php'>About</a><a href='/p/412-2-"), n, F.lit(".php'>最新消息</a>"), F.coalesce("html", F.lit("")))
    return extract.nav_filter(extract.menu_links(p.select("page_id", "url", page.alias("html")))).select("page_id", "kind", "unit", "number", "label", "link")


def article_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written into the pages: labelled on .net hosts, in an mdate element on .org hosts, else in the body only."""
    day = F.date_format(F.date_add(F.lit("2024-04-01").cast("date"), (F.col("page_id") % 100).cast("int")), "yyyy/M/d")
    h = X.host(F.col("url"))
    label = F.when(h.endswith(".net"), F.concat(F.lit("<p>發佈日期 : "), day, F.lit("</p>"))).when(h.endswith(".org"), F.concat(F.lit("<i class='x mdate'>"), day, F.lit("</i>"))).otherwise(day)
    d = extract.article_date(F.concat("html", label), F.lit(TODAY).cast("date"))
    return _pages(spark, sf_dir).select("page_id", d["date"].alias("date"), d["date_source"].alias("date_source"))


def near_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates near links; the pages have none but what is written beside the heading link."""
    day = F.date_format(F.date_add(F.lit("2024-04-01").cast("date"), (F.col("page_id") % 100).cast("int")), "yyyy-MM-dd")
    page = F.concat(F.lit("<table><tr><td>"), day, F.lit("</td><td><a href='/top'>Top</a></td></tr></table>"), "html")
    found = extract.nearest_date(_pages(spark, sf_dir).select("page_id", page.alias("html")), F.lit(TODAY).cast("date"))
    return found.where(F.col("near_date").isNotNull()).select("page_id", "href", "near_date")


def site_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers reachable from the first one over shared parts, in three steps."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    edges = pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    edges = edges.union(edges.select(F.col("dst"), F.col("src")))
    return graph.reachable(edges, pairs.agg(F.concat(F.lit("s"), F.min("l_suppkey")).alias("node")), 3)


def outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers as numbered navigation links, before the page's own links."""
    p, n = _pages(spark, sf_dir), F.regexp_extract("url", r"/(\d+)", 1)
    link = F.concat(F.lit("<a href='/n"), n, F.lit("'> 1-"), n, F.lit(" . Plan "), n, F.lit(" 行事曆</a>"), "html")
    found = extract.outline_rows(p.select("page_id", "url", link.alias("html")))
    return found.select("page_id", "outline", "label", "href", "is_calendar")


def raw_category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers as raw list links, second pages as first ones, and configured lists."""
    p, n = table(spark, sf_dir, "pages"), F.regexp_extract("url", r"/(\d+)", 1)
    html = F.concat(F.lit('<a href="/p/403-1-'), n, F.lit('-2.php?x">'), "html")
    configured = table(spark, sf_dir, "supplier").select(F.concat(F.lit("http://h/p/403-1-"), "s_suppkey", F.lit("-1.php")).alias("url"))
    return extract.raw_category_links(p.select("url", html.alias("html")), configured)


def tab_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers as tabs of their page."""
    p, n = table(spark, sf_dir, "pages"), F.regexp_extract("url", r"/(\d+)", 1)
    html = F.concat(F.lit("<a href='#t'>Tab "), n, F.lit('</a><div id="t">open("?Type=mobile_rcg_mstr&Nbr='), n, F.lit('")</div>'), "html")
    rows = p.select("page_id", "url", html.alias("html"))
    found = extract.tab_links(rows, F.lit("7")).select("page_id", "label", "number", "list_url")
    return found.join(rows.select("page_id", F.array_join(extract.tab_numbers(F.col("html")), ",").alias("numbers")), "page_id")


def gap_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and path numbers in the order of a report."""
    p = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", r"/(\d+)", 1).alias("category"))
    return routing.gap_order(p)


def sample_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8."""
    return routing.sample_common(quality.common_titles(_titles(spark, sf_dir), COMMON_PAGES))


QUERIES = {f.__name__: f for f in (
    outline_rows, raw_category_links, tab_links, gap_order, sample_common,
    page_titles, page_snippets, article_bodies, page_structure, extract_links, first_links, article_links, same_site_links, common_titles, page_sample, page_stats,
    menu_links, article_dates, near_dates, site_reachability,
)}
_A = r"""'<a\b[^>]*?\bhref\s*=\s*["\x27]([^"\x27]*)["\x27][^>]*>(.*?)</a\s*>'"""
_LINKS = f"""l AS (
  SELECT page_id, url, pos - 1 AS pos, {unescape_sql(f"regexp_extract(a, {_A}, 1, 'is')")} AS href, {strip_sql(f"regexp_extract(a, {_A}, 2, 'is')")} AS label
  FROM (SELECT page_id, url, unnest(x) AS a, generate_subscripts(x, 1) AS pos FROM (SELECT *, regexp_extract_all(html, {_A}, 0, 'is') AS x FROM pages)))"""
_HOST = "lower(regexp_extract(url, '://([^/?#:]*)', 1))"
_TITLE = clean_sql(unescape_sql("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')"))
_RESOLVED = "CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href END"
_BARE = r"regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<header\b.*?</header\s*>|<footer\b.*?</footer\s*>', ' ', 'gis')"
_NUM = r"regexp_extract(url, '/(\d+)', 1)"
_DAY = "(DATE '2024-04-01' + CAST(page_id % 100 AS INTEGER))"
_ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
ORACLE_SQL = {
    "outline_rows": f"""WITH {_LINKS}, o AS (SELECT *, regexp_extract(label, '^(\\d+(?:-\\d+)*)\\s*[.、．]\\s*(.+)$', 1) AS outline FROM l)
SELECT page_id, '1-' || {_NUM} AS outline, 'Plan ' || {_NUM} || ' 行事曆' AS label, '/n' || {_NUM} AS href, true AS is_calendar FROM pages
UNION ALL SELECT page_id, outline, CASE WHEN outline = '' THEN label ELSE trim(regexp_extract(label, '^(\\d+(?:-\\d+)*)\\s*[.、．]\\s*(.+)$', 2)) END, href, contains(label, '行事曆') FROM o""",
    "raw_category_links": f"SELECT {_ORIGIN} || '/p/403-1-' || {_NUM} || '-1.php' AS url FROM pages UNION SELECT 'http://h/p/403-1-' || s_suppkey || '-1.php' FROM supplier",
    "tab_links": f"SELECT page_id, 'Tab ' || {_NUM} AS label, {_NUM} AS number, {_ORIGIN} || '/p/403-7-' || {_NUM} || '-1.php' AS list_url, {_NUM} AS numbers FROM pages",
    "gap_order": f"SELECT url, {_NUM} AS category FROM pages",
    "sample_common": f"WITH {_LINKS} SELECT label AS title, count(DISTINCT page_id) AS pages FROM l GROUP BY 1 HAVING count(DISTINCT page_id) >= {COMMON_PAGES} ORDER BY title LIMIT 10",
    "page_titles": f"""SELECT page_id, trim(list_last(string_split({_TITLE}, '>'))) AS title, {strip_sql(r"regexp_extract(html, '<h1\b[^>]*>(.*?)</h1\s*>', 1, 'is')")} AS article_title FROM pages""",
    "page_snippets": f"""SELECT page_id, left({strip_sql("CASE WHEN art <> '' THEN art ELSE bare END")}, 1000) AS snippet
FROM (SELECT page_id, bare, regexp_extract(bare, '<article\\b[^>]*>(.*?)</article\\s*>', 1, 'is') AS art FROM (SELECT page_id, {_BARE} AS bare FROM pages))""",
    "page_structure": f"""SELECT page_id, trim(list_last(string_split({_TITLE}, '>'))) AS title, regexp_matches(html, '<a\\b[^>]*\\bhref\\s*=', 'is') AS has_link,
regexp_matches(html, '/p/406-\\d+-\\d+(,r\\d+)?\\.php') AS has_article_link FROM pages""",
    "extract_links": f"WITH {_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, href, label, {_RESOLVED} AS link FROM l",
    "first_links": f"""WITH {_LINKS} SELECT page_id, href, CAST(pos AS INTEGER) AS pos, label FROM
(SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS n FROM l WHERE length(label) >= 4 AND label <> 'MORE') WHERE n = 1""",
    "article_links": f"""SELECT page_id, {_NUM} AS art_id, '7' AS cat_ref, 'Notice ' || {_NUM} AS title,
regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/p/406-1-' || {_NUM} || ',r7.php' AS link FROM pages""",
    "same_site_links": f"""WITH {_LINKS} SELECT {_HOST} AS host, count(*) AS links, count(*) FILTER (WHERE starts_with(href, '/')) AS same_site,
count(DISTINCT page_id) AS pages FROM l GROUP BY 1""",
    "common_titles": f"WITH {_LINKS} SELECT label AS title, count(DISTINCT page_id) AS pages FROM l GROUP BY 1 HAVING count(DISTINCT page_id) >= {COMMON_PAGES}",
    "page_sample": f"""WITH {_LINKS}, c AS (SELECT label FROM l GROUP BY 1 HAVING count(DISTINCT page_id) >= {COMMON_PAGES}),
m AS (SELECT page_id, label, pos, label IN (SELECT label FROM c) AS common FROM l)
SELECT page_id AS page, arg_min(label, (CASE WHEN common THEN 1000000 ELSE 0 END) + pos) AS sample, bool_and(common) AS only_common FROM m GROUP BY 1""",
    "page_stats": f"""WITH {_LINKS}, n AS (SELECT page_id, count(*) AS c FROM l GROUP BY 1),
e AS (SELECT CASE WHEN ends_with({_HOST}, '.com') THEN '404' WHEN contains(url, '#') THEN 'other' WHEN coalesce(c, 0) > 0 THEN 'live' ELSE 'empty' END AS bucket,
coalesce(c, 0) AS c FROM pages LEFT JOIN n USING (page_id))
SELECT bucket, count(*) AS pages, CAST(sum(c) AS BIGINT) AS articles FROM e GROUP BY 1""",
    "menu_links": f"""WITH p AS (SELECT page_id, {_NUM} AS n, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS o FROM pages)
SELECT page_id, '403' AS kind, '1' AS unit, n AS number, '公告 ' || n AS label, o || '/p/403-1-' || n || '-1.php' AS link FROM p
UNION ALL SELECT page_id, '412', '2', n, '最新消息', o || '/p/412-2-' || n || '.php' FROM p""",
    "article_dates": f"""SELECT page_id, CASE WHEN d <= DATE '2024-06-02' AND k <> '' THEN strftime(d, '%Y-%m-%d') END AS date,
CASE WHEN d <= DATE '2024-06-02' AND k <> '' THEN k END AS date_source FROM (SELECT page_id, {_DAY} AS d,
CASE WHEN ends_with({_HOST}, '.net') THEN 'publication' WHEN ends_with({_HOST}, '.org') THEN 'article_meta' ELSE '' END AS k FROM pages)""",
    "near_dates": f"SELECT page_id, '/top' AS href, strftime({_DAY}, '%Y-%m-%d') AS near_date FROM pages WHERE {_DAY} <= DATE '2024-06-02'",
    "site_reachability": """
WITH RECURSIVE f AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM f UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM f),
r AS (SELECT 's' || min(l_suppkey) AS node, 0 AS depth FROM f UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY 1""",
}
ORACLE_SQL["article_bodies"] = ORACLE_SQL["page_snippets"]  # their bodies are article elements
