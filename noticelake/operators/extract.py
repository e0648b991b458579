"""Rows from page texts (X1-X13). Patterns run as native expressions; only what needs an element's ancestors parses HTML in tasks."""

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import (
    ARTICLE_PAGE, DATE, LIST_PAGE, MENU_KEYWORDS, MENU_PAGE, MORE_LABELS, OUTLINE, PUBLICATION_DATE, SNIPPET_CHARS, TAB_NUMBER,
)
from ..functions.text import bound, clean_text, contains_any, date_in, empty_as_null, html_unescape, normalize_url, origin, resolve_url, strip_tags
from .quality import first_by

#: An ampersand that begins no reference with a semicolon, as where a text was cut: it is plain text, as in `html_unescape`.
_BARE_AMPERSAND = re.compile(r"&(?!#?\w+;)")
_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def _page_links(html: Column) -> Column:
    """A page's links, array<struct<href, label>> in its order."""
    href, label = (F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(i)).alias(n) for i, n in ((1, "href"), (2, "label")))
    # cleaned before they are rows: what selects rows by their labels doesn't clean them anew
    return F.transform(F.arrays_zip(href, label), lambda a: F.struct(html_unescape(a["href"]).alias("href"), strip_tags(a["label"]).alias("label")))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, label) of every link of `pages` (page_id, url, html), in page order."""
    return pages.select("page_id", "url", F.posexplode(_page_links(F.col("html"))).alias("pos", "a")).select("page_id", "url", "pos", "a.href", "a.label")


def acceptable(label: Column) -> Column:
    """Whether a link's label is a title: four characters or more, and none of the labels for more."""
    return (F.char_length(label) >= 4) & ~label.isin(*MORE_LABELS)


def article_links(pages: DataFrame, unit: Column | None = None) -> DataFrame:
    """(page_id, url, pos, art_id, cat_ref, title, link): each page's first acceptable link to each article."""
    found = anchors(pages).withColumns({f"__{i}": F.regexp_extract("href", ARTICLE_PAGE, i) for i in (1, 2, 3)})
    found = found.where((F.col("__2") != "") & acceptable(F.col("label")) & (F.lit(True) if unit is None else F.col("__1") == unit))
    first = first_by(found, ["page_id", "__2"], F.col("pos"))
    link = normalize_url(resolve_url(F.col("url"), F.col("href")))
    return first.select("page_id", "url", "pos", F.col("__2").alias("art_id"), empty_as_null(F.col("__3")).alias("cat_ref"), F.col("label").alias("title"), link.alias("link"))


class _Tree(HTMLParser):
    """Text pieces with the open elements above them; links and elements with classes or ids by position."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[int] = []
        self.nodes: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.nodes.append({"tag": tag, "attrs": dict(attrs), "parent": self.open[-1] if self.open else None, "text": []})
        if tag not in self.VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[i]]["tag"] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data:
            for node in self.open:
                self.nodes[node]["text"].append(data)


def _tree(html: str | None) -> list[dict]:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.nodes


def _page_contexts(html: str | None, search: Callable[[str], re.Match | None], levels: int) -> list[tuple[str, list[str]]]:
    """(href, texts) of a page's links, see `link_contexts`."""
    nodes, known, rows = _tree(html), {}, []
    for link in (i for i, n in enumerate(nodes) if n["tag"] == "a" and n["attrs"].get("href") is not None):
        texts, node = [], link
        while node is not None and len(texts) < levels:
            if node not in known:
                found = search(" ".join(nodes[node]["text"]))
                known[node] = found.group(0) if found else ""
            texts.append(known[node])
            node = nodes[node]["parent"]
        rows.append((nodes[link]["attrs"]["href"], texts))
    return rows


def _search(pattern: str) -> Callable[[str], re.Match | None]:
    return re.compile(pattern.replace(r"(?U:\d)", r"\d")).search  # digits of all scripts, as Python reads it


def link_contexts(pages: DataFrame, pattern: str, levels: int = 4) -> DataFrame:
    """(page_id, pos, href, texts): for each link the first match of `pattern` in its own text and in those of its next
    ancestors, `levels` in all; empty where there is none. An element's text is searched once, whatever links it holds.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = _search(pattern)
        for frame in frames:
            rows = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                rows.extend((page_id, pos, *link) for pos, link in enumerate(_page_contexts(html, search, levels)))
            yield pd.DataFrame(rows, columns=["page_id", "pos", "href", "texts"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, href string, texts array<string>")


def _contexts(html: Column, pattern: str, levels: int = 4) -> Column:
    """array<struct<href, texts>>: `link_contexts` of a page as one value."""
    kind = pa.list_(pa.struct([("href", pa.string()), ("texts", pa.list_(pa.string()))]))

    @F.arrow_udf("array<struct<href: string, texts: array<string>>>")
    def run(pages: pa.Array) -> pa.Array:
        search, none = _search(pattern), pa.array([], kind)
        found = ([{"href": h, "texts": t} for h, t in _page_contexts(page.as_py(), search, levels)] for page in pages)
        return pa.concat_arrays([none, *(pa.array([links], kind) for links in found)])

    return run(html)


def _first_valid_date(texts: Column, today: Column) -> Column:
    return F.get(F.filter(F.transform(texts, lambda t: date_in(t, DATE, today)), lambda d: d.isNotNull()), 0)


def nearest_date(pages: DataFrame, today: Column) -> DataFrame:
    """(page_id, pos, href, near_date): the first date in the link's own text, else in the nearest ancestor that has a valid one."""
    return link_contexts(pages, DATE).select("page_id", "pos", "href", _first_valid_date(F.col("texts"), today).alias("near_date"))


def dated_links(pages: DataFrame, today: Column) -> DataFrame:
    """`article_links` of pages (url, html, ...; one row a url) without page_id, with page_title, the other columns of the
    page, and date: that of `nearest_date` at the page's first place that has one and links to the same address.

    A page's links and places are dealt by its url as one row, then meet in windows there: no join, and no other shuffle.
    """
    kept = [c for c in pages.columns if c != "html"]
    labels = F.transform(_page_links(F.col("html")), lambda a, i: F.struct(i.alias("pos"), a["href"].alias("href"), a["label"].alias("label"), F.lit(None).cast("array<string>").alias("texts")))
    places = F.transform(_contexts(F.col("html"), DATE), lambda c, i: F.struct(i.alias("pos"), c["href"].alias("href"), F.lit(None).cast("string").alias("label"), c["texts"].alias("texts")))
    dealt = pages.select(*kept, page_title(F.col("html")).alias("page_title"), F.concat(labels, places).alias("__links")).repartition("url")
    # outer: else Spark infers a filter on the array, and computes it twice
    rows = dealt.select(*kept, "page_title", F.explode_outer("__links").alias("__l")).select(*kept, "page_title", "__l.*")
    art = F.when(F.regexp_extract("href", ARTICLE_PAGE, 2) != "", F.when(acceptable(F.col("label")), F.regexp_extract("href", ARTICLE_PAGE, 2)))
    rows = rows.select("*", art.alias("art_id"), _first_valid_date(F.col("texts"), today).alias("near_date")).drop("texts")
    rows = rows.where(F.col("art_id").isNotNull() | F.col("near_date").isNotNull()).withColumn("link", normalize_url(resolve_url(F.col("url"), F.col("href"))))
    date = F.min_by("near_date", F.when(F.col("near_date").isNotNull(), F.col("pos"))).over(W.partitionBy("url", "link"))
    first = first_by(rows.withColumn("date", date).where(F.col("art_id").isNotNull()), ["url", "art_id"], F.col("pos"))
    cat_ref = empty_as_null(F.regexp_extract("href", ARTICLE_PAGE, 3)).alias("cat_ref")
    return first.select(*kept, "page_title", "pos", "art_id", cat_ref, F.col("label").alias("title"), "link", "date")


def page_title(html: Column) -> Column:
    """The last part, after `>`, of a page's title."""
    title = clean_text(html_unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.trim(F.element_at(F.split(title, ">"), -1))


def page_snippet(html: Column, title: Column | None = None) -> Column:
    """The first characters of a page's own text, by patterns: the article element if there is one, without its title."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)\b.*?</\1\s*>", " ")
    article = F.regexp_extract(bare, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    text = strip_tags(F.when(article != "", article).otherwise(bare))
    if title is not None:
        text = F.when((title != "") & F.startswith(text, title), F.trim(F.substr(text, F.length(title) + 1))).otherwise(text)
    return F.left(text, F.lit(SNIPPET_CHARS))


def article_snippets(pages: DataFrame) -> DataFrame:
    """(page_id, snippet): the first characters of the body element, found in the page's tree.

    Body: the first div of class mpgdetail, else of class meditor, else the div with id Dyn_2_2, else the
    article element, else the div with most text.
    """
    dropped = {"script", "style", "nav", "header", "footer"}
    wanted = (
        lambda n: n["tag"] == "div" and "mpgdetail" in (n["attrs"].get("class") or "").split(),
        lambda n: n["tag"] == "div" and "meditor" in (n["attrs"].get("class") or "").split(),
        lambda n: n["tag"] == "div" and n["attrs"].get("id") == "Dyn_2_2",
        lambda n: n["tag"] == "article",
    )

    class Body(_Tree):
        def handle_data(self, data: str) -> None:
            if not any(self.nodes[i]["tag"] in dropped for i in self.open):
                super().handle_data(data)

    def snippet(html: str | None) -> str | None:
        parser = Body()
        parser.feed(_BARE_AMPERSAND.sub("&amp;", html or ""))
        parser.close()
        body = next((n for want in wanted for n in parser.nodes if want(n)), None)
        if body is None:
            body = max((n for n in parser.nodes if n["tag"] == "div"), key=lambda n: sum(map(len, n["text"])), default=None)
        return None if body is None else " ".join(" ".join(body["text"]).split())[:SNIPPET_CHARS]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "snippet": [snippet(h) for h in frame["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, snippet string")


def article_title(html: Column) -> Column:
    """The og:title, else the first h1's text."""
    meta = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']og:title["'][^>]*>""", 0)
    og = clean_text(html_unescape(F.regexp_extract(meta, r"""(?is)\bcontent\s*=\s*(["'])(.*?)\1""", 2)))
    return F.when(og != "", og).otherwise(strip_tags(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)))


def article_date(html: Column, today: Column) -> Column:
    """struct(date, date_source): a labelled publication date anywhere, else one in an mdate element; dates in the body don't count."""
    published = date_in(strip_tags(html), PUBLICATION_DATE, today)
    mdate = F.regexp_extract(html, r"""(?is)<(\w+)\b[^>]*\bclass\s*=\s*["'][^"']*mdate[^"']*["'][^>]*>(.*?)</\1\s*>""", 2)
    meta = bound(mdate, lambda m: F.when(m != "", date_in(strip_tags(m), DATE, today)))

    def dated(date: Column, source: str) -> Column:
        return F.struct(date.alias("date"), F.when(date.isNotNull(), source).alias("date_source"))

    return bound(published, lambda p: F.when(p.isNotNull(), dated(p, "publication")).otherwise(bound(meta, lambda m: dated(m, "article_meta"))))


def outline_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, outline, label, href, is_calendar) of links; outline is empty without a number like 2-1."""
    found = anchors(pages)
    number = F.regexp_extract("label", OUTLINE, 1)
    label = F.when(number != "", F.trim(F.regexp_extract("label", OUTLINE, 2))).otherwise(F.col("label"))
    return found.select("page_id", "pos", number.alias("outline"), label.alias("label"), "href", F.contains(label, F.lit("行事曆")).alias("is_calendar"))


def tab_links(pages: DataFrame, unit: Column) -> DataFrame:
    """(page_id, pos, label, number, list_url): in-page links whose target element names a tab number."""
    tabs = anchors(pages).where(F.col("href").startswith("#") & (F.length("href") > 1) & (F.col("label") != ""))
    opened = F.concat(F.lit(r"(?is)<[^>]*\bid\s*=\s*[\"']\Q"), F.substr("href", F.lit(2)), F.lit(r"\E[\"'][^>]*>.*?" + TAB_NUMBER))
    number = F.regexp_extract("html", TAB_NUMBER, 1)
    block = F.regexp_substr("html", opened)
    joined = tabs.join(pages.select("page_id", "html"), "page_id").withColumn("html", block).withColumn("number", number)
    url = F.concat(origin(F.col("url")), F.lit("/p/403-"), unit, F.lit("-"), F.col("number"), F.lit("-1.php"))
    return joined.where(F.coalesce("number", F.lit("")) != "").select("page_id", "pos", "label", "number", url.alias("list_url"))


def menu_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, unit, number, label, link): list and menu links, each once a page, at its first place."""
    found = anchors(pages)
    listed, menu = F.regexp_extract("href", LIST_PAGE, 1) != "", F.regexp_extract("href", MENU_PAGE, 1) != ""
    pick = lambda i: F.when(listed, F.regexp_extract("href", LIST_PAGE, i)).otherwise(F.regexp_extract("href", MENU_PAGE, i))
    rows = found.where(listed | menu).withColumns({"kind": F.when(listed, "403").otherwise("412"), "unit": pick(1), "number": pick(2)})
    path = F.when(F.col("kind") == "403", F.concat(F.lit("/p/403-"), "unit", F.lit("-"), "number", F.lit("-1.php"))).otherwise(F.regexp_extract("href", MENU_PAGE, 0))
    first = first_by(rows.withColumn("link", F.concat(origin(F.col("url")), path)), ["page_id", "kind", "unit", "number"], F.col("pos"))
    return first.select("page_id", "pos", "kind", "unit", "number", "label", "link")


def nav_filter(links: DataFrame, keywords: Iterable[str] = MENU_KEYWORDS) -> DataFrame:
    """Menu links (kind 412) only with one of the keywords in their label; others as they are."""
    return links.where((F.col("kind") != "412") | contains_any(F.col("label"), keywords))


def raw_category_links(pages: DataFrame, configured: DataFrame) -> DataFrame:
    """Distinct list-page urls in the raw HTML, without query, second pages as first ones, and the configured ones (url)."""
    path = F.explode(F.regexp_extract_all("html", F.lit(r"""href\s*=\s*["']([^"']*/p/403-\d+-\d+-[12]\.php[^"']*)["']"""), F.lit(1)))
    found = pages.select("url", path.alias("href"))
    link = F.regexp_replace(normalize_url(resolve_url(F.col("url"), F.col("href"))), r"-2\.php$", "-1.php")
    return found.select(link.alias("url")).union(configured.select("url")).distinct()


def page_structure(pages: DataFrame) -> DataFrame:
    """(page_id, title, has_link, has_article_link)."""
    return pages.select(
        "page_id", page_title(F.col("html")).alias("title"), F.col("html").rlike(r"(?is)<a\b[^>]*\bhref\s*=").alias("has_link"), F.col("html").rlike(ARTICLE_PAGE).alias("has_article_link")
    )


def tab_numbers(html: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(TAB_NUMBER), F.lit(1))))
