"""Column expressions on texts, URLs, dates and user state."""

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import CATEGORY_RULES, CATEGORY_SLUGS, DEFAULT_CATEGORY, DEFAULT_SLUG, LIST_PAGE, MOJIBAKE, SPACE


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, however often it occurs there; inlined, nested patterns multiply."""
    return F.get(F.transform(F.array(value), use), 0)


def empty_as_null(text: Column) -> Column:
    return F.when(text != "", text)


def clean_text(text: Column) -> Column:
    """Each run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_url(url: Column) -> Column:
    """Without query and fragment; the scheme in lower case."""

    def lowered(bare: Column) -> Column:
        scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
        return bound(scheme, lambda s: F.when(s != "", F.concat(F.lower(s), F.substr(bare, F.length(s) + 1))).otherwise(bare))

    return bound(F.regexp_replace(url, r"(?s)[?#].*$", ""), lowered)


def origin(url: Column) -> Column:
    """scheme://host of an absolute URL, else empty."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def remove_dot_segments(url: Column) -> Column:
    """`url` without the path segments . and .. and what they step back over."""
    parts = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?)([^?#]*)(.*)$"

    def step(done: Column, segment: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    def without(url: Column, path: Column) -> Column:
        segments = F.split(path, "/", -1)
        last = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array(F.lit("")), step)
        clean = F.concat(F.regexp_extract(url, parts, 1), F.array_join(F.concat(kept, last), "/"), F.regexp_extract(url, parts, 3))
        return F.when(path.startswith("/") & path.rlike(r"/\.{1,2}(/|$)"), clean).otherwise(url)

    # few links have such segments: the others are only searched for a slash and a point
    return bound(url, lambda u: F.when(F.contains(u, F.lit("/.")), bound(F.regexp_extract(u, parts, 2), lambda p: without(u, p))).otherwise(u))


def resolve_url(base: Column, href: Column) -> Column:
    """A link's absolute URL: absolute, protocol-relative, rooted, query, fragment or relative to the base's folder.

    Segments . and .. of relative and rooted links are resolved.
    """
    page = F.regexp_replace(base, r"(?s)[?#].*$", "")
    folder = bound(page, lambda p: F.when(p.rlike(r"://[^/]+/"), F.regexp_replace(p, r"[^/]*$", "")).otherwise(F.concat(p, F.lit("/"))))

    def resolved(href: Column) -> Column:
        joined = F.when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        joined = joined.when(href.startswith("/"), F.concat(origin(base), href)).otherwise(F.concat(folder, href))
        return (
            F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href == "", base)
            .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)#.*$", ""), href))
            .when(href.startswith("?"), F.concat(page, href))
            .otherwise(remove_dot_segments(joined))
        )

    return bound(href, resolved)


def contains_any(text: Column, keywords: Iterable[str]) -> Column:
    """Whether any keyword is a substring; none: false. Plain searches are faster than an alternation of patterns."""
    return reduce(or_, [F.contains(text, F.lit(k)) for k in keywords if k], F.lit(False))


def classify(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = CATEGORY_RULES, default: str = DEFAULT_CATEGORY) -> Column:
    """The category of the first rule with a keyword in the text, for rules of a few hundred keywords.

    For larger rule tables see `operators.routing.classify_by_table`.
    """
    result = F.lit(default)
    for category, keywords in reversed(rules):
        result = F.when(contains_any(text, keywords), F.lit(category)).otherwise(result)
    return result


def category_slug(category: Column, slugs: Mapping[str, str] = CATEGORY_SLUGS, default: str = DEFAULT_SLUG) -> Column:
    table = F.create_map(*[F.lit(x) for pair in slugs.items() for x in pair])
    return F.coalesce(F.element_at(table, category), F.lit(default))


def valid_date(year: Column, month: Column, day: Column, today: Column) -> Column:
    """YYYY-MM-DD if the month is 1-12, the day 1-31 and the date not after tomorrow; else null.

    Days that a month doesn't have are let through, so the result stays a string.
    """
    last = F.date_format(F.date_add(today, 1), "yyyy-MM-dd")

    def checked(ymd: Column) -> Column:
        text = F.format_string("%04d-%02d-%02d", ymd[0], ymd[1], ymd[2])
        return F.when(ymd[1].between(1, 12) & ymd[2].between(1, 31), bound(text, lambda t: F.when(t <= last, t)))

    return bound(F.array(*[x.try_cast("int") for x in (year, month, day)]), checked)


def date_in(text: Column, pattern: str, today: Column) -> Column:
    """The first date that the pattern (groups year, month, day) finds, if valid."""

    def first(text: Column) -> Column:
        parts = [F.translate(F.regexp_extract(text, pattern, i), "０１２３４５６７８９", "0123456789") for i in (1, 2, 3)]
        return F.when(text.rlike(pattern), valid_date(*parts, today))

    return bound(text, first)


def display_date(date: Column, first_seen: Column) -> Column:
    """The date, else the day it was first seen, else empty (never null)."""
    return F.coalesce(empty_as_null(date), F.left(first_seen.cast("string"), F.lit(10)), F.lit(""))


def page_number_url(url: Column, page: Column) -> Column:
    """The n-th page of a list whose first page ends in -1.php."""
    return F.regexp_replace(url, F.lit(r"-1\.php$"), F.concat(F.lit("-"), page.cast("string"), F.lit(".php")))


def list_page_ids(url: Column) -> Column:
    """struct(unit, category) of a list page's URL, or null."""
    unit = F.regexp_extract(url, LIST_PAGE, 1)
    return F.when(unit != "", F.struct(unit.alias("unit"), F.regexp_extract(url, LIST_PAGE, 2).alias("category")))


def normalize_keyword(keyword: Column) -> Column:
    return F.lower(clean_ends(keyword))


def clean_ends(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f\ufeff]+|[\s\x1c-\x1f\ufeff]+$", "")


def parse_timestamp(text: Column) -> Column:
    """An ISO date-time with an offset (or Z) as an instant; anything else is null."""
    return F.when(text.rlike(r"[Tt ].*(?:[Zz]|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_map_json(entries: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def account_id(account: Column) -> Column:
    return F.coalesce(empty_as_null(F.trim(account)), F.lit("anonymous"))


def html_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def html_unescape(text: Column) -> Column:
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), (" ", "&nbsp;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def strip_tags(html: Column) -> Column:
    """The text of HTML: no scripts, styles, comments or tags; entities resolved; white space cleaned."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return clean_text(html_unescape(F.regexp_replace(bare, r"<[^>]*>", " ")))


def table_cell(text: Column, limit: int = 60) -> Column:
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(safe) > limit, F.concat(F.left(safe, F.lit(limit)), F.lit("…"))).otherwise(safe)


def page_label(unit: Column, category: Column) -> Column:
    return F.when(category.rlike(r"^\d+$"), F.concat_ws("-", F.lit("403"), unit, category)).otherwise(category)


def hours_since(then: Column, now: Column) -> Column:
    """Fractional hours between two timestamps; an unknown one is infinitely long ago."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 3.6e9
    return F.coalesce(hours, F.lit(float("inf")))


def safe_state(document: Column, schema: str, empty: Column) -> Column:
    """A JSON document by a schema; what can't be read becomes `empty`."""
    return F.coalesce(F.from_json(document, schema, {"mode": "PERMISSIVE"}), empty)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_grid_start(day: Column) -> Column:
    """The Sunday on or before the first of the month."""
    first = month_start(day)
    return F.date_sub(first, F.dayofweek(first) - 1)


def is_mojibake(text: Column) -> Column:
    """Replacement or control characters, or UTF-8 that was read as Latin-1. Null and empty: false."""
    return F.coalesce(text.rlike(MOJIBAKE), F.lit(False))


def feed_escape(text: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text
