"""Filters, keyword subscriptions, topics and delivery."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import BACKFILL_HOURS, BACKFILL_LIMIT, COLD_HOURS, DEFAULT_CATEGORY, DEFAULT_SLUG, DETAIL_PER_SCHOOL, PAGE_SIZE, PUSH_LIMIT, SPACE, SUMMARY_THRESHOLD
from ..functions.text import empty_as_null, hours_since, is_mojibake
from .quality import first_by

#: See `keyword_match`. Keywords are short, so these rows are a few megabytes.
FEW_KEYWORDS, BROADCAST_KEYWORDS = 32, 50_000
ANCHOR, SALTS = 6, 16


def item_text(*columns: str) -> Column:
    """The lower-cased text that searches look in; nulls count as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def match_all_tokens(text: Column, query: Column) -> Column:
    """Whether every white-space separated token of the query is a substring; an empty query matches."""
    tokens = F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), SPACE), lambda t: t != "")
    return F.forall(tokens, lambda t: F.contains(text, t))


def match_any_keyword(text: Column, keywords: Column) -> Column:
    """Whether any keyword of an array is a substring; none: false."""
    return F.coalesce(F.exists(keywords, lambda k: (k != "") & F.contains(text, F.lower(k))), F.lit(False))


def filter_latest(items: DataFrame, school: str = "all", category: str = "all", query: str = "") -> DataFrame:
    """Items of a school and category whose title, snippet, category and source category have all tokens of the query."""
    text = item_text("title", "snippet", "category", "source_category")
    out = items.where(match_all_tokens(text, F.lit(query)))
    out = out if school == "all" else out.where(F.col("school") == school)
    return out if category == "all" else out.where(F.col("category") == category)


def order_announcements(items: DataFrame, day: str = "display_date") -> DataFrame:
    return items.orderBy(F.desc(day), F.desc("first_seen"), "id")


def page_of_results(items: DataFrame, pages: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """The first pages of the ordered items, each with how many remain after them."""
    total = items.agg(F.count("*").alias("__total"))  # one row
    shown = order_announcements(items).limit(pages * size)
    return shown.join(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("__total") - pages * size, F.lit(0))).drop("__total")


def is_important(row: DataFrame) -> Column:
    return F.coalesce(row["important"], F.lit(False)) | F.coalesce(row["importance"] == "high", F.lit(False)) | F.coalesce(row["source_pin"] == "important", F.lit(False))


def important_top(items: DataFrame, n: int = 3) -> DataFrame:
    return order_announcements(items.where(is_important(items))).limit(n)


def is_new(first_seen: Column, last_seen: Column) -> Column:
    """Later than the last visit, as instants; without a last visit all are new."""
    return last_seen.isNull() | (first_seen > last_seen)


def unread_items(items: DataFrame, reads: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return items.join(reads.select(*keys), list(keys), "left_anti")


def read_items(items: DataFrame, reads: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return items.join(reads.select(*keys), list(keys), "left_semi")


def badge(n: Column) -> Column:
    return F.when(n > 99, "99+").otherwise(n.cast("string"))


def owner_scope(rows: DataFrame, owner: str | Column) -> DataFrame:
    """Only the owner's rows: of one for all, or of the column that names who asks."""
    return rows.where(F.col("user_id") == (F.lit(owner) if isinstance(owner, str) else owner))


def cascade_delete(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of users that still exist."""
    return rows.join(users.select("user_id"), "user_id", "left_semi")


def needs_backfill(items: DataFrame, fetched: DataFrame) -> DataFrame:
    """Items (url, date, snippet, title, *_tried) that lack a date or snippet not tried yet, or have a damaged title, and
    whose url wasn't fetched in this run.
    """
    no_date = empty_as_null(F.col("date")).isNull() & ~F.coalesce("date_tried", F.lit(False))
    no_snippet = empty_as_null(F.col("snippet")).isNull() & ~F.coalesce("snippet_tried", F.lit(False))
    return items.where(no_date | no_snippet | is_mojibake(F.col("title"))).join(fetched.select("url"), "url", "left_anti")


def backfill_queue(pending: DataFrame, hour: Column, forced: bool = False, limit: int = BACKFILL_LIMIT) -> DataFrame:
    """The latest pending items, only in the hours for it."""
    return pending.where(F.lit(forced) | hour.isin(*BACKFILL_HOURS)).orderBy(F.desc("first_seen"), "id").limit(limit)


def top_new_per_school(items: DataFrame, n: int = DETAIL_PER_SCHOOL) -> DataFrame:
    """Each school's newest items."""
    rank = F.row_number().over(W.partitionBy("school").orderBy(F.desc("date"), "id"))
    return items.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def due_sources(sources: DataFrame, state: DataFrame, now: Column, cold_hours: float = COLD_HOURS, fetch_all: bool = False) -> DataFrame:
    """Sources (url, tier) to be fetched: hot ones, and cold ones last fetched (url, fetched_at) so many hours ago or never."""
    aged = sources.join(state.select("url", "fetched_at"), "url", "left").withColumn("age_hours", hours_since(F.col("fetched_at"), now))
    return aged.where(F.lit(fetch_all) | (F.col("tier") == "hot") | (F.col("age_hours") >= cold_hours))


def known_flag(evaluated: DataFrame, configured: DataFrame) -> DataFrame:
    """`evaluated` (unit, category) with known: whether that pair is configured."""
    pairs = configured.select("unit", "category").distinct().withColumn("__k", F.lit(True))
    return evaluated.join(pairs, ["unit", "category"], "left").withColumn("known", F.col("__k").isNotNull()).drop("__k")


def exclude_pages(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Pages (page, name, only_common, exclusive) without an excluded word (word) in their name, with items of their own."""
    own = pages.where(~F.col("only_common") & (F.col("exclusive") > 0))
    named = keyword_match(own.select("page", F.lower("name").alias("text")), words.select(F.col("word").alias("keyword")), "page")
    return own.join(named.select("page"), "page", "left_anti")


def classify_by_table(items: DataFrame, rules: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """`items` with category by a rules table (priority, category, keyword): the first rule with a keyword in the text.

    For rule tables too large for one expression; see `keyword_match`.
    """
    hits = keyword_match(items.select(key, text.alias("text")), rules.select("keyword", "priority", "category"), key)
    best = hits.groupBy(key).agg(F.min_by("category", F.struct("priority", "category")).alias("category"))
    return items.drop("category").join(best, key, "left").withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY)))


def _anchors(text: Column, lengths: Sequence[int]) -> Column:
    """The distinct hashes of a text's substrings of these lengths."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def hashes(chars: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.xxhash64(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) >= n, every).otherwise(F.array().cast("array<bigint>"))

    # bound once, or each hash would split the text anew
    return F.get(F.transform(F.array(chars), lambda c: F.array_distinct(F.concat(*[hashes(c, n) for n in lengths]))), 0)


def _meet(texts: DataFrame, anchors: Column, words: DataFrame, keys: list[str], kept: list[str], small: bool) -> DataFrame:
    """Texts with the `words` (keyword, __anchor, ...) whose anchor they have and that they hold."""
    found = F.contains("text", F.col("keyword"))
    if small:
        met = texts.select(*keys, "text", F.explode_outer(anchors).alias("__anchor")).join(F.broadcast(words), "__anchor")
        return met.where(found).select(*kept)
    salted = words.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = texts.select(*keys, F.explode_outer(anchors).alias("__anchor")).withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    met = met.join(salted, ["__anchor", "__salt"]).select(*kept)
    return met.join(texts.select(*keys, "text"), keys).where(found).select(*kept)


def keyword_match(texts: DataFrame, keywords: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """(key columns, the columns of keywords) wherever the lower-cased keyword (trimmed, not blank) is a substring of `text`.

    texts: one row a key. Up to FEW_KEYWORDS every text is searched for each keyword. Beyond, texts meet keywords by an
    anchor, and what meets is searched: the longest word inside a keyword, between two blanks, which a text that holds
    it has between blanks, too; for keywords without one, if they aren't few, the hash of one of their substrings
    of ANCHOR characters (of all, if they are shorter). Up to BROADCAST_KEYWORDS the keywords are broadcast; beyond,
    keys and anchors alone are shuffled, with keywords in SALTS copies, so that a frequent anchor isn't one task's work.
    """
    words = keywords.withColumn("keyword", F.lower(F.trim("keyword"))).where("keyword <> ''").distinct()
    keys = [key] if isinstance(key, str) else list(key)
    kept = [*keys, *words.columns]
    n = words.limit(BROADCAST_KEYWORDS + 1).count()

    def each(few: DataFrame) -> DataFrame:
        return texts.join(F.broadcast(few), F.contains("text", F.col("keyword"))).select(*kept)

    if n <= FEW_KEYWORDS:
        return each(words)
    parts = F.split("keyword", " ", -1)
    inside = F.when(F.size(parts) > 2, F.slice(parts, 2, F.size(parts) - 2))
    words = words.withColumn("__anchor", F.array_max(F.transform(inside, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    whole, rest = words.where("__anchor IS NOT NULL"), words.where("__anchor IS NULL").drop("__anchor")
    met = _meet(texts, F.array_distinct(F.split("text", " ", -1)), whole, keys, kept, n <= BROADCAST_KEYWORDS)
    if rest.limit(FEW_KEYWORDS + 1).count() <= FEW_KEYWORDS:
        return met.unionByName(each(rest))
    length = F.least(F.length("keyword"), F.lit(ANCHOR))
    lengths = sorted(r["n"] for r in rest.select(length.alias("n")).distinct().collect())  # ANCHOR rows at most
    anchor = F.lit(None).cast("long")
    for size in lengths:
        anchor = F.when(length == size, F.array_min(_anchors(F.col("keyword"), [size]))).otherwise(anchor)
    return met.unionByName(_meet(texts, _anchors(F.col("text"), lengths), rest.withColumn("__anchor", anchor), keys, kept, n <= BROADCAST_KEYWORDS))


def subscription_match(items: DataFrame, subscriptions: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """(key, name, topic_suffix): each item and group (name, topic_suffix, keywords) with any keyword in the text, once."""
    words = subscriptions.select("name", "topic_suffix", F.explode("keywords").alias("keyword"))
    return keyword_match(items.select(key, text.alias("text")), words, key).select(key, "name", "topic_suffix").distinct()


def personal_topics(items: DataFrame, subscriptions: DataFrame, topic: str, text: Column, key: str = "id") -> DataFrame:
    """(key, topic) of the matched groups whose suffix isn't blank."""
    suffix = F.trim("topic_suffix")
    matched = subscription_match(items, subscriptions, text, key).where(suffix != "")
    return matched.select(key, F.concat(F.lit(f"{topic}-"), suffix).alias("topic")).distinct()


def topic_routing(items: DataFrame, slugs: DataFrame, subscriptions: DataFrame, topic: str, text: Column, key: str = "id") -> DataFrame:
    """(key, topic): all items to the topic and to that of their category (category, slug), matched ones to personal topics."""
    named = items.withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY))).join(slugs, "category", "left")
    slug = F.concat(F.lit(f"{topic}-"), F.coalesce("slug", F.lit(DEFAULT_SLUG)))
    fixed = named.select(key, F.explode(F.array(F.lit(topic), slug)).alias("topic"))
    return fixed.union(personal_topics(items, subscriptions, topic, text, key)).distinct()


def category_counts(items: DataFrame) -> DataFrame:
    """(category, n, place): counts, with the place by count, then first occurrence (seq)."""
    counted = items.groupBy(F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("category")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counted.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "first"))).drop("first")  # one row a category


def flood_summary(items: DataFrame) -> DataFrame:
    """(n, text): one line that counts the new items by category."""
    parts = category_counts(items).agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "category", "n").alias("t")))).alias("p")
    )
    listed = F.array_join(F.transform("p", lambda x: x["t"]), "、")
    return parts.select("n", F.concat(F.lit("本輪新增 "), F.col("n").cast("string"), F.lit(" 則:"), listed).alias("text"))


def delivery_plan(items: DataFrame, routed: DataFrame, personal: DataFrame, key: str = "id", threshold: int = SUMMARY_THRESHOLD, limit: int = PUSH_LIMIT) -> DataFrame:
    """(key, topic, kind) to deliver for the new items (key, seq). Few items go to all their topics (routed); many become
    one summary row, and only those with a personal match go to their personal topics. At most `limit` items either way.
    """
    if items.limit(threshold + 1).count() <= threshold:
        first = items.orderBy("seq").limit(limit).select(key)
        return routed.join(first, key, "left_semi").select(key, "topic", F.lit("item").alias("kind"))
    matched = items.join(personal.select(key).distinct(), key, "left_semi").orderBy("seq").limit(limit).select(key)
    own = personal.join(matched, key, "left_semi").select(key, "topic", F.lit("item").alias("kind"))
    kind = dict(items.dtypes)[key]
    summary = flood_summary(items).select(F.lit(None).cast(kind).alias(key), F.col("text").alias("topic"), F.lit("summary").alias("kind"))
    return own.unionByName(summary)


def messages(plan: DataFrame, items: DataFrame, topic: str, key: str = "id", body_chars: int = 80) -> DataFrame:
    """(topic, title, body, click) of a delivery plan, for the outbox: items by title, snippet and url; the summary goes to `topic`."""
    told = items.select(key, "title", F.left(F.coalesce("snippet", F.lit("")), F.lit(body_chars)).alias("body"), F.col("url").alias("click"))
    own = plan.where("kind = 'item'").join(told, key).select("topic", "title", "body", "click")
    return own.unionByName(plan.where("kind = 'summary'").select(F.lit(topic).alias("topic"), F.col("topic").alias("title"), F.lit("").alias("body"), F.lit("").alias("click")))


def used_categories(rules: DataFrame, items: DataFrame) -> DataFrame:
    """Categories of the rules (priority, category) that occur, in rule order."""
    return rules.groupBy("category").agg(F.min("priority").alias("priority")).join(items.select("category"), "category", "left_semi").orderBy("priority")


def preflight_candidates(schools: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """(school, kind, url): each school's base, its first two sources and the url of its first item."""
    base = schools.select("school", F.lit("base").alias("kind"), F.col("base").alias("url"))
    rank = F.row_number().over(W.partitionBy("school").orderBy("rank", "url"))
    two = sources.withColumn("__n", rank).where("__n <= 2").select("school", F.lit("source").alias("kind"), "url")
    first = items.groupBy("school").agg(F.min_by("url", "seq").alias("url")).select("school", F.lit("item").alias("kind"), "url")
    return base.unionByName(two).unionByName(first)


def gap_order(pages: DataFrame) -> DataFrame:
    """Pages by numeric category, those without a number last."""
    return pages.orderBy(F.coalesce(F.col("category").try_cast("int"), F.lit(1_000_000_000)), "category", "url")


def sample_common(common: DataFrame, n: int = 10) -> DataFrame:
    return common.orderBy("title").limit(n)
