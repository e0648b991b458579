"""Browsing, classification, scalar expressions and queues over announcements."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import merge, quality, routing
from .views import ANN, DEFAULT, RULES, SPACES, TOKENS, announcements, case_sql, clean_sql, table


def latest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of one category's announcements with all tokens, newest first."""
    found = routing.filter_latest(announcements(spark, sf_dir), category="event", query=" ".join(TOKENS))
    shown = found.withColumn("display_date", X.display_date(F.col("date"), F.col("first_seen")))
    return routing.page_of_results(shown).select("id", "title", "display_date", "remaining")


def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.classify(F.col("text"), RULES, DEFAULT).alias("category"))


def classify_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a rules table."""
    rules = spark.createDataFrame([(i, c, k) for i, (c, ks) in enumerate(RULES) for k in ks], "priority int, category string, keyword string")
    docs = table(spark, sf_dir, "documents").withColumn("category", F.lit(None).cast("string"))
    told = routing.classify_by_table(docs, rules, F.col("text"), "doc_id")
    return told.select("doc_id", F.when(F.col("category") == "一般", DEFAULT).otherwise(F.col("category")).alias("category"))


def used_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(RULES)], "priority int, category string")
    return routing.used_categories(rules, announcements(spark, sf_dir))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_text(F.col("text")).cast("binary")).alias("digest"))


def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_url(F.col("url")).alias("url"), X.host(F.col("url")).alias("host"), X.origin(F.col("url")).alias("origin"))


def keyword_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = X.normalize_keyword(F.concat(F.lit("  "), "text", F.lit("\t")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(key.cast("binary")).alias("digest"), X.account_id(F.col("role")).alias("account"))


def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entities and table cells."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.html_escape(F.col("text")).cast("binary")).alias("escaped"), X.table_cell(title).alias("cell"))


def display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements(spark, sf_dir).select("id", X.display_date(F.col("date"), F.col("first_seen")).alias("display_date"))


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.canonical_json(name=F.col("c_name"), nation=F.col("c_nationkey"), segment=F.col("c_mktsegment")).alias("doc"))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents read by a schema."""
    e = table(spark, sf_dir, "events")
    empty = F.named_struct(F.lit("k"), F.lit(None).cast("long"))
    return e.select("event_id", X.safe_state(F.col("props"), "k LONG", empty)["k"].alias("k"))


def unread_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New announcements without a read row, with each school's badge."""
    reads = table(spark, sf_dir, "labels").select("doc_id")
    fresh = announcements(spark, sf_dir).where(routing.is_new(F.col("first_seen"), F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")))
    unread = routing.unread_items(fresh, reads, ["doc_id"])
    return unread.groupBy("school").agg(F.count("*").alias("unread")).withColumn("badge", routing.badge(F.col("unread")))


def read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.read_items(announcements(spark, sf_dir), table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("school", "category").agg(F.count("*").alias("n"))


def top_new_per_school(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.top_new_per_school(announcements(spark, sf_dir)).select("school", "id", "date")


def backfill_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest announcements without a date whose page wasn't fetched."""
    ann = announcements(spark, sf_dir).withColumns({"url": F.col("doc_id"), "snippet_tried": F.lit(False), "date_tried": F.lit(False)})
    fetched = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("url"))
    return routing.backfill_queue(routing.needs_backfill(ann, fetched), F.lit(11)).select("id")


def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sources; those of customers without events were never fetched."""
    e = table(spark, sf_dir, "events")
    state = e.groupBy(F.col("user_id").alias("url")).agg(F.max("ts").alias("fetched_at"))
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.when(F.col("c_mktsegment") == "MACHINERY", "hot").otherwise("cold").alias("tier"))
    due = routing.due_sources(sources, state, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return due.select("url", "tier", F.when(F.col("fetched_at").isNotNull(), F.round("age_hours", 3)).alias("age_hours"))


def split_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: announcements by tier."""
    tiers = merge.split_recent(announcements(spark, sf_dir), "2024-02-01")
    return tiers.groupBy("tier", "school").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def important_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High quality stands for a pinned announcement."""
    ann = announcements(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    ann = ann.withColumns({"important": F.col("toxic") == 1, "importance": F.lit("normal"), "source_pin": F.when(F.col("quality") == 0, "important")})
    ann = ann.withColumn("display_date", X.display_date(F.col("date"), F.col("first_seen")))
    return routing.important_top(ann).select("id", "display_date")


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, P7, Q1."""
    ann = announcements(spark, sf_dir).withColumn("url", F.concat(F.lit("http://"), "school"))
    profile = quality.quality_profile(ann, "2026")
    keys = quality.check_keys(ann).select("empty_ids", "damaged_titles")
    return profile.join(F.broadcast(keys))


def mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text").union(table(spark, sf_dir, "benchmark").select(F.lit("b"), "item_id", "text"))
    broken = F.encode("text", "UTF-8")
    return both.select("kind", "id", X.is_mojibake(F.col("text")).alias("damaged"), X.is_mojibake(F.decode(broken, "ISO-8859-1")).alias("misread"))


QUERIES = {f.__name__: f for f in (
    latest_search, classify_rules, classify_table, used_categories, clean_text, normalize_url, keyword_norm, escapes, display_dates, canonical_json, props_json, unread_items,
    read_items, top_new_per_school, backfill_queue, due_sources, split_recent, important_top, quality_profile, mojibake,
)}
_DAY = "coalesce(date, strftime(first_seen, '%Y-%m-%d'))"
ORACLE_SQL = {
    "latest_search": f"""
WITH {ANN}, f AS (
  SELECT id, title, {_DAY} AS display_date, first_seen, count(*) OVER () AS total FROM ann
  WHERE category = 'event' AND {' AND '.join(f"contains(lower(title || ' ' || snippet || ' ' || category || ' ' || source_category), '{t}')" for t in TOKENS)})
SELECT id, title, display_date, greatest(total - 200, 0) AS remaining FROM f ORDER BY display_date DESC, first_seen DESC, id LIMIT 200""",
    "classify_rules": f"SELECT doc_id, {case_sql('text')} AS category FROM documents",
    "classify_table": f"SELECT doc_id, {case_sql('text')} AS category FROM documents",
    "used_categories": f"""WITH {ANN}, r(priority, category) AS (VALUES {', '.join(f"({i}, '{c}')" for i, (c, _) in enumerate(RULES))})
SELECT category, priority FROM r WHERE category IN (SELECT category FROM ann)""",
    "clean_text": f"SELECT doc_id, md5({clean_sql('text')}) AS digest FROM documents",
    "normalize_url": r"""
SELECT page_id, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*') .lower() || substr(u, length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*')) + 1) AS url,
       lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin
FROM (SELECT *, regexp_replace(url, '[?#].*$', '', 's') AS u FROM pages)""",
    "keyword_norm": f"""SELECT conv_id, turn, md5(lower(regexp_replace('  ' || text || chr(9), '^{SPACES}|{SPACES}$', '', 'g'))) AS digest,
       coalesce(nullif(trim(role), ''), 'anonymous') AS account FROM conversations""",
    "escapes": """
SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped,
       CASE WHEN length(c) > 60 THEN left(c, 60) || '…' ELSE c END AS cell
FROM (SELECT *, replace(split_part(text, chr(10), 1), '|', '\\|') AS c FROM documents)""".replace("\\\\|", "\\|"),
    "display_dates": f"WITH {ANN} SELECT id, {_DAY} AS display_date FROM ann",
    "canonical_json": """SELECT c_custkey, '{"name":"' || c_name || '","nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}' AS doc FROM customer""",
    "props_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "unread_items": f"""WITH {ANN} SELECT school, count(*) AS unread, CASE WHEN count(*) > 99 THEN '99+' ELSE CAST(count(*) AS VARCHAR) END AS badge
FROM ann WHERE first_seen > TIMESTAMP '2024-01-05' AND doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY school""",
    "read_items": f"WITH {ANN} SELECT school, category, count(*) AS n FROM ann WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1, 2",
    "top_new_per_school": f"""WITH {ANN} SELECT school, id, date FROM
(SELECT *, row_number() OVER (PARTITION BY school ORDER BY date DESC NULLS LAST, id) AS n FROM ann) WHERE n <= 12""",
    "backfill_queue": f"""WITH {ANN} SELECT id FROM ann WHERE (date IS NULL OR coalesce(snippet, '') = '') AND doc_id NOT IN (SELECT doc_id FROM labels)
ORDER BY first_seen DESC, id LIMIT 80""",
    "due_sources": """
WITH s AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1),
a AS (SELECT c_custkey AS url, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'hot' ELSE 'cold' END AS tier,
             date_diff('microsecond', ts, TIMESTAMP '2024-01-30 12:00:00') / 3.6e9 AS age FROM customer LEFT JOIN s ON c_custkey = user_id)
SELECT url, tier, round(age, 3) AS age_hours FROM a WHERE tier = 'hot' OR age IS NULL OR age >= 20""",
    "split_recent": f"""WITH {ANN} SELECT CASE WHEN {_DAY} >= '2024-02-01' THEN 'recent' ELSE 'archive' END AS tier, school, count(*) AS n, min(id) AS first_id
FROM ann GROUP BY 1, 2""",
    "important_top": f"""WITH {ANN} SELECT id, {_DAY} AS display_date FROM ann JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0
ORDER BY {_DAY} DESC, first_seen DESC, id LIMIT 3""",
    # a text's UTF-8 bytes read as Latin-1 match where it has a character of two bytes up to U+00FF, or of three with a first byte E2, E4, E5 or E6
    "mojibake": r"""SELECT kind, id, regexp_matches(text, '[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]|[ÃÂ][\x{80}-\x{bf}]|â[\x{80}-\x{bf}]{2}|[äæå][\x{80}-\x{bf}]\S') AS damaged,
regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]|[\x{80}-\x{ff}]|[\x{2000}-\x{2fff}]|[\x{4000}-\x{6fff}]') AS misread
FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)""",
    "quality_profile": f"""WITH {ANN} SELECT count(*) AS "rows", count(*) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (WHERE title = '') AS empty_titles,
count(*) FILTER (WHERE snippet = '') AS empty_snippets, count(*) FILTER (WHERE contains(title, chr(65533))) AS replacement_chars, CAST(0 AS BIGINT) AS bad_urls,
count(*) FILTER (WHERE left(coalesce(date, ''), 4) > '2026') AS future_dates, count(*) FILTER (WHERE id = '') AS empty_ids,
count(*) FILTER (WHERE title = '' OR contains(title, chr(65533))) AS damaged_titles FROM ann""",
}
