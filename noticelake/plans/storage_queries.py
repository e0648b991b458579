"""Queries that write tables through the sinks and read them back through the readers, and small expressions on them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import calendar, merge, quality, routing
from ..sources import readers, writers
from ..sources.folders import work_dir
from .views import table

_DAY = "yyyy-MM-dd"
KEYWORDS = ("thedst", " Boas", "")


def _text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def _documents(rows: DataFrame, part: str, folder: str) -> None:
    """One JSON document a file: `rows` (part, value), one row a part."""
    rows.repartition(part).write.partitionBy(part).text(folder)


def pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1."""
    return readers.read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("digest"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as announcements of their priority."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("school"), F.concat(F.lit("Order "), "o_orderkey").alias("title"),
        F.date_format("o_orderdate", _DAY).alias("date"), F.lit(None).cast("string").alias("first_seen"), F.col("o_custkey").alias("customer"),
    )


def snapshot_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a snapshot by tier, published after its checks; its rows, each with its stored id."""
    path = writers.write_snapshot(_items(spark, sf_dir), work_dir(spark, "snapshot"), "1997-01-01", max_items=1 << 40)
    return spark.read.parquet(path).select("id", "tier", "date").join(readers.read_stored_ids(spark, path), "id")


def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each status as a JSON document of recent items, of each priority as one of archived items."""
    folder = work_dir(spark, "documents")
    rows = _items(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus"), "id")
    for name, part, tag, kept in (("recent", "o_orderstatus", "r", F.col("date") >= "1997-01-01"), ("archive", "school", "a", F.col("date") < "1998-01-01")):
        item = F.struct("id", "title", "date", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.lit(tag)).alias("category"))
        documents = rows.where(kept).groupBy(part).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("value"))
        _documents(documents, part, f"{folder}/{name}")
    return readers.read_snapshot(spark, f"{folder}/recent", f"{folder}/archive").select("id", "title", "date", "category")


def sources_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, E5: nations as schools of a configuration a region: two scan pages, suppliers as list pages with and without tier."""
    folder = work_dir(spark, "config")
    entry = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct(F.col("s_name").alias("url"), F.lit("hot").alias("tier")))).otherwise(F.to_json(F.array("s_name")))
    own = table(spark, sf_dir, "supplier").withColumn("entry", F.regexp_replace(entry, r"^\[|\]$", ""))
    listed = own.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "entry"))).alias("l"))
    n = table(spark, sf_dir, "nation").join(listed, F.col("n_nationkey") == F.col("s_nationkey"))
    pages = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["entry"]), ","), F.lit("]"))
    school = F.concat(F.lit('{"id":"'), "n_name", F.lit('","scan_pages":["a/'), "n_name", F.lit('","b/'), "n_name", F.lit('"],"list_pages":'), pages, F.lit("}"))
    documents = n.groupBy("n_regionkey").agg(F.concat(F.lit('{"schools":['), F.array_join(F.collect_list(school), ","), F.lit("]}")).alias("value"))
    _documents(documents, "n_regionkey", folder)
    return readers.read_sources(spark, folder).select("school", "url", "tier", "rank")


def ignored_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: users' event types as categories that a configuration a type leaves out."""
    folder = work_dir(spark, "ignored")
    refs = table(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").cast("string").alias("school")).agg(F.collect_set("event_type").alias("refs"))
    documents = refs.groupBy("event_type").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("school", "refs"))).alias("coverage_ignore"))).alias("value"))
    _documents(documents.withColumnRenamed("event_type", "part"), "part", folder)
    return readers.read_ignored(spark, folder)


def fetch_state_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users' last events as a JSON map of fetch times an event type; those of errors are unreadable."""
    folder = work_dir(spark, "fetched")
    e = table(spark, sf_dir, "events")
    last = e.groupBy("event_type", "user_id").agg(F.max("ts").alias("ts"))
    when = F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    entry = F.struct(F.concat_ws("/", "event_type", "user_id").alias("url"), when.alias("t"))
    documents = last.groupBy("event_type").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    _documents(documents, "event_type", folder)
    return readers.read_fetch_state(spark, folder).select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))


def fetch_state_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: customers as urls, those with orders fetched; a second version moves the open ones' customers on."""
    folder, o = work_dir(spark, "fetched"), table(spark, sf_dir, "orders")
    old = o.groupBy(F.col("o_custkey").alias("url")).agg(F.max("o_orderdate").alias("fetched_at"))
    writers.write_fetch_state(old.limit(0), old, folder)
    fetched = o.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("url")).agg(F.lit("2030-01-01").cast("timestamp_ntz").alias("fetched_at"))
    path = writers.write_fetch_state(spark.read.parquet(writers.current_version(spark, folder)), fetched, folder)
    return spark.read.parquet(path).select("url", F.date_format("fetched_at", _DAY).alias("day"))


def subscriptions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as subscription groups, their first two words as keywords."""
    folder = work_dir(spark, "groups")
    words = F.slice(F.split("text", " "), 1, 2)
    group = F.struct(F.concat(F.lit("g"), "item_id").alias("name"), F.when(F.col("item_id") % 2 == 0, "even").alias("topic_suffix"), words.alias("keywords"))
    rows = table(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 7).alias("part")).agg(F.to_json(F.collect_list(group)).alias("value"))
    _documents(rows, "part", folder)
    return readers.read_subscriptions(spark, folder).select("name", "topic_suffix", F.explode("keywords").alias("keyword"))


def events_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as curated and, with their status as provenance, as official events a priority; some lack a title or provenance."""
    folder = work_dir(spark, "events")
    o = table(spark, sf_dir, "orders")
    title = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("Order "), "o_orderkey"))
    event = F.struct(F.date_format("o_orderdate", _DAY).alias("date"), title.alias("title"), F.col("o_orderstatus").alias("school"), F.when(F.col("o_orderstatus") == "O", "page").alias("provenance"))
    _documents(o.groupBy(F.left("o_orderpriority", F.lit(1)).alias("part")).agg(F.to_json(F.collect_list(event)).alias("value")), "part", folder)
    curated = readers.read_events(spark, folder).select(F.lit("curated").alias("kind"), "date", "title")
    return curated.unionByName(readers.read_official_events(spark, folder).select(F.lit("official").alias("kind"), "date", "title"))


def user_state_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users' keywords, reads and preferences written under their owners, then read back."""
    folder, e = work_dir(spark, "users"), table(spark, sf_dir, "events")
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = e.select(F.col("user_id").cast("string").alias("owner"), F.lit("other").alias("user_id"), F.col("event_id").alias("id"), "event_type", when.alias("at"), "props")
    kinds = {
        "user_subscriptions": (["user_id", "normalized_keyword"], {"normalized_keyword": "event_type", "keyword": "event_type", "created_at": "at", "updated_at": "at"}),
        "user_reads": (["user_id", "announcement_id"], {"announcement_id": "event_type", "read_at": "at"}),
        "user_preferences": (["user_id"], {"preferences": "props", "updated_at": "at"}),
    }
    for name, (keys, columns) in kinds.items():
        own = rows.select("owner", "user_id", "id", *[F.col(c).alias(n) for n, c in columns.items()])
        last = quality.first_by(own.withColumn("at", F.col(columns.get("read_at") and "read_at" or "updated_at")), ["owner", *keys[1:]], F.desc("at")).drop("at")
        path = writers.upsert_user_rows(last, f"{folder}/{name}-versions", keys, F.col("owner"))
        spark.read.parquet(path).drop("owner").write.parquet(f"{folder}/{name}")
    subs, reads, prefs = readers.read_user_state(spark, folder)
    kinds_read = [subs.select(F.lit("subscription").alias("kind"), "user_id", F.col("updated_at").alias("at")), reads.select(F.lit("read"), "user_id", "read_at"), prefs.select(F.lit("preferences"), "user_id", "updated_at")]
    return kinds_read[0].union(kinds_read[1]).union(kinds_read[2])


def _back(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def new_items_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: orders without a line item."""
    path = work_dir(spark, "new")
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"))
    writers.write_new_items(merge.new_items(_items(spark, sf_dir), known), path)
    return _back(spark, path, "id string, title string, date string, customer long")


def coverage_gaps_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: event types that users have and no list covers."""
    path, e = work_dir(spark, "gaps"), table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("school"), F.col("event_type").alias("cat_ref"), F.col("props").alias("title"), F.col("event_id").cast("string").alias("url"), F.col("event_id").alias("seq"))
    none = rows.select("school", "cat_ref").limit(0)
    writers.write_coverage_gaps(quality.coverage_gaps(rows, none, none), path)
    return _back(spark, path, "school long, cat_ref string, count long, example_url string")


def calendar_feed_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: a feed of orders."""
    path, o = work_dir(spark, "feed"), table(spark, sf_dir, "orders")
    events = o.select(F.date_format("o_orderdate", _DAY).alias("date"), F.lit(None).cast("string").alias("end_date"), F.col("o_orderpriority").alias("school"), F.concat(F.lit("Order "), "o_orderkey").alias("title"))
    writers.write_calendar_feed(calendar.feed_rows(events), path)
    return _back(spark, path, "date string, dtstart string, dtend string, summary string")


def audit_report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: pages of orders, and how many of their orders no other page has."""
    path = work_dir(spark, "audit")
    writers.write_audit_report(quality.page_overlap(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("article"))), path, ["page"])
    return _back(spark, path, "page long, articles long, exclusive long")


def any_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any of a user's keywords."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(routing.match_any_keyword(F.lower("text"), F.transform(F.array(*map(F.lit, KEYWORDS)), lambda k: F.trim(k)))).select("doc_id", "lang")


def owner_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders asked for by the customer whose number their order's is, modulo 1000."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return routing.owner_scope(rows.withColumn("user_id", F.col("user_id") % 50), F.col("o_orderkey") % 50).select("o_orderkey", "user_id")


def tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users' event types as rows, their errors as later deletions of all they had until then."""
    e = table(spark, sf_dir, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = e.where("event_type <> 'error'").select(F.col("user_id").cast("string").alias("k"), at.alias("updated_at"), F.lit(None).cast("string").alias("deleted_at"))
    gone = e.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("k"), at.alias("updated_at"), at.alias("deleted_at"))
    return merge.tombstone(rows, gone, ["k"]).select("k", "updated_at", F.col("deleted_at").isNotNull().alias("deleted"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as categories of nations: slug of their market, list pages, ids and labels."""
    s = table(spark, sf_dir, "supplier").withColumn("url", F.concat(F.lit("http://h/p/403-"), "s_nationkey", F.lit("-"), "s_suppkey", F.lit("-1.php")))
    ids = X.list_page_ids(F.col("url"))
    slugs = {"0": "zero", "1": "one"}
    return s.select(
        "s_suppkey", X.category_slug((F.col("s_suppkey") % 3).cast("string"), slugs, "other").alias("slug"), X.page_number_url(F.col("url"), F.col("s_suppkey") % 5 + 1).alias("page"),
        ids["unit"].alias("unit"), ids["category"].alias("category"), X.page_label(ids["unit"], F.when(F.col("s_suppkey") % 2 == 0, ids["category"]).otherwise("home")).alias("label"),
    )


def relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """links relative to each page, with dot segments."""
    p = table(spark, sf_dir, "pages").withColumn("base", F.concat(X.origin(F.col("url")), F.lit("/a/b/c.php?q#f")))
    hrefs = ("../x.php", "./y/../z/", "../../../up?k=../v", "d/./e/..", "/r/../s#../t", "..", "?only", "#frag", "plain")
    rows = p.select("page_id", "base", F.explode(F.array(*map(F.lit, hrefs))).alias("href"))
    return rows.select("page_id", "href", X.resolve_url(F.col("base"), F.col("href")).alias("link"))


QUERIES = {f.__name__: f for f in (
    pages_read, snapshot_written, snapshot_read, sources_read, ignored_read, fetch_state_read, fetch_state_written, subscriptions_read, events_read, user_state_read,
    new_items_written, coverage_gaps_written, calendar_feed_written, audit_report_written, any_keyword, owner_scope, tombstone, page_labels, relative_links,
)}
_LINKED = (("../x.php", "/a/x.php"), ("./y/../z/", "/a/b/z/"), ("../../../up?k=../v", "/up?k=../v"), ("d/./e/..", "/a/b/d/"), ("/r/../s#../t", "/s#../t"), ("..", "/a/"), ("?only", "/a/b/c.php?only"), ("#frag", "/a/b/c.php?q#frag"), ("plain", "/a/b/plain"))
_OVERLAP = """WITH p AS (SELECT DISTINCT l_suppkey AS page, l_orderkey AS article FROM lineitem), q AS (SELECT *, count(*) OVER (PARTITION BY article) AS n FROM p)
SELECT page, count(*) AS articles, count(*) FILTER (WHERE n = 1) AS exclusive FROM q GROUP BY 1"""
ORACLE_SQL = {
    "pages_read": "SELECT page_id, url, md5(html) AS digest FROM pages WHERE html IS NOT NULL",
    "snapshot_written": "SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderdate >= '1997-01-01' THEN 'recent' ELSE 'archive' END AS tier FROM orders",
    "snapshot_read": """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date,
CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderdate >= '1997-01-01' THEN 'r' ELSE 'a' END AS category FROM orders""",
    "sources_read": """WITH n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))
SELECT n_name AS school, k || '/' || n_name AS url, 'hot' AS tier, CAST(r AS INTEGER) AS rank FROM n, (VALUES ('a', 0), ('b', 1)) v(k, r)
UNION ALL SELECT n_name, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'hot' ELSE 'cold' END, CAST(1 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "ignored_read": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS school, event_type AS cat_ref FROM events",
    "fetch_state_read": "SELECT event_type || '/' || user_id AS url, CASE WHEN event_type <> 'error' THEN strftime(max(ts), '%Y-%m-%d %H:%M:%S') END AS fetched_at FROM events GROUP BY event_type, user_id",
    "fetch_state_written": "SELECT o_custkey AS url, CASE WHEN bool_or(o_orderstatus = 'O') THEN '2030-01-01' ELSE strftime(max(o_orderdate), '%Y-%m-%d') END AS day FROM orders GROUP BY 1",
    "subscriptions_read": "SELECT 'g' || item_id AS name, CASE WHEN item_id % 2 = 0 THEN 'even' END AS topic_suffix, unnest(list_slice(string_split(text, ' '), 1, 2)) AS keyword FROM benchmark",
    "events_read": """SELECT 'curated' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Order ' || o_orderkey AS title FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'official', strftime(o_orderdate, '%Y-%m-%d'), 'Order ' || o_orderkey FROM orders WHERE o_orderstatus = 'O'""",
    "user_state_read": """WITH k AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS "at" FROM events GROUP BY 1, 2)
SELECT 'subscription' AS kind, user_id, "at" FROM k UNION ALL SELECT 'read', user_id, "at" FROM k UNION ALL SELECT 'preferences', user_id, max("at") FROM k GROUP BY user_id""",
    "new_items_written": """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey AS customer
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "coverage_gaps_written": "SELECT user_id AS school, event_type AS cat_ref, count(*) AS count, CAST(min(event_id) AS VARCHAR) AS example_url FROM events GROUP BY 1, 2",
    "calendar_feed_written": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y%m%d') AS dtstart, strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d') AS dtend,
'[' || o_orderpriority || '] Order ' || o_orderkey AS summary FROM orders""",
    "audit_report_written": _OVERLAP,
    "any_keyword": f"SELECT doc_id, lang FROM documents WHERE {' OR '.join(f'contains(lower(text), {k.strip().lower()!r})' for k in KEYWORDS if k.strip())}",
    "owner_scope": "SELECT o_orderkey, o_custkey % 50 AS user_id FROM orders WHERE o_custkey % 50 = o_orderkey % 50",
    "tombstone": """SELECT CAST(user_id AS VARCHAR) AS k, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS updated_at, arg_max(event_type = 'error', ts) AS deleted FROM events GROUP BY 1""",
    "page_labels": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'other' END AS slug, 'http://h/p/403-' || s_nationkey || '-' || s_suppkey || '-' || (s_suppkey % 5 + 1) || '.php' AS page,
CAST(s_nationkey AS VARCHAR) AS unit, CAST(s_suppkey AS VARCHAR) AS category, CASE WHEN s_suppkey % 2 = 0 THEN '403-' || s_nationkey || '-' || s_suppkey ELSE 'home' END AS label FROM supplier""",
    "relative_links": "SELECT page_id, href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || path AS link FROM pages, (VALUES " + ", ".join(f"('{h}', '{p}')" for h, p in _LINKED) + ") v(href, path)",
}
