"""Queries that merge observations, states and outboxes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, merge, quality
from .views import table

_DAY = "yyyy-MM-dd"


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as observations of parts: the supplier is the page, the return flag the kind of date."""
    source = F.when(F.col("l_returnflag") == "A", "publication").when(F.col("l_returnflag") == "N", "list").otherwise("article_meta")
    date = F.when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", _DAY))
    seq = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.concat(F.lit("HTTP://x/p/403-1-"), "l_suppkey", F.lit("-1.php?p=1")).alias("source_url"), date.alias("date"), source.alias("date_source"), seq,
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
    )


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a positive balance are configured, by name descending."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return s.select(F.concat(F.lit("http://x/p/403-1-"), "s_suppkey", F.lit("-1.php")).alias("url"), (-F.col("s_suppkey")).cast("int").alias("rank"))


def canonical_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    ranked = merge.with_source_rank(_observations(spark, sf_dir), _sources(spark, sf_dir))
    return merge.canonical_source(ranked).select("id", F.col("source_rank.url").alias("url"), "seq")


def best_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    ranked = merge.with_source_rank(_observations(spark, sf_dir), _sources(spark, sf_dir))
    return merge.best_date(ranked)


def collect_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 and W2 in one shuffle."""
    return merge.collect(_observations(spark, sf_dir).select("id", "source_url", "date", "date_source", "seq"), _sources(spark, sf_dir))


def new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line item."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return merge.new_items(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Open and finished orders per customer, as stored and collected rows."""
    o = table(spark, sf_dir, "orders")

    def side(status: str, source: str) -> DataFrame:
        return o.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("id")).agg(
            F.min("o_orderpriority").alias("title"), F.date_format(F.min("o_orderdate"), _DAY).alias("date"), F.lit(source).alias("date_source"),
            F.when(F.count("*") > 3, F.lit("many")).alias("source_category"), F.lit(None).cast("string").alias("snippet"), F.date_format(F.max("o_orderdate"), _DAY).alias("first_seen"),
        )

    return side("O", "list"), side("F", "publication")


def merge_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, W3."""
    return merge.merge_with_existing(*_sides(spark, sf_dir)).drop("snippet")


def apply_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details for customers with finished orders."""
    items, details = _sides(spark, sf_dir)
    flags = {"url": F.col("id"), "snippet_tried": F.lit(False), "date_tried": F.lit(False)}
    seen = details.withColumns({"url": F.col("id"), "snippet": F.col("source_category")})
    return merge.apply_detail(items.withColumns(flags), seen).select("id", "title", "snippet", "date", "date_source", "snippet_tried", "date_tried")


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as writes of two devices; finished ones are deletions."""
    o = table(spark, sf_dir, "orders")
    parts = [o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), o.where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))]
    rows = [p.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("v")) for p in parts]
    return rows[0].unionByName(rows[1])


def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each customer."""
    return merge.lww_merge(_devices(spark, sf_dir), ["k"], "ts", "deleted_at", ["v"]).select("k", F.date_format("ts", _DAY).alias("day"), F.col("deleted_at").isNotNull().alias("deleted"), "v")


def merge_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last read of each user and event type."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("announcement_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("read_at"))
    return merge.merge_reads(rows)


def merge_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest document of each user; documents of errors are malformed."""
    e = table(spark, sf_dir, "events")
    doc = F.when(F.col("event_type") == "error", F.lit("[1")).otherwise(F.col("props"))
    rows = e.select(F.col("user_id").cast("string").alias("user_id"), F.lit(2).alias("schema_version"), doc.alias("preferences"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("updated_at"))
    return merge.merge_preferences(rows)


def adopt_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as devices, roles as accounts, turns as logins."""
    c = table(spark, sf_dir, "conversations")
    logins = c.select(F.col("conv_id").alias("device"), F.col("role").alias("account"), F.col("turn").alias("login_at"))
    baseline = c.groupBy(F.col("conv_id").alias("device")).agg(F.count("*").alias("rows"))
    return merge.adopt_baseline_once(baseline, logins).select("device", "account", "rows")


def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mutations of users, views as acks."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("id"), "event_type")
    return merge.outbox_pending(e, e.where("event_type = 'view'")).select("account_id", "id", "seq")


def outbox_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events before the first error."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    return merge.outbox_prefix(e).select("account_id", "seq")


def legacy_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as logs of line items that all name the log's owner, a return flag, or not."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("log"), F.lit("N").alias("owner"), F.col("l_returnflag").alias("account_id"), F.col("l_linenumber").alias("turn"), "l_partkey")
    return merge.legacy_outbox(li).select("log", "turn", "l_partkey")


def _list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as list pages: suppliers are categories, months since the first are page numbers."""
    li = table(spark, sf_dir, "lineitem")
    page = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    grouped = li.groupBy(F.col("l_suppkey").alias("category"), page.alias("page_no"))
    return grouped.agg(F.array_sort(F.collect_set((F.col("l_partkey") % 97).cast("string"))).alias("ids"), F.array_sort(F.collect_set(F.date_format("l_shipdate", _DAY))).alias("dates"))


def pagination_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages before 1996-06 are older than the cutoff, those of every seventh month have no ids, of every fifth no dates."""
    pages = _list_pages(spark, sf_dir)
    none = F.array().cast("array<string>")
    ids = F.when(F.col("page_no") % 7 == 0, none).otherwise(F.col("ids"))
    dates = F.when(F.col("page_no") % 5 == 0, none).otherwise(F.col("dates"))
    return merge.pagination_stop(pages.withColumns({"page_no": -F.col("page_no"), "ids": ids, "dates": dates}), "1996-06-01")


def pagination_stop_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    return merge.pagination_stop_previous(_list_pages(spark, sf_dir), 12 * 1998)


def candidate_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as urls, return flags as discovery stages."""
    li = table(spark, sf_dir, "lineitem")
    return merge.candidate_priority(li.select(F.col("l_partkey").alias("url"), F.col("l_returnflag").alias("stage"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq")))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' finished orders over their open ones."""
    old, new = _sides(spark, sf_dir)
    return merge.upsert_by_key(old.select("id", "date"), new.select("id", "date"), ["id"])


def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2."""
    old, new = _sides(spark, sf_dir)
    return merge.delete_by_key(old.select("id", "date"), new, ["id"])


def add_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: event types of users as keywords, purchases as those already there."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subscriber"), F.concat(F.lit(" "), "event_type").alias("keyword"))
    old = e.where("keyword = ' purchase'").select("subscriber", F.trim("keyword").alias("keyword")).distinct()
    return merge.add_unique_keyword(old, e)


def project_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged writes of customers as subscriptions, nations as known ones."""
    merged = merge.lww_merge(_devices(spark, sf_dir), ["k"], "ts", "deleted_at", ["v"]).select(F.col("k").cast("string").alias("normalized_keyword"), F.col("k").cast("string").alias("keyword"), F.col("v").alias("id"), "deleted_at")
    local = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("normalized_keyword"), F.col("n_name").alias("id"), F.lit("2024-01-01").alias("created_at"))
    return merge.project_subscriptions(merged, local, F.lit("2024-06-01"))


def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: orders against tiers that lack the pending ones and have urgent ones twice."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", _DAY).alias("date"), F.lit(None).cast("string").alias("first_seen"), "o_orderstatus", "o_orderpriority")
    tiers = merge.split_recent(o, "1997-01-01")
    broken = tiers.where("o_orderstatus <> 'P'").unionByName(tiers.where("o_orderpriority = '1-URGENT'"))
    return quality.lost_ids(o, broken).select("id", "n")


def adopt_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    old, new = _sides(spark, sf_dir)
    return merge.adopt_archive(new, old).select("id", "date_source", "date")


def census_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against labels, by side."""
    diff = graph.census_diff(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    return diff.groupBy("side").agg(F.count("*").alias("n"), F.min("id").alias("least"))


QUERIES = {f.__name__: f for f in (
    canonical_source, best_date, collect_run, new_items, merge_existing, apply_detail, lww_merge, merge_reads, merge_preferences, adopt_once, outbox_pending, outbox_prefix,
    legacy_outbox, pagination_stop, pagination_stop_previous, candidate_priority, upsert, delete, add_keywords, project_subscriptions, partition_check, adopt_archive, census_diff,
)}
_OBS = """s AS (SELECT 'http://x/p/403-1-' || s_suppkey || '-1.php' AS url, -s_suppkey AS rank FROM supplier WHERE s_acctbal > 5000),
o AS (SELECT l_partkey AS id, 'http://x/p/403-1-' || l_suppkey || '-1.php' AS url, l_orderkey * 100 + l_linenumber AS seq, l_extendedprice AS price, l_suppkey AS cat,
  CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') END AS date,
  CASE l_returnflag WHEN 'A' THEN 'publication' WHEN 'N' THEN 'list' ELSE 'article_meta' END AS date_source,
  CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 1 ELSE 3 END AS trust FROM lineitem),
r AS (SELECT o.*, CASE WHEN s.url IS NULL THEN 1 ELSE 0 END AS kind, coalesce(s.rank, cat) AS place FROM o LEFT JOIN s ON o.url = s.url)"""
_SIDES = """side AS (SELECT o_custkey AS id, o_orderstatus AS st, min(o_orderpriority) AS title, strftime(min(o_orderdate), '%Y-%m-%d') AS date,
  CASE WHEN count(*) > 3 THEN 'many' END AS source_category, strftime(max(o_orderdate), '%Y-%m-%d') AS first_seen FROM orders GROUP BY 1, 2),
e AS (SELECT *, 'list' AS date_source FROM side WHERE st = 'O'), c AS (SELECT *, 'publication' AS date_source FROM side WHERE st = 'F')"""
_LWW = """w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') DESC) AS n FROM orders)"""
_PAGES = """p AS (SELECT l_suppkey AS category, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS page_no, CAST(l_partkey % 97 AS VARCHAR) AS id,
  strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem)"""
ORACLE_SQL = {
    "canonical_source": f"WITH {_OBS} SELECT id, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, place, url, seq) AS n FROM r) WHERE n = 1",
    "best_date": f"""WITH {_OBS}, d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY trust DESC, kind, place, url, seq) AS n FROM r WHERE date IS NOT NULL)
SELECT i.id, d.date, d.date_source FROM (SELECT DISTINCT id FROM r) i LEFT JOIN d ON i.id = d.id AND n = 1""",
    "collect_run": f"""WITH {_OBS}, d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY trust DESC, kind, place, url, seq) AS n FROM r WHERE date IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, place, url, seq) AS n FROM r)
SELECT b.id, 'HTTP' || substr(b.url, 5) || '?p=1' AS source_url, d.date, d.date_source, b.seq FROM b LEFT JOIN d ON b.id = d.id AND d.n = 1 WHERE b.n = 1""",
    "new_items": "SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "merge_existing": f"""WITH {_SIDES} SELECT coalesce(e.id, c.id) AS id, coalesce(e.title, c.title) AS title, CASE WHEN c.id IS NULL THEN e.date ELSE c.date END AS date,
CASE WHEN c.id IS NULL THEN e.date_source ELSE c.date_source END AS date_source, coalesce(e.source_category, c.source_category) AS source_category,
coalesce(e.first_seen, c.first_seen) AS first_seen, e.id IS NULL AS is_new FROM e FULL JOIN c ON e.id = c.id""",
    "apply_detail": f"""WITH {_SIDES} SELECT e.id, coalesce(c.title, e.title) AS title, c.source_category AS snippet, coalesce(c.date, e.date) AS date,
coalesce(c.date_source, e.date_source) AS date_source, c.id IS NOT NULL AND c.source_category IS NULL AS snippet_tried, false AS date_tried FROM e LEFT JOIN c ON e.id = c.id""",
    "lww_merge": f"WITH {_LWW} SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus = 'F' AS deleted, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS v FROM w WHERE n = 1",
    "merge_reads": "SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS announcement_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS read_at FROM events GROUP BY 1, 2",
    "merge_preferences": """SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS schema_version,
CASE WHEN event_type = 'error' THEN '{}' ELSE props END AS preferences, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1""",
    "adopt_once": "SELECT conv_id AS device, arg_min(role, turn) AS account, count(*) AS \"rows\" FROM conversations GROUP BY 1",
    "outbox_pending": """WITH e AS (SELECT user_id AS account_id, json_extract_string(props, '$.k') AS id, event_id AS seq, event_type FROM events)
SELECT account_id, id, min(seq) AS seq FROM e GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event_type = 'view') = 0""",
    "outbox_prefix": """SELECT account_id, seq FROM (SELECT user_id AS account_id, event_id AS seq,
sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS f FROM events) WHERE f = 0""",
    "legacy_outbox": "SELECT l_orderkey AS log, l_linenumber AS turn, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'N'))",
    "pagination_stop": f"""WITH {_PAGES}, f AS (SELECT category, id, min(-page_no) AS page_no FROM p WHERE page_no % 7 <> 0 GROUP BY 1, 2),
n AS (SELECT category, page_no, count(*) AS fresh FROM f GROUP BY 1, 2), g AS (SELECT category, -page_no AS page_no, max(CASE WHEN page_no % 5 <> 0 THEN d END) AS newest FROM p GROUP BY 1, 2),
t AS (SELECT g.*, CASE WHEN page_no % 7 = 0 THEN 'empty' WHEN fresh IS NULL THEN 'repeated' WHEN newest < '1996-06-01' THEN 'before cutoff' END AS reason FROM g LEFT JOIN n USING (category, page_no))
SELECT category, min(page_no) AS page_no, arg_min(reason, page_no) AS reason FROM t WHERE reason IS NOT NULL GROUP BY 1""",
    "pagination_stop_previous": f"""WITH {_PAGES}, g AS (SELECT category, page_no, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM p GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN ids = lag(ids) OVER (PARTITION BY category ORDER BY page_no) THEN 'repeated' WHEN page_no >= {12 * 1998} THEN 'ceiling' END AS reason FROM g)
SELECT category, min(page_no) AS page_no, arg_min(reason, page_no) AS reason FROM t WHERE reason IS NOT NULL GROUP BY 1""",
    "candidate_priority": """SELECT url, stage, seq FROM (SELECT l_partkey AS url, l_returnflag AS stage, l_orderkey * 100 + l_linenumber AS seq,
row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_orderkey * 100 + l_linenumber) AS n FROM lineitem) WHERE n = 1""",
    "upsert": f"WITH {_SIDES} SELECT id, date FROM c UNION ALL SELECT id, date FROM e WHERE id NOT IN (SELECT id FROM c)",
    "delete": f"WITH {_SIDES} SELECT id, date FROM e WHERE id NOT IN (SELECT id FROM c)",
    "add_keywords": "SELECT DISTINCT user_id AS subscriber, event_type AS keyword FROM events",
    "project_subscriptions": f"""WITH {_LWW} SELECT CAST(o_custkey AS VARCHAR) AS normalized_keyword, CAST(o_custkey AS VARCHAR) AS keyword,
coalesce(n_name, lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS id, CASE WHEN n_name IS NULL THEN '2024-06-01' ELSE '2024-01-01' END AS created_at
FROM w LEFT JOIN nation ON o_custkey = n_nationkey WHERE n = 1 AND o_orderstatus <> 'F'""",
    "partition_check": """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN CAST(1 AS BIGINT) ELSE -1 END AS n FROM orders WHERE (o_orderstatus = 'P') <> (o_orderpriority = '1-URGENT')""",
    "adopt_archive": f"WITH {_SIDES} SELECT id, date_source, date FROM c UNION ALL SELECT id, date_source, date FROM e WHERE id NOT IN (SELECT id FROM c)",
    "census_diff": """WITH u AS (SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'live only' WHEN d.doc_id IS NULL THEN 'stored only' ELSE 'both' END AS side
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) SELECT side, count(*) AS n, min(id) AS least FROM u GROUP BY 1""",
}
