"""Data-quality checks and audit aggregates."""

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import COMMON_TITLE_MIN_PAGES, MAX_ITEMS
from ..functions.text import empty_as_null, is_mojibake
from ..sources.folders import delete, work_dir

#: Of the largest gain: the pages with so much compete before the others are looked at. See `cover_pages`.
COVER_SHARE = 0.8


def check_keys(items: DataFrame) -> DataFrame:
    """One row: rows, empty_ids, duplicate_ids, damaged_titles (empty or mojibake)."""
    id_, title = empty_as_null(F.col("id")), empty_as_null(F.col("title"))
    return items.agg(
        F.count("*").alias("rows"),
        F.count_if(id_.isNull()).alias("empty_ids"),
        (F.count(id_) - F.count_distinct(id_)).alias("duplicate_ids"),
        F.count_if(title.isNull() | is_mojibake(title)).alias("damaged_titles"),
    )


def require_keys(items: DataFrame, label: str, allow_empty: bool = False) -> None:
    found = check_keys(items).first()
    bad = {k: found[k] for k in ("empty_ids", "duplicate_ids", "damaged_titles") if found[k]}
    if bad or (not found["rows"] and not allow_empty):
        raise ValueError(f"{label} fails its checks: {bad or 'it is empty'}")


def require_capacity(items: DataFrame, max_items: int = MAX_ITEMS) -> None:
    """Never truncates: too many rows are an error."""
    n = items.count()
    if n > max_items:
        raise ValueError(f"{n} rows; at most {max_items} are allowed")


def lost_ids(items: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, n) where the parts have an id more or less often than the whole."""
    both = items.select("id", F.lit(1).alias("k")).union(parts.select("id", F.lit(-1).alias("k")))
    return both.groupBy("id").agg(F.sum("k").alias("n")).where("n <> 0")


def require_lossless(items: DataFrame, parts: DataFrame) -> None:
    if not lost_ids(items, parts).isEmpty():
        raise ValueError("the parts don't have exactly the ids of the whole")


def check_constraints(rows: DataFrame, not_blank: Sequence[str], unique: Sequence[str]) -> DataFrame:
    """(rule, violations): blank values of each column, and keys that occur more than once."""
    blank = rows.agg(*[F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(c) for c in not_blank])
    blank = blank.select(F.explode(F.create_map(*[x for c in not_blank for x in (F.lit(f"{c} not blank"), F.col(c))])).alias("rule", "violations"))
    repeated = rows.groupBy(*unique).count().where("count > 1").agg(F.count("*").alias("violations"))
    return blank.unionByName(repeated.select(F.lit(f"unique {','.join(unique)}").alias("rule"), "violations"))


def listed_categories(items: DataFrame) -> DataFrame:
    """(school, cat_ref, count, e: title and url of the first) of items (school, cat_ref, title, url, seq)."""
    first = F.min_by(F.struct("title", "url"), "seq")
    return items.where(empty_as_null(F.col("cat_ref")).isNotNull()).groupBy("school", "cat_ref").agg(F.count("*").alias("count"), first.alias("e"))


def open_categories(listed: DataFrame, configured: DataFrame, ignored: DataFrame) -> DataFrame:
    """`coverage_gaps` of `listed_categories`."""
    gaps = listed.join(configured, ["school", "cat_ref"], "left_anti").join(ignored, ["school", "cat_ref"], "left_anti")
    return gaps.select("school", "cat_ref", "count", F.col("e.title").alias("example_title"), F.col("e.url").alias("example_url"))


def coverage_gaps(items: DataFrame, configured: DataFrame, ignored: DataFrame) -> DataFrame:
    """(school, cat_ref, count, example_title, example_url): categories that no configured list covers.

    items: school, cat_ref, title, url, seq. configured and ignored: school, cat_ref.
    """
    return open_categories(listed_categories(items), configured, ignored)


def common_titles(titles: DataFrame, min_pages: int = COMMON_TITLE_MIN_PAGES) -> DataFrame:
    """(title, pages) of the titles on at least `min_pages` pages of (page, title)."""
    return titles.groupBy("title").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= min_pages)


def page_sample(titles: DataFrame, common: DataFrame) -> DataFrame:
    """(page, sample, only_common): a page's first title that isn't common, else its first. titles: page, title, pos."""
    marked = titles.join(common.select("title", F.lit(True).alias("c")), "title", "left").withColumn("c", F.coalesce("c", F.lit(False)))
    return marked.groupBy("page").agg(F.min_by("title", F.struct("c", "pos")).alias("sample"), F.bool_and("c").alias("only_common"))


def quality_profile(items: DataFrame, last_year: str) -> DataFrame:
    """One row of counts on (id, title, snippet, url, date); dates beyond `last_year` count as future."""
    return items.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("id")).alias("duplicate_ids"),
        F.count_if(F.coalesce("title", F.lit("")) == "").alias("empty_titles"),
        F.count_if(F.coalesce("snippet", F.lit("")) == "").alias("empty_snippets"),
        F.count_if(F.contains(F.coalesce("title", F.lit("")), F.lit("�"))).alias("replacement_chars"),
        F.count_if(~F.startswith(F.coalesce("url", F.lit("")), F.lit("http"))).alias("bad_urls"),
        F.count_if(F.left(F.coalesce("date", F.lit("")), F.lit(4)) > last_year).alias("future_dates"),
    )


def page_stats(evaluated: DataFrame) -> DataFrame:
    """(bucket, pages, articles) of evaluated pages (err, count): live, empty, 404 or other."""
    bucket = F.when(F.col("err") == "404", "404").when(F.coalesce("err", F.lit("")) != "", "other").when(F.col("count") > 0, "live").otherwise("empty")
    return evaluated.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("pages"), F.sum("count").alias("articles"))


def page_overlap(pairs: DataFrame) -> DataFrame:
    """(page, articles, exclusive) of (page, article): how many of a page's articles no other page has."""
    distinct = pairs.select("page", "article").distinct()
    alone = distinct.groupBy("article").agg(F.min("page").alias("page"), F.count("*").alias("n")).where("n = 1")
    return (
        distinct.groupBy("page").agg(F.count("*").alias("articles"))
        .join(alone.groupBy("page").agg(F.count("*").alias("exclusive")), "page", "left")
        .select("page", "articles", F.coalesce("exclusive", F.lit(0)).alias("exclusive"))
    )


def coverage_ratio(articles: DataFrame) -> DataFrame:
    """(school, covered, total, ratio) of (school, article, covered), and a row of all schools (school null)."""
    covered = F.count_distinct(F.when(F.col("covered"), F.struct("school", "article")))
    total = F.count_distinct(F.struct("school", "article"))
    return articles.rollup("school").agg(covered.alias("covered"), total.alias("total")).withColumn("ratio", F.col("covered") / F.col("total"))


def census_summary(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(school, recent, archive, stored, live): distinct ids of (school, id, tier) and of (school, id)."""

    def tier(name: str) -> Column:
        return F.count_distinct(F.when(F.col("tier") == name, F.col("id")))

    kept = stored.groupBy("school").agg(tier("recent").alias("recent"), tier("archive").alias("archive"), F.count_distinct("id").alias("stored"))
    seen = live.groupBy("school").agg(F.count_distinct("id").alias("live"))
    both = kept.join(seen, "school", "full")
    return both.select("school", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("recent", "archive", "stored", "live")])


def run_metrics(rows: DataFrame) -> DataFrame:
    """One row of counters over a run's rows (fetched, is_new, filled, repaired: booleans)."""
    return rows.agg(
        F.count_if("fetched").alias("fetched"), F.count_if(~F.col("fetched")).alias("skipped"), F.count("*").alias("collected"),
        F.count_if("is_new").alias("new"), F.count_if("filled").alias("filled"), F.count_if("repaired").alias("repaired"),
    )


def redundant_pages(pairs: DataFrame) -> DataFrame:
    """Pages none of whose articles is theirs alone."""
    return page_overlap(pairs).where("exclusive = 0").select("page")


def _cover_turn(held: DataFrame, least: int) -> DataFrame:
    """(page, gain, article, win) of the pairs (page, article) whose page still has `least` articles: whether it beats every
    page it shares one with.
    """
    counted = held.select("page", "article", F.count("*").over(W.partitionBy("page")).alias("gain")).where(F.col("gain") >= least)
    rank = F.struct((-F.col("gain")).alias("g"), F.col("page").alias("p"))
    best = counted.withColumn("best", F.min(rank).over(W.partitionBy("article"))["p"] == F.col("page"))
    return best.select("page", "gain", "article", F.min("best").over(W.partitionBy("page")).alias("win"))


def cover_pages(pairs: DataFrame) -> DataFrame:
    """(page, turn, gain): pages of (page, article) that together have all articles, as a greedy walk chooses them.

    The walk takes again and again the page with most articles that no page before it has, of equal gain the smaller
    page. A page whose gain beats that of every page it shares an open article with is taken whatever happens elsewhere,
    so each turn takes all such pages at once: the same pages with the same gains, in few turns. Ordered by gain downwards,
    then page, they are the walk's order. Pages of small gain can't beat those of large gain: turns look at the pairs of pages
    with COVER_SHARE of the largest gain only, until none has that much; then covered articles leave the table, and the next
    largest gain is sought. Pairs without a page or an article are left out.
    """
    spark, root = pairs.sparkSession, work_dir(pairs.sparkSession, "cover")
    column = {f.name: f.dataType.simpleString() for f in pairs.schema}
    pair = f"page {column['page']}, article {column['article']}"
    pairs.select("page", "article").dropna().distinct().write.parquet(f"{root}/open-0")
    open_, phase, turn = spark.read.schema(pair).parquet(f"{root}/open-0"), 0, 0
    told = lambda path: spark.read.schema(f"{pair}, gain LONG, turn INT, win BOOLEAN").parquet(path)
    while True:
        gains = open_.groupBy("page").agg(F.count("*").alias("gain"))
        top = gains.agg(F.max("gain")).first()[0]
        if top is None:
            break
        least = ceil(top * COVER_SHARE)
        held, last = open_.join(gains.where(F.col("gain") >= least).select("page"), "page", "left_semi"), None
        while True:
            path = f"{root}/told/phase={phase}/turn={turn}"
            _cover_turn(held, least).write.partitionBy("win").parquet(path)
            if last:
                delete(spark, f"{last}/win=false")
            now, last, turn = told(path), path, turn + 1
            held = now.where("NOT win").join(now.where("win").select("article"), "article", "left_anti")
            if now.where("NOT win").isEmpty():
                break
        # only pairs of pages that were taken are left there: each covered article once
        open_.join(told(f"{root}/told/phase={phase}").select("article"), "article", "left_anti").write.parquet(f"{root}/open-{phase + 1}")
        delete(spark, f"{root}/open-{phase}")
        phase += 1
        open_ = spark.read.schema(pair).parquet(f"{root}/open-{phase}")
    if not turn:
        return pairs.select("page", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("gain")).limit(0)
    return told(f"{root}/told").groupBy("page").agg(F.any_value("turn").alias("turn"), F.any_value("gain").alias("gain"))


def first_by(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key: the first in `order`."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")
