"""Readers (S1-S9). An unreadable document is an empty table where a default exists, never an inferred one."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import empty_as_null, parse_timestamp


def _json(spark: SparkSession, path: str, schema, optional: bool = True) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if optional and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page corpus; pages without a body are left out."""
    return spark.read.schema(schemas.PAGES).parquet(path).where("html IS NOT NULL")


def read_page_files(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """One row a file: url (its path) and html, bytes that are no UTF-8 replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Page drops (Parquet files that arrive in a folder) as a stream."""
    return spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_snapshot(spark: SparkSession, recent_path: str, archive_path: str) -> DataFrame:
    """Announcements of both snapshots, empty strings as nulls; of one id the recent row wins."""
    parts = []
    for prio, path in enumerate((recent_path, archive_path)):
        items = _json(spark, path, schemas.SNAPSHOT).select(F.posexplode("items").alias("pos", "item"))
        parts.append(items.select("item.*", F.lit(prio).alias("prio"), "pos"))
    rows = parts[0].unionByName(parts[1]).where(empty_as_null(F.col("id")).isNotNull())
    best = rows.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("prio", F.desc("pos")))).where("n = 1")
    best = best.drop("prio", "pos", "n")
    return best.select(*[empty_as_null(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in best.dtypes])


def sources_from_config(config: DataFrame) -> DataFrame:
    """(school, url, tier, rank) from rows (school, scan_pages array<string>, list_pages: JSON array of strings or
    {url, tier} objects). Scan pages come first and are hot; a missing tier is cold.
    """
    listed = config.select("school", F.size("scan_pages").alias("scans"), F.posexplode(F.from_json("list_pages", "array<string>")).alias("pos", "entry"))
    scans = config.select("school", F.posexplode("scan_pages").alias("rank", "url")).select("school", "url", F.lit("hot").alias("tier"), "rank")
    url = F.coalesce(F.get_json_object("entry", "$.url"), F.col("entry"))
    tier = F.coalesce(F.get_json_object("entry", "$.tier"), F.lit("cold"))
    pages = listed.select("school", url.alias("url"), tier.alias("tier"), (F.greatest("scans", F.lit(0)) + F.col("pos")).alias("rank"))
    return scans.unionByName(pages)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """`sources_from_config` of a JSON document {schools: [{id, scan_pages, list_pages}]}."""
    schema = "schools array<struct<id: string, scan_pages: array<string>, list_pages: variant>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("schools").alias("s"))
    return sources_from_config(raw.select(F.col("s.id").alias("school"), "s.scan_pages", F.to_json("s.list_pages").alias("list_pages")))


def read_ignored(spark: SparkSession, path: str) -> DataFrame:
    """(school, cat_ref) that coverage leaves out, from a JSON document {coverage_ignore: {school: [cat_ref, ...]}}."""
    listed = _json(spark, path, "coverage_ignore MAP<STRING, ARRAY<STRING>>").select(F.explode("coverage_ignore").alias("school", "refs"))
    return listed.select("school", F.explode("refs").alias("cat_ref")).distinct()


def fetch_state(documents: DataFrame) -> DataFrame:
    """(url, fetched_at) from rows with a JSON map in `value`; a bad document is an empty map, a bad time a null."""
    entries = documents.select(F.explode(F.from_json("value", "map<string,string>")).alias("url", "t"))
    return entries.select("url", parse_timestamp(F.col("t")).alias("fetched_at"))


def read_fetch_state(spark: SparkSession, path: str) -> DataFrame:
    try:
        return fetch_state(spark.read.option("wholetext", True).text(path))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "url string, fetched_at timestamp")
        raise


def read_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.SUBSCRIPTION_GROUPS)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Curated events with a date and a title."""
    rows = _json(spark, path, schemas.EVENTS)
    return rows.where((F.col("date") != "") & (F.col("title") != ""))


def read_official_events(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, "id STRING, date STRING, endDate STRING, school STRING, title STRING, kind STRING, provenance STRING, sourceLabel STRING")
    return rows.where((F.col("date") != "") & (F.col("title") != "") & (F.col("provenance") != ""))


def read_user_state(spark: SparkSession, folder: str, user_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subscriptions, reads and preferences of one owner, or of all; a missing table fails the whole read."""
    tables = (("user_subscriptions", schemas.USER_SUBSCRIPTIONS), ("user_reads", schemas.USER_READS), ("user_preferences", schemas.USER_PREFERENCES))
    whose = F.lit(True) if user_id is None else F.col("user_id") == user_id
    return tuple(spark.read.schema(s).parquet(f"{folder}/{t}").where(whose) for t, s in tables)


def read_stored_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a Parquet snapshot; only that column is read."""
    return spark.read.parquet(path).select("id").distinct()
