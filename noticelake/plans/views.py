"""Tables and views that several registered queries share, as DataFrames and as SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import classify

#: Keyword rules over the invented words of the test tables, in order.
RULES = (
    ("exam", ("queaux", "ungen", "thedst")),
    ("club", ("ationon", "enlich", "adora")),
    ("contest", ("heaere", "eaument", "boas")),
    ("event", ("wh", "zeit", "ciónz")),
)
DEFAULT = "general"
TOKENS = ("on", "er")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as announcements: the first line is the title, German ones have no date."""
    docs = table(spark, sf_dir, "documents")
    seen = F.timestamp_add("HOUR", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    rows = docs.select(
        F.concat_ws("-", "source", "doc_id").alias("id"), "doc_id", F.col("source").alias("school"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("snippet"), F.col("lang").alias("source_category"), seen.alias("first_seen"),
    )
    date = F.when(F.col("source_category") != "de", F.date_format("first_seen", "yyyy-MM-dd"))
    words = rows.withColumns({"date": date, "words": F.concat_ws(" ", "snippet", "source_category")})
    return words.withColumn("category", classify(F.col("words"), RULES, DEFAULT)).drop("words")


def case_sql(text: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains({text}, {k!r})' for k in keys)} THEN {c!r}" for c, keys in RULES)
    return f"CASE {whens} ELSE {DEFAULT!r} END"


ANN = f"""ann AS (
  SELECT source || '-' || doc_id AS id, doc_id, source AS school, split_part(text, chr(10), 1) AS title, text AS snippet,
         lang AS source_category, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS first_seen,
         CASE WHEN lang <> 'de' THEN strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id), '%Y-%m-%d') END AS date,
         {case_sql("text || ' ' || lang")} AS category
  FROM documents)"""

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACES}', ' ', 'g'))"


def unescape_sql(text: str) -> str:
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{raw}')"
    return text


def strip_sql(html: str) -> str:
    bare = f"regexp_replace({html}, '<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'gis')"
    return clean_sql(unescape_sql(f"regexp_replace({bare}, '<[^>]*>', ' ', 'g')"))
