"""Operator 4: drop lines that several documents share, with DataFrame functions only.

Normalised lines are exploded with their positions and hashed; per hash the distinct documents are counted
and the smallest doc_id is found. Lines of hashes that enough documents hold are dropped by position, but in
the document of the smallest doc_id, and the others put together again in order.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, join_apart, lower_ascii, saved, table

MIN_CHARS = 10
MIN_DOCUMENTS = 2
_BLANK = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id, which is larger than any other.
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.btrim(lower_ascii(line), F.lit(_BLANK))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(did, version, pos) of every line that a document loses; version tells rows of one doc_id apart by their text."""
    keys = F.transform(_lines(F.col("text")), line_key)
    # the outer form keeps Spark from filtering by the array's size, which would compute it twice
    held = docs.select(_did(), _version(), F.posexplode_outer(keys).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    held = saved(held.select("did", "version", "pos", _hash(F.col("key")).alias("h")), "lines")
    documents = held.select("h", "did").distinct()  # a hash that many hold is counted by many tasks
    spread = documents.groupBy("h").agg(F.min("did").alias("first"), F.count("*").alias("documents"))
    lines = held.groupBy("h").agg(F.count("*").alias("n"))
    spread = saved(spread.where(F.col("documents") >= min_documents).join(lines, "h").select("h", "first", "n"), "shared")
    total = spread.agg(F.sum("n")).first()[0] or 0
    return join_apart(held, spread, "h", total).where("did > first").select("did", "version", "pos")


def _did() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("did")


def _version() -> Column:
    return F.xxhash64("text").alias("version")


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """`docs` (doc_id, text, any others) with text without shared lines, plus n_lines and n_dropped.

    A line of at least `min_chars` code points that at least `min_documents` documents hold stays only in that
    of the smallest doc_id. A null text becomes one empty line. Empty and short lines stay. A text's length
    doesn't matter. Repeated rows of one doc_id are one document: they lose the same lines and none because of
    each other. Rows with a null doc_id count as one document after all others. Columns n_lines and n_dropped of
    `docs` are replaced, all others kept. An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    did, version, lost, lines = (free_name(n, docs.columns) for n in ("did", "version", "lost", "lines"))
    gone = shared_lines(docs, min_chars, min_documents).groupBy("did", "version").agg(F.collect_set("pos").alias(lost))
    gone = gone.withColumnsRenamed({"did": did, "version": version})
    joined = docs.withColumns({did: _did(), version: _version()}).join(gone, [did, version], "left")
    joined = joined.withColumn(lines, _lines(F.col("text")))
    positions = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    kept = F.array_join(F.transform(positions, lambda p: F.get(lines, p)), "\n")
    return joined.select(
        *others, F.when(F.col(lost).isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text"),
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_shared_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_line_dedup": query}
ORACLE_SQL = {
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
d AS (SELECT k.*, s.first IS NOT NULL AND k.doc_id > s.first AS dropped FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
}
