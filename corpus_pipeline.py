"""A corpus pipeline of five stages, from raw documents to packed sequences.

`run` writes each stage's result as Parquet into the shared folder and reads it back as the next one's
documents. All stages but the last return the columns of `documents`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import decontaminate, langid, line_dedup, packing, simhash
from noticelake.llm.common import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those of no clear language.

    Repeated rows are judged alike; a tie of languages is no matter, as only the probability counts.
    """
    return langid.reject(docs, langid.train(langid.learnable(docs))).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document of a smaller doc_id holds; n_chars follows, and no document goes."""
    kept = line_dedup.drop_shared_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document of the smallest doc_id.

    Documents without a word, which line dedup may leave, are one group. A null doc_id stays only if its whole
    group has no other; repeated rows of a doc_id that stays all do.
    """
    found = simhash.near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = found.select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stays"]), "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of `benchmark`, all rows of such a doc_id; see decontaminate.contaminated."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences: one row a piece, as op10; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]
#: Trained and packed stages have no SQL. Tests hold the operators against brute-force versions, and the whole run by its sums and edge rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
