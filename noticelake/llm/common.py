"""Helpers shared by the operators: tables, the shared work folder, the hold-out split."""

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import work_dir

#: See `join_apart`.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """`df` written to the shared folder and read back, and its path: lineage ends, and nothing is computed twice."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """As `stored`, for tables that lazy results still read: they stay until the shared folder is cleared."""
    return stored(df, name, partition_by)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_apart(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of `rows`, a stored table, with `values` (key, n, others): one row a key, which n of the rows have.

    Keys that more than one in HOT_KEYS of the `total` rows have, fewer than HOT_KEYS, are broadcast; a frequent
    key is then no single task's work. All others meet by the key.
    """
    hot = F.broadcast(values.where(F.col("n") * HOT_KEYS > total).drop("n"))
    cold = values.where(F.col("n") * HOT_KEYS <= total).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def join_salted(rows: DataFrame, values: DataFrame, key: str, counted: DataFrame, total: int) -> DataFrame:
    """Inner join of `rows` with `values`, of one wide row a key, both shuffled.

    `counted`: a stored table of the keys of `rows` (`total` of them) and other columns of them that tell rows apart. A
    key of more than one in HOT_KEYS of the rows, of which there are fewer than HOT_KEYS, is dealt to so many parts that
    each holds about that share, and its one value goes to each of them.
    """
    hot = counted.groupBy(key).count().where((F.col("count") * HOT_KEYS > total) & (F.col("count") > 1))
    hot = F.broadcast(hot.select(key, F.ceil(F.col("count") * HOT_KEYS / F.lit(max(1, total))).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*counted.columns), parts).cast("int")).drop("__parts")
    right = values.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def free_name(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores before it until no column of `taken` has it, in upper or lower case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the fourth of the documents that no classifier learns from; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def drawn(rows: DataFrame, n: Column, wanted: int) -> DataFrame:
    """About twice `wanted` rows (all, if there are no more) of the `n` that a row is one of, by a hash of the whole row.

    A filter, so what is drawn is all that later steps shuffle. Equal rows are drawn together.
    """
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(share * n < 2.0 * wanted)
