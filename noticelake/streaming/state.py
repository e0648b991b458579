"""State of a stream that lives across batches: a log of the keys that each batch touched, with compaction.

A batch reads what earlier batches left, and writes only the keys it touched, all their rows anew. A batch that runs again
replaces what it wrote. `compact` folds the log into one base; readers see the same rows before, during and after it.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import delete


class KeyedState:
    """Rows of `schema` in `folder`, any number a key; keys are dealt to `buckets` folders, so a batch reads those it needs."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 16) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self.schema, self.names = f"{schema}, __gone BOOLEAN, __batch LONG, __bucket INT", [f.split()[0].strip("`") for f in schema.split(", ")]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def _log(self, before: int) -> DataFrame:
        """The newest base and what came after it."""
        base = self._table("base").where(F.col("__batch") < before)
        newest = base.agg(F.max("__batch")).first()[0]  # a column of folder names
        if newest is None:
            return self._table("log").where(F.col("__batch") < before)
        later = self._table("log").where((F.col("__batch") > newest) & (F.col("__batch") < before))
        return base.where(F.col("__batch") == newest).unionByName(later)

    def _latest(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy(self.key).agg(F.max("__batch").alias("__batch"))
        return rows.join(last, [self.key, "__batch"])

    def read(self, before: int, keys: DataFrame | None = None) -> DataFrame:
        """Rows that the batches before this one left; only those of `keys` (one column, distinct), if given."""
        rows = self._log(before)
        if keys is not None:
            used = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # as many as buckets at most
            rows = rows.where(F.col("__bucket").isin(used)).join(keys, self.key, "left_semi")
        return self._latest(rows).where(~F.col("__gone")).select(*self.names)

    def write(self, batch: int, rows: DataFrame, keys: DataFrame) -> None:
        """All rows of the touched `keys` (one column, distinct); keys without rows have none from now on."""
        left = keys.join(rows.select(self.key).distinct(), self.key, "left_anti").withColumn("__gone", F.lit(True))
        all_ = rows.select(*self.names).withColumn("__gone", F.lit(False)).unionByName(left, allowMissingColumns=True)
        all_.withColumn("__bucket", self._bucket()).hint("rebalance", F.col("__bucket")).write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.folder}/log/__batch={batch}")

    def compact(self, through: int) -> None:
        """Fold all batches up to `through` into one base, then delete them; to be called while no batch runs."""
        rows = self._latest(self._log(through + 1)).where(~F.col("__gone"))
        rows.drop("__batch").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.folder}/base/__batch={through}")
        for name, at_most in (("log", through), ("base", through - 1)):
            old = self._table(name).where(F.col("__batch") <= at_most).select("__batch").distinct().collect()  # folder names
            for row in old:
                delete(self.spark, f"{self.folder}/{name}/__batch={row[0]}")
