"""Sinks (K1-K8): versioned tables behind checks, and deterministic exports."""

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, quality


#: A writer that finds that another has published merges anew, so often at most.
MAX_TRIES = 20


class VersionConflict(RuntimeError):
    """Another writer has published since the version that this one's rows are based on."""


def _pointers(spark: SparkSession, folder: str):
    """The JVM's file context of `folder`, and the folder of its pointers: one small file a version."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    where = fs.Path(f"{folder}/_pointer")
    return fs.FileContext.getFileContext(where.getFileSystem(conf).getUri(), conf), where


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The path that the newest pointer of a versioned table names, or null before its first write."""
    files, where = _pointers(spark, folder)
    if not files.util().exists(where):
        return None
    names = [f.getPath().getName() for f in files.util().listStatus(where)]
    newest = max((n for n in names if n.startswith("v")), default=None)
    return f"{folder}/{spark.read.text(f'{folder}/_pointer/{newest}').first()['value']}" if newest else None


def _number(path: str | None) -> int:
    return int(path.rsplit("/v", 1)[1].split("-")[0]) if path else 0


def _publish(spark: SparkSession, folder: str, name: str, version: int) -> bool:
    """Make `name` the table's version of that number, unless there is one.

    The pointer is written apart and renamed to its number, which fails where that exists. A rename is one step on HDFS
    and stores that keep its contract; a local disk, for tests, checks and renames in two.
    """
    from py4j.protocol import Py4JJavaError

    files, where = _pointers(spark, folder)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    draft = fs.Path(where, f"_draft-{name}")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(draft, False)
    out.write(bytearray(name.encode()))
    out.close()
    try:
        files.rename(draft, fs.Path(where, f"v{version:012d}"), spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        files.delete(draft, False)
        return False
    return True


def _next_version(spark: SparkSession, folder: str, make: Callable[[str | None], DataFrame], partition_by: Sequence[str] = (), check: Callable[[DataFrame], None] | None = None) -> str:
    """Write what `make` gives for the path of the current version (null: none) beside the older versions, check what was
    written, then publish it: readers see the old or the new table, never a mix. A version that fails its check stays unseen.
    If another writer has published in between, nothing is: `make` is asked again, with that writer's version.
    """
    for _ in range(MAX_TRIES):
        old = current_version(spark, folder)
        df, version = make(old), _number(old) + 1
        name = f"v{version}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{folder}/{name}")
        if check:
            check(spark.read.schema(df.schema).parquet(f"{folder}/{name}"))
        if _publish(spark, folder, name, version):
            return f"{folder}/{name}"
    raise VersionConflict(f"{folder}: others published {MAX_TRIES} times in between")


def write_snapshot(items: DataFrame, folder: str, cutoff: str, max_items: int = quality.MAX_ITEMS, based_on: str | None = None) -> str:
    """Announcements by tier (recent, archive), published only after what was written has passed all checks.

    `based_on`: the version that `items` was made from. If another is current by then, VersionConflict is raised and
    nothing is published. Without it, the items replace whatever is there.
    """

    def tiers(old: str | None) -> DataFrame:
        if based_on and based_on != old:
            raise VersionConflict(f"{folder}: {old} is current, not {based_on}")
        return merge.split_recent(items, cutoff)

    def check(written: DataFrame) -> None:
        quality.require_keys(written, "snapshot")
        quality.require_capacity(written, max_items)
        quality.require_lossless(items, written)

    return _next_version(items.sparkSession, folder, tiers, ["tier"], check)


def write_new_items(items: DataFrame, path: str) -> None:
    items.orderBy(F.desc("date"), "id").write.mode("overwrite").json(path)


def write_coverage_gaps(gaps: DataFrame, path: str) -> None:
    """No time column and a total order: an unchanged result gives the same bytes, file after file in order of names."""
    gaps.orderBy(F.desc("count"), "cat_ref", "school").write.mode("overwrite").json(path)


def write_fetch_state(old: DataFrame, fetched: DataFrame, folder: str) -> str:
    """Only urls fetched in this run move on; from `old`, or from what another writer has published meanwhile."""
    spark, known = fetched.sparkSession, current_version(fetched.sparkSession, folder)
    return _next_version(spark, folder, lambda now: merge.upsert_by_key(old if now == known else spark.read.schema(old.schema).parquet(now), fetched, ["url"]))


def write_calendar_feed(feed: DataFrame, path: str) -> None:
    """In order, in as many files as the sort has partitions: their names follow the order, and no task holds the whole feed."""
    feed.orderBy("date", "uid").write.mode("overwrite").json(path)


def write_audit_report(report: DataFrame, path: str, order: Sequence[str]) -> None:
    report.orderBy(*order).write.mode("overwrite").json(path)


def append_deliveries(deliveries: DataFrame, path: str) -> None:
    """Messages (topic, title, body, click) for the push service to take."""
    deliveries.select("topic", "title", "body", "click").write.mode("append").parquet(path)


def upsert_user_rows(rows: DataFrame, folder: str, keys: Sequence[str], owner: str | Column) -> str:
    """Insert or replace by key under the verified owner (one for all, or a column), whatever user_id the rows carry; a
    server id is dropped. Rows that another writer publishes meanwhile stay.
    """
    spark = rows.sparkSession
    owned = rows.drop("id").withColumn("user_id", F.lit(owner) if isinstance(owner, str) else owner)

    def merged(now: str | None) -> DataFrame:
        return merge.upsert_by_key(spark.read.parquet(now) if now else spark.createDataFrame([], owned.schema), owned, keys)

    return _next_version(spark, folder, merged)
