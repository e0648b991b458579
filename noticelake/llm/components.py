"""Connected components of a link table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_apart, stored


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_apart(both, least, "a", 2 * n).where("b > a").select(F.least("a", "m").alias("a"), "b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hang = join_apart(down, least, "u", n).where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return hang.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long), root being the smallest node reachable.

    Each round is two aggregations and two joins over the links, of which a node with many is no single task's
    work, and ends in a written table that replaces the one before; the number of rounds grows with the logarithm
    of the longest path. Self links are ignored, repeated links count once, and an empty table gives an empty
    result.
    """
    spark = edges.sparkSession
    edges, path = stored(edges.where("a <> b").select("a", "b").distinct(), "links")
    n, state = edges.count(), None
    for _ in range(max_rounds):
        for star in (_large_star, _small_star):
            before = path
            edges, path = stored(star(edges, n).where("a <> b").distinct(), "links")
            discard(spark, before)
            now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            n = now[0]
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
