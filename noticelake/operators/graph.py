"""Hierarchies, link graphs and candidate sets."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import MAX_CATEGORY_ID
from ..functions.text import host
from ..sources.folders import work_dir


def hierarchy_path(rows: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """(key, path): the labels (outline, label) of each prefix of an outline code (key, outline, fallback), joined by ` > `."""
    parts = F.split("outline", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    each = rows.where(F.col("outline") != "").select(key, F.posexplode(prefixes).alias("pos", "outline"))
    named = each.join(labels.select("outline", "label"), "outline").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("p"))
    path = F.array_join(F.transform("p", lambda x: x["label"]), " > ")
    return rows.join(named, key, "left").select(key, F.coalesce(path, "fallback").alias("path"))


def same_site(url: Column, base: Column, suffix: str = "") -> Column:
    """Whether a url's host is the base's, and ends with the allowed suffix."""
    return F.coalesce((host(url) != "") & (host(url) == host(base)) & host(url).endswith(suffix), F.lit(False))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int, folder: str | None = None) -> DataFrame:
    """(node, depth): the nodes reached from the seeds (node) over edges (src, dst), with their least depth.

    One join a level; each frontier is checkpointed, so plans stay short and lost executors cost one level. Repeated
    edges stay: each level makes its nodes distinct, so no task keeps a table of edges.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder or work_dir(spark, "graph"))
    edges = edges.select("src", "dst")
    frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0)).checkpoint()
    visited = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def crawl(links: DataFrame, seeds: DataFrame, max_pages: int, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, bool]:
    """A breadth-first walk of at most `max_pages` pages: ((node, depth, place), (item, referrer), hit_limit).

    links: src, dst, pos (of a link in its page). seeds: node, pos. Pages are taken as a queue would: all of a depth
    before the next, by the place of the first page that links to them, then by that page's first link to them. place:
    from 0, in that order. found: page, item, pos: each item's first referrer is the first visited page that has it.
    hit_limit: whether the cap was reached, also when nothing was left. Self links and repeated links change nothing.

    A level is one join; its order comes from a global sort, whose partitions are numbered by their sizes, so no level is
    one task's work. Levels are checkpointed: a lost executor costs one.
    """
    spark = links.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_dir(spark, "graph"))
    links = links.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    ranked = seeds.groupBy("node").agg(F.struct(F.lit(0).cast("long").alias("place"), F.min("pos").cast("long").alias("pos")).alias("key"))
    level = _placed(ranked, 0, 0, max_pages)
    visited, depth, n = level, 0, level.count()
    while n < max_pages:
        depth += 1
        step = level.join(links, level["node"] == links["src"]).groupBy(F.col("dst").alias("node"))
        step = step.agg(F.min(F.struct("place", F.col("pos").cast("long").alias("pos"))).alias("key"))
        level = _placed(step.join(visited.select("node"), "node", "left_anti"), depth, n, max_pages)
        more = level.count()
        if not more:
            break
        visited, n = visited.unionByName(level), n + more
    if found is None:
        return visited, None, n >= max_pages
    held = found.join(visited.select(F.col("node").alias("page"), "place"), "page")
    return visited, held.groupBy("item").agg(F.min_by("page", "place").alias("referrer")), n >= max_pages


def _placed(rows: DataFrame, depth: int, first: int, max_pages: int) -> DataFrame:
    """(node, depth, place), checkpointed: `rows` (node, key) numbered from `first` in order of key, up to `max_pages`."""
    ordered = rows.orderBy("key", "node").select("node", F.monotonically_increasing_id().alias("at")).checkpoint()
    part = F.shiftright("at", 33)  # the number of the sorted partition; below it the row's number in it
    sizes = ordered.groupBy(part.alias("part")).count().collect()  # a row a partition
    before, total = [], first
    for row in sorted(sizes, key=lambda r: r["part"]):
        before += [F.lit(row["part"]), F.lit(total)]
        total += row["count"]
    start = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    inside = F.col("at") - F.shiftleft(part, 33)
    return ordered.select("node", F.lit(depth).alias("depth"), (start + inside).cast("long").alias("place")).where(F.col("place") < max_pages)


def census_diff(live: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, side): ids that only one side has, and those of both."""
    sides = live.select("id").distinct().withColumn("s", F.lit(1)).union(stored.select("id").distinct().withColumn("s", F.lit(2)))
    total = sides.groupBy("id").agg(F.sum("s").alias("s"))
    return total.select("id", F.when(F.col("s") == 1, "live only").when(F.col("s") == 2, "stored only").otherwise("both").alias("side"))


def union_discovered(links: DataFrame, tabs: DataFrame) -> DataFrame:
    return links.select("category").union(tabs.select("category")).distinct()


def sweep_candidates(spark: SparkSession, discovered: DataFrame, last: int = MAX_CATEGORY_ID) -> DataFrame:
    """(category, place): discovered categories in numeric order, then all others from 1 to `last`."""
    known = discovered.select(F.col("category").cast("long").alias("category")).distinct()
    others = spark.range(1, last + 1).select(F.col("id").alias("category")).join(known, "category", "left_anti")
    both = known.withColumn("late", F.lit(0)).unionByName(others.withColumn("late", F.lit(1)))
    return both.select("category", F.struct("late", "category").alias("place"))


def probe_candidates(ranges: DataFrame, configured: DataFrame) -> DataFrame:
    """(school, category) of fixed ranges (school, first, last) and of the configured lists, once each."""
    probed = ranges.select("school", F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long"))).alias("category"))
    return probed.union(configured.select("school", F.col("category").cast("long"))).distinct()
