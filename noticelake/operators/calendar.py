"""Calendar events: projections, month grids, feeds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import feed_escape, month_grid_start


def events_on(events: DataFrame, day: Column) -> DataFrame:
    return events.where(F.col("date").cast("string") == day.cast("string"))


def daily_events(events: DataFrame, now: Column, zone: str = "Asia/Taipei") -> DataFrame:
    """The events of the day that it is now in a time zone."""
    return events_on(events, F.to_date(F.from_utc_timestamp(now, zone)))


def valid_user_events(rows: DataFrame) -> DataFrame:
    """User events (id, title, date, notes) with a title and a date like 2024-01-31, trimmed; a missing id is made from them."""
    title = F.trim("title")
    fine = rows.where((title != "") & F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    made = F.concat(F.lit("user:"), F.md5(F.concat_ws("|", "date", title)))
    return fine.select(F.coalesce(F.when(F.trim("id") != "", F.col("id")), made).alias("id"), title.alias("title"), "date", F.trim(F.coalesce("notes", F.lit(""))).alias("notes"))


def public_events(events: DataFrame, provenance: str = "curated", label: str = "School calendar") -> DataFrame:
    """Public rows of curated events (date, end_date, school, title)."""
    date = F.col("date").cast("string")
    return events.select(
        F.concat_ws(":", F.lit("school"), F.coalesce("school", F.lit("")), date, "title").alias("id"), date.alias("date"),
        F.coalesce(F.col("end_date").cast("string"), date).alias("endDate"), "school", "title",
        F.lit("school").alias("kind"), F.lit(provenance).alias("provenance"), F.lit(label).alias("sourceLabel"),
    )


def feed_rows(events: DataFrame) -> DataFrame:
    """Feed rows of events (date, school, title): uid and stamp follow from the event alone, so output is reproducible."""
    school = F.coalesce("school", F.lit(""))
    summary = F.when(school != "", F.concat(F.lit("["), school, F.lit("] "), "title")).otherwise(F.col("title"))
    day = F.to_date(F.col("date").cast("string"))
    compact = F.date_format(day, "yyyyMMdd")
    digest = F.left(F.md5(F.concat(F.col("date").cast("string"), F.lit("|"), summary).cast("binary")), F.lit(12))
    return events.select(
        F.col("date").cast("string").alias("date"), F.concat(compact, F.lit("-"), digest).alias("uid"), F.concat(compact, F.lit("T000000Z")).alias("dtstamp"),
        compact.alias("dtstart"), F.date_format(F.date_add(day, 1), "yyyyMMdd").alias("dtend"), feed_escape(summary).alias("summary"),
    )


def item_events(items: DataFrame) -> DataFrame:
    """(id, date, end_date, title, kind, provenance) of the events nested in items (id, calendar_events) that have date, title and provenance."""
    each = items.select("id", F.explode("calendar_events").alias("e")).select("id", "e.*")
    fine = each.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.trim("title") != "") & (F.trim("provenance") != ""))
    return fine.withColumn("kind", F.when(F.col("kind") == "deadline", "deadline").otherwise("announcement"))


def union_events(*parts: DataFrame) -> DataFrame:
    """All parts by column name; missing columns are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def calendar_month(days: DataFrame, events: DataFrame, month: Column) -> DataFrame:
    """(day, outside, n, kinds): the 42 days from the Sunday on or before the first of `month`, with the day's events (date, kind).

    `days` is any one-row table. kinds: the first four, in order.
    """
    start = month_grid_start(month)
    grid = days.select(F.explode(F.sequence(start, F.date_add(start, 41))).alias("day"))
    per_day = events.select(F.to_date("date").alias("day"), "kind").where((F.col("day") >= start) & (F.col("day") <= F.date_add(start, 41)))
    counted = per_day.groupBy("day").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("kind")), 1, 4).alias("kinds"))
    joined = grid.join(counted, "day", "left")
    return joined.select(
        "day", (F.month("day") != F.month(month)).alias("outside"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds")
    )
