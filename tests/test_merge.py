import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from noticelake.operators import calendar, merge, notify, quality, routing
from noticelake.plans import routing_queries
from noticelake.sources import readers, writers
from noticelake.streaming import runs

from .oracle import DATA

SUBS = "user_id string, keyword string, normalized_keyword string, created_at string, updated_at string, deleted_at string"


def test_lww_is_commutative_and_idempotent(spark):
    rows = [("u", "a", None, None, t, d) for t, d in itertools.product(["2024-01-01T00:00:00Z", "2024-01-01T08:00:00+08:00", "junk", None], [None, "2024-01-01T00:00:00Z"])]
    results = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, SUBS).repartition(1 + 3 * seed)
        once = merge.merge_subscriptions(df)
        again = merge.merge_subscriptions(once.unionByName(once))
        assert once.collect() == again.collect()
        results.add(tuple(once.collect()))
    (only,) = results
    assert only[0]["deleted_at"] is not None and only[0]["updated_at"] != "junk"


def test_collect_takes_the_best_source_and_date(spark):
    sources = spark.createDataFrame([("http://x/p/403-1-9-1.php", 0)], "url string, rank int")
    rows = [("a", "http://x/p/403-1-2-1.php", "2024-01-02", "publication", 1), ("a", "http://x/p/403-1-9-1.php?q=1", None, None, 2), ("a", "http://x/p/403-1-3-1.php", "2024-01-03", "list", 3), ("b", None, None, None, 4)]
    items = spark.createDataFrame(rows, "id string, source_url string, date string, date_source string, seq long")
    found = {r["id"]: r for r in merge.collect(items, sources).collect()}
    assert found["a"]["seq"] == 2 and found["a"]["date"] == "2024-01-02" and found["b"]["date"] is None
    for n in (1, 7):
        assert {r["id"]: r for r in merge.collect(items.repartition(n), sources).collect()} == found


def test_titles_and_details(spark):
    def title(old, new, authoritative):
        return spark.range(1).select(merge.merged_title(F.lit(old), F.lit(new), authoritative).alias("t")).first()["t"]

    assert title("clean", "other", False) == "clean" and title("clean", "other", True) == "other"
    assert title("clean", "bad�", True) == "clean" and title("bad�", "clean", False) == "bad�"
    assert title("", "new", False) == "new" and title("old", "", True) == "old"
    items = spark.createDataFrame([("u", "t", None, None, None, False, False), ("v", "t", None, None, None, False, False)], "url string, title string, snippet string, date string, date_source string, snippet_tried boolean, date_tried boolean")
    details = spark.createDataFrame([("u", "T", "", "2024-01-01", "publication")], "url string, title string, snippet string, date string, date_source string")
    r = {x["url"]: x for x in merge.apply_detail(items, details).collect()}
    assert (r["u"]["title"], r["u"]["date"], r["u"]["snippet_tried"], r["u"]["date_tried"]) == ("T", "2024-01-01", True, False)
    assert not r["v"]["snippet_tried"] and r["v"]["title"] == "t"


def test_pagination(spark):
    pages = [("e", 1, ["a"], []), ("e", 2, [], []), ("r", 1, ["a", "b"], []), ("r", 2, ["b"], []), ("c", 1, ["a"], ["2020-01-01", ""]), ("n", 1, ["a"], [""])]
    df = spark.createDataFrame(pages, "category string, page_no int, ids array<string>, dates array<string>")
    assert {tuple(r) for r in merge.pagination_stop(df, "2021-01-01").collect()} == {("e", 2, "empty"), ("r", 2, "repeated"), ("c", 1, "before cutoff")}
    again = spark.createDataFrame([("a", 1, ["x"], []), ("a", 2, ["y"], []), ("a", 3, ["x"], []), ("b", 1, ["x"], []), ("b", 2, ["x"], [])], df.schema)
    assert {tuple(r) for r in merge.pagination_stop_previous(again).collect()} == {("b", 2, "repeated")}


def test_outbox_and_owner(spark):
    rows = spark.createDataFrame([("a", 1, "m1", False), ("a", 2, "m2", True), ("a", 3, "m3", False)], "account_id string, seq long, id string, failed boolean")
    assert [r["seq"] for r in merge.outbox_prefix(rows).collect()] == [1]
    assert merge.require_owner(rows, "a").count() == 3
    with pytest.raises(Exception, match="another owner"):
        merge.require_owner(rows, "b").collect()


def test_every_account_drains(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", "event_type").collect()
    failed = {}
    for e in events:
        if e["event_type"] == "error":
            failed[e["user_id"]] = min(e["event_id"], failed.get(e["user_id"], e["event_id"]))
    wanted = sorted((str(e["user_id"]), e["event_id"]) for e in events if e["event_id"] < failed.get(e["user_id"], e["event_id"] + 1))
    got = sorted((r["account_id"], r["seq"]) for r in routing_queries.stream_outbox(spark, DATA).collect())
    assert got == wanted and len({a for a, _ in got}) > 1


def test_checks_fail_closed(spark, tmp_path):
    items = spark.createDataFrame([("a", "t", "2024-01-01", None), ("b", "t", None, None)], "id string, title string, date string, first_seen string")
    folder = f"file://{tmp_path}/snap"
    first = writers.write_snapshot(items, folder, "2024-01-01")
    assert {r["id"]: r["tier"] for r in spark.read.parquet(first).collect()} == {"a": "recent", "b": "archive"}
    for bad in (items.union(items), items.limit(0), items.withColumn("title", F.lit("�"))):
        with pytest.raises(ValueError):
            writers.write_snapshot(bad, folder, "2024-01-01")
    with pytest.raises(ValueError):
        writers.write_snapshot(items, folder, "2024-01-01", max_items=1)
    assert writers.current_version(spark, folder) == first
    assert writers.write_snapshot(items, folder, "2024-01-01") != first
    assert not quality.lost_ids(items, items.limit(1)).isEmpty()


def test_user_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/reads"
    rows = spark.createDataFrame([("srv", "evil", "n1", "2024")], "id string, user_id string, announcement_id string, read_at string")
    writers.upsert_user_rows(rows, folder, ["user_id", "announcement_id"], "me")
    path = writers.upsert_user_rows(rows.withColumn("read_at", F.lit("2025")), folder, ["user_id", "announcement_id"], "me")
    assert [tuple(r) for r in spark.read.parquet(path).select("user_id", "announcement_id", "read_at").collect()] == [("me", "n1", "2025")]


def test_readers(spark, tmp_path):
    (tmp_path / "recent.json").write_text(json.dumps({"items": [{"id": "a", "title": "new", "date": ""}]}))
    (tmp_path / "archive.json").write_text(json.dumps({"items": [{"id": "a", "title": "old"}, {"id": "b", "title": "kept"}]}))
    found = {r["id"]: r for r in readers.read_snapshot(spark, f"{tmp_path}/recent.json", f"{tmp_path}/archive.json").collect()}
    assert found["a"]["title"] == "new" and found["a"]["date"] is None and found["b"]["title"] == "kept"
    assert readers.read_snapshot(spark, f"{tmp_path}/none.json", f"{tmp_path}/none2.json").count() == 0
    (tmp_path / "config.json").write_text(json.dumps({"schools": [{"id": "s", "scan_pages": ["u0"], "list_pages": ["u1", {"url": "u2", "tier": "hot"}, {"url": "u3"}]}]}))
    assert [tuple(r) for r in readers.read_sources(spark, f"{tmp_path}/config.json").orderBy("rank").collect()] == [("s", "u0", "hot", 0), ("s", "u1", "cold", 1), ("s", "u2", "hot", 2), ("s", "u3", "cold", 3)]
    (tmp_path / "state.json").write_text('{"u1": "2024-01-01T00:00:00+08:00", "u2": "junk"}')
    assert {r["url"]: r["fetched_at"] is None for r in readers.read_fetch_state(spark, f"{tmp_path}/state.json").collect()} == {"u1": False, "u2": True}
    (tmp_path / "p.html").write_bytes(b"<title>x\xff</title>")
    assert readers.read_page_files(spark, str(tmp_path)).count() == 1


def _state(spark, rows):
    return spark.createDataFrame(rows, "subscriber string, notified_ids array<string>, notified_through string").withColumn("notified_through", F.to_timestamp("notified_through"))


def _items(spark, rows):
    return spark.createDataFrame(rows, "id string, first_seen string, text string").withColumn("first_seen", F.to_timestamp("first_seen"))


def test_notifications(spark):
    subs = spark.createDataFrame([("s", "exam", "2024-01-01"), ("s", "EX", "2024-01-01")], "subscriber string, keyword string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    items = _items(spark, [("a", "2024-01-01", "exam"), ("b", "2024-01-02", "Exam"), ("c", "2024-01-03", "exam"), ("d", None, "exam"), ("e", "2024-01-03", "club")])
    state = _state(spark, [("s", ["c"], None)])
    found = notify.notify_candidates(items, subs, state)
    assert [r["id"] for r in found.collect()] == ["b"]  # two keywords give one row; equal times are late
    after = notify.advance_watermark(state, found, keep=1).first()
    assert after["notified_ids"] == ["b"] and str(after["notified_through"]) == "2024-01-02 00:00:00"
    kept = _state(spark, [("s", after["notified_ids"], "2024-01-03")])
    assert notify.notify_candidates(items, subs, kept).count() == 0  # late for good, though the id was dropped
    docs = spark.createDataFrame([("x", '{"version":3,"notifiedIds":["a"],"notifiedThrough":"2024-01-01T00:00:00Z"}'), ("y", '["a","a"]'), ("z", "junk"), ("w", '{"version":3,"notifiedThrough":"?"}')], "subscriber string, value string")
    moved = {r["subscriber"]: r for r in notify.migrate_state(docs, F.to_timestamp(F.lit("2024-06-01"))).collect()}
    assert moved["x"]["notified_through"].month == 1 and moved["x"]["notified_ids"] == ["a"]
    assert moved["y"]["notified_ids"] == ["a"] and {moved[k]["notified_through"].month for k in "yzw"} == {6}


def test_streams(spark, tmp_path):
    items = _items(spark, [(f"i{n}", f"2024-01-{n + 2:02d}", "exam") for n in range(9)]).withColumn("data_source", F.lit("network"))
    subs = spark.createDataFrame([("s", "exam", "2024-01-01")], "subscriber string, keyword string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    for part in range(3):  # three drops, in order of time
        items.where((F.day("first_seen") >= 2 + 3 * part) & (F.day("first_seen") < 5 + 3 * part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in")
        runs.notify_stream(stream, subs, f"{tmp_path}/w", f"{tmp_path}/cp").awaitTermination()
        stream = spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in")
        runs.ingest(stream, f"{tmp_path}/t", f"{tmp_path}/cp2", lambda rows: rows.drop("data_source")).awaitTermination()
    batch = notify.notify_candidates(items, subs, _state(spark, []))
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/w/deliveries").collect()) == sorted(r["id"] for r in batch.collect())
    assert spark.read.parquet(f"{tmp_path}/t").count() == 9
    assert len(runs.latest_state(spark, f"{tmp_path}/w").first()["notified_ids"]) == 9


def test_failed_delivery_changes_nothing(spark, tmp_path):
    items = _items(spark, [("a", "2024-01-02", "exam")])
    items.write.parquet(f"{tmp_path}/in")
    subs = spark.createDataFrame([("s", "exam", "2024-01-01")], "subscriber string, keyword string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))

    def fails(rows):
        raise OSError("no network")

    with pytest.raises(Exception, match="no network"):
        runs.notify_stream(spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in"), subs, f"{tmp_path}/w", f"{tmp_path}/cp", fails).awaitTermination()
    assert not (tmp_path / "w" / "deliveries").exists()
    runs.notify_stream(spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in"), subs, f"{tmp_path}/w", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/w/deliveries").count() == 1


@pytest.mark.parametrize(("few", "broadcast"), [(32, 100), (0, 100), (0, 0)])
def test_keywords_on_every_path(spark, monkeypatch, few, broadcast):
    """Searched one by one, by broadcast hashes and by shuffled ones: as a plain loop finds them."""
    rows = [(i, f"text {i} with word{i % 7} and ab é{i % 3}ç") for i in range(60)] + [(100, None), (101, ""), (102, "é"), (103, "ab"), (104, "aaaaaaaaaa" * 50)]
    words = ["word3", "AB", " with word ", "zzz", " ", "é", "é2", "and ab é1ç", "aaaaaaa", "text 5 with word5 and", None, "ab", "x"]
    monkeypatch.setattr(routing, "FEW_KEYWORDS", few)
    monkeypatch.setattr(routing, "BROADCAST_KEYWORDS", broadcast)
    keywords = spark.createDataFrame([(w, n % 2) for n, w in enumerate(words)], "keyword string, prio int")
    found = routing.keyword_match(spark.createDataFrame(rows, "id long, text string"), keywords, "id").collect()
    known = {(w.strip().lower(), n % 2) for n, w in enumerate(words) if w and w.strip()}
    assert sorted(map(tuple, found)) == sorted((i, w, n) for i, t in rows for w, n in known if t and w in t)


def test_watermark_keeps_the_last_ids(spark):
    import random

    rng = random.Random(3)
    for keep in (1, 3, 5):
        old = {f"s{i}": [f"i{n}" for n in rng.sample(range(12), rng.randint(0, keep))] for i in range(6)}
        sent = [(f"s{rng.randint(0, 7)}", f"i{rng.randint(0, 11)}", f"2024-01-{rng.randint(1, 9):02d}") for _ in range(60)]
        state = _state(spark, [(s, ids, None) for s, ids in old.items()])
        delivered = spark.createDataFrame(sent, "subscriber string, id string, first_seen string").withColumn("first_seen", F.to_timestamp("first_seen"))
        got = {r["subscriber"]: r["notified_ids"] for r in notify.advance_watermark(state, delivered, keep).collect()}
        for s in {*old, *(x[0] for x in sent)}:
            first = {}
            for _, i, t in sorted((x for x in sent if x[0] == s), key=lambda x: x[2]):
                first.setdefault(i, t)
            new = [i for i, _ in sorted(first.items(), key=lambda x: (x[1], x[0])) if i not in old.get(s, [])]
            assert got[s] == [*old.get(s, []), *new][-keep:]


def test_streams_read_one_state_snapshot(spark, tmp_path):
    """Many batches leave a snapshot each; a batch reads the one before it, also when numbers are missing."""
    schema = "subscriber STRING, notified_ids ARRAY<STRING>, notified_through TIMESTAMP"
    assert runs._state_before(spark, f"{tmp_path}/state", schema, 0).count() == 0
    for n in (0, 1, 2, 5):
        _state(spark, [("s", [f"i{n}"], None)]).write.parquet(f"{tmp_path}/state/batch={n}")
    for before, wanted in ((1, "i0"), (3, "i2"), (5, "i2"), (6, "i5"), (9, "i5")):
        rows = runs._state_before(spark, f"{tmp_path}/state", schema, before)
        assert rows.first()["notified_ids"] == [wanted]
    assert all("/batch=5/" in f for f in runs._state_before(spark, f"{tmp_path}/state", schema, 6).inputFiles())


def test_repeated_batches_choose_the_same_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, x) for x in "edcba"] + [(2, "z")], "id int, v string")
    found = set()
    for turn, parts in enumerate((1, 3)):
        rows.repartition(parts).write.parquet(f"{tmp_path}/in{turn}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in{turn}")
        runs.ingest(stream, f"{tmp_path}/t{turn}", f"{tmp_path}/cp{turn}", lambda r: r).awaitTermination()
        found.add(tuple(sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t{turn}").select("id", "v").collect())))
    assert len(found) == 1 and len(next(iter(found))) == 2


def test_delivery_plan_small_batch(spark):
    items = spark.createDataFrame([("a", 1, "club")], "id string, seq long, category string")
    routed = spark.createDataFrame([("a", "t"), ("a", "t-club")], "id string, topic string")
    assert routing.delivery_plan(items, routed, routed.limit(0)).count() == 2


def test_feed_uid(spark):
    events = spark.createDataFrame([("2024-08-13", "S", "Opening")], "date string, school string, title string")
    row = calendar.feed_rows(events).first()
    assert row["uid"].startswith("20240813-") and row["dtend"] == "20240814" and row["summary"] == "[S] Opening"


def test_deliveries_without_pairs(spark):
    """Counts, smallest ids and states as from the expanded rows: kept ids, equal times, repeated ids, several keywords, several batches."""
    rng = random.Random(5)
    times = [f"2024-01-{d:02d}" for d in range(1, 12)]
    rows = [(f"i{rng.randrange(40)}", rng.choice(times), rng.choice(["exam", "club", "exam club", "none"])) for _ in range(70)]
    subs = [(f"s{n}", k, rng.choice(times)) for n in range(30) for k in rng.choice([["exam"], ["club"], ["exam", "club"], [" EXAM ", "exam"]])]
    subs = spark.createDataFrame(subs, "subscriber string, keyword string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    state = _state(spark, [(f"s{n}", [f"i{x}" for x in rng.sample(range(40), rng.randrange(9))], rng.choice([None, *times[:6]])) for n in range(5, 36)])
    hits, asked = (x.localCheckpoint() for x in notify.matched(_items(spark, rows), subs, state))
    pairs = notify.expanded(hits, asked).localCheckpoint()
    wanted = sorted(map(tuple, pairs.groupBy("subscriber").agg(F.count("*"), F.min("id")).collect()))
    assert wanted and sorted(map(tuple, notify.candidate_counts(hits, asked).collect())) == wanted
    twice = [x.crossJoin(spark.range(2).withColumnRenamed("id", "batch")) for x in (hits, asked)]
    assert sorted(tuple(r)[1:] for r in notify.candidate_counts(*twice, ["batch"]).collect()) == sorted(wanted * 2)
    for keep in (2, 5, 500):
        assert sorted(map(str, notify.state_after(hits, asked, state, keep).collect())) == sorted(map(str, notify.advance_watermark(state, pairs, keep).collect()))


def test_popular_keyword_grows_with_its_subscribers(spark, tmp_path):
    """3,000 subscribers of 3,000 items: nine million rows, none of which is written."""
    items = spark.range(3000).select(F.concat(F.lit("i"), "id").alias("id"), F.timestamp_seconds(F.col("id") + 10).alias("first_seen"), F.lit("exam").alias("text"))
    subs = spark.range(3000).select(F.col("id").cast("string").alias("subscriber"), F.lit("exam").alias("keyword"), F.timestamp_seconds(F.col("id") % 3).alias("created_at"))
    items.coalesce(1).write.parquet(f"{tmp_path}/in")
    runs.notify_stream(spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in"), subs, f"{tmp_path}/w", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/w/deliveries").count() == 3000
    counts = notify.candidate_counts(*runs.delivered(spark, f"{tmp_path}/w"), ["batch"])
    assert counts.agg(F.count("*"), F.min("n"), F.max("n"), F.max("first_id")).first() == (3000, 3000, 3000, "i0")
    assert runs.latest_state(spark, f"{tmp_path}/w").where((F.size("notified_ids") == 500) & (F.get("notified_ids", 0) == "i2500")).count() == 3000


def test_ordered_exports_are_no_single_task(spark, tmp_path):
    """Files by name give the order; there are several, so the whole isn't sorted in one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        feed = spark.range(400).select(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7 % 50).cast("int")), "yyyy-MM-dd").alias("date"), F.col("id").cast("string").alias("uid"))
        writers.write_calendar_feed(feed, f"{tmp_path}/feed")
        writers.write_coverage_gaps(feed.select(F.col("uid").cast("long").alias("count"), F.col("date").alias("cat_ref"), F.lit("s").alias("school")), f"{tmp_path}/gaps")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name, key in (("feed", lambda r: (r["date"], r["uid"])), ("gaps", lambda r: -r["count"])):
        files = sorted((tmp_path / name).glob("part-*.json"))
        rows = [json.loads(line) for f in files for line in f.read_text().splitlines()]
        assert len(files) > 1 and len(rows) == 400 and rows == sorted(rows, key=key)
