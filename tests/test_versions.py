"""Versioned tables with several writers."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from noticelake.operators import merge
from noticelake.sources import writers


def users(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "key int, value string")


def test_two_writers_both_survive(spark, tmp_path, monkeypatch):
    """The second writer publishes while the first merges: the first merges anew, on top of it."""
    folder, plain = str(tmp_path / "t"), merge.upsert_by_key
    writers.upsert_user_rows(users(spark, 1), folder, ["key"], "me")
    calls = []

    def slow(old, new, keys):
        calls.append(1)
        if len(calls) == 1:
            writers.upsert_user_rows(users(spark, 2), folder, ["key"], "me")
        return plain(old, new, keys)

    monkeypatch.setattr(merge, "upsert_by_key", slow)
    path = writers.upsert_user_rows(users(spark, 3), folder, ["key"], "me")
    assert len(calls) == 3 and path == writers.current_version(spark, folder)
    assert {r["key"] for r in spark.read.parquet(path).collect()} == {1, 2, 3}


def test_writers_in_threads(spark, tmp_path):
    folder = str(tmp_path / "t")
    writers.upsert_user_rows(users(spark, 0), folder, ["key"], "me")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: writers.upsert_user_rows(users(spark, i), folder, ["key"], "me"), [1, 2, 3]))
    assert {r["key"] for r in spark.read.parquet(writers.current_version(spark, folder)).collect()} == {0, 1, 2, 3}


def test_a_number_is_published_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert writers.current_version(spark, folder) is None
    assert writers._publish(spark, folder, "v1-a", 1) and not writers._publish(spark, folder, "v1-b", 1)
    assert writers.current_version(spark, folder) == f"{folder}/v1-a"


def test_snapshot_of_an_old_version(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    for check in ("require_keys", "require_capacity", "require_lossless"):
        monkeypatch.setattr(writers.quality, check, lambda *a: None)
    items = spark.createDataFrame([("1", "2024-01-01", "2024-01-01")], "id string, date string, first_seen string")
    first = writers.write_snapshot(items, folder, "2023-01-01")
    second = writers.write_snapshot(items, folder, "2023-01-01", based_on=first)
    with pytest.raises(writers.VersionConflict):
        writers.write_snapshot(items, folder, "2023-01-01", based_on=first)
    assert writers.current_version(spark, folder) == second
