"""State across batches: outbox order and retries, the keyed log and its compaction."""

import itertools
import os
import random

import pytest

from noticelake.streaming import runs, state

MUTATION = "account_id string, seq long, id string, failed boolean"


def drain(spark, folder, batches):
    """What each batch applies, by account, in order."""
    out = []
    for rows in batches:
        spark.createDataFrame(rows, MUTATION).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(MUTATION).parquet(f"{folder}/in")
        runs.drain_outbox(stream, runs.F.col("account_id"), f"{folder}/out", f"{folder}/cp").awaitTermination()
        found = spark.read.parquet(f"{folder}/out/applied").collect()
        out.append(sorted((r["account_id"], r["seq"]) for r in found if r["batch"] == len(out)))
    return out


def model(batches):
    """The same by lists: a queue an account, whose failed head waits."""
    queue, done, out = {}, set(), []
    for rows in batches:
        now = []
        for account, seq, id_, failed in rows:
            if (account, id_) not in done:
                q = queue.setdefault(account, {})
                old = q.get(id_)
                q[id_] = (min(seq, old[0]) if old else seq, failed and (old is None or old[1]))
        for account, q in queue.items():
            for id_, (seq, failed) in sorted(q.items(), key=lambda x: x[1][0]):
                if failed:
                    break
                now.append((account, seq))
                done.add((account, id_))
            for id_ in [i for i in q if (account, i) in done]:
                del q[id_]
        out.append(sorted(now))
    return out


def test_outbox_waits_for_its_head(spark, tmp_path):
    a = lambda *ms: [("a", abs(m), f"m{abs(m)}", m < 0) for m in ms]
    batches = [a(1, -2, 3), a(4), a(2), a(2, 1)]
    assert drain(spark, tmp_path, batches) == [[("a", 1)], [], [("a", 2), ("a", 3), ("a", 4)], []]


def test_outbox_against_a_queue(spark, tmp_path):
    rng, seq, open_, batches = random.Random(3), itertools.count(1), {}, []
    for _ in range(5):
        rows = []
        for account in "abc":
            for n in [next(seq) for _ in range(rng.randrange(4))]:
                rows.append((account, n, f"m{n}", failed := rng.random() < 0.3))
                if failed:
                    open_.setdefault(account, []).append(n)
            for n in [n for n in open_.get(account, []) if n not in {r[1] for r in rows} and rng.random() < 0.5]:
                rows.append((account, n, f"m{n}", rng.random() < 0.3))
        batches.append(rows or [("z", 0, "m0", False)])
    assert drain(spark, tmp_path, batches) == model(batches)


def test_foreign_owner_fails(spark, tmp_path):
    spark.createDataFrame([("a", 1, "m1", False)], MUTATION).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(MUTATION).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="another owner"):
        runs.drain_outbox(stream, "b", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()


def held(log, before, keys=None):
    return sorted((r["k"], r["v"]) for r in log.read(before, keys).collect())


def test_keyed_state(spark, tmp_path):
    log = state.KeyedState(spark, str(tmp_path), "k STRING, v LONG", "k", 4)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    assert held(log, 0) == []
    log.write(0, rows(("a", 1), ("a", 2), ("b", 3)), keys("a", "b"))
    log.write(1, rows(("a", 4)), keys("a", "c"))
    log.write(2, rows(("d", 5)), keys("b", "d"))  # b has no rows any more
    wanted = [[], [("a", 1), ("a", 2), ("b", 3)], [("a", 4), ("b", 3)], [("a", 4), ("d", 5)]]
    assert [held(log, n) for n in range(4)] == wanted
    log.write(2, rows(("d", 5)), keys("b", "d"))  # the batch again
    assert held(log, 3) == wanted[3] and held(log, 3, keys("d", "b")) == [("d", 5)]
    log.compact(1)
    assert held(log, 2) == wanted[2] and held(log, 3) == wanted[3]
    log.compact(2)
    assert held(log, 3) == wanted[3]
    assert os.listdir(f"{tmp_path}/log") == [] or all(not n.startswith("__batch") for n in os.listdir(f"{tmp_path}/log"))
    assert [n for n in os.listdir(f"{tmp_path}/base") if n.startswith("__batch")] == ["__batch=2"]
    log.write(3, rows(("a", 9)), keys("a"))
    assert held(log, 4) == [("a", 9), ("d", 5)]


def test_batches_write_few_files(spark, tmp_path):
    """A folder of accounts gets one file a batch while it is small, whatever number of tasks has rows of it."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        drain(spark, tmp_path, [[(f"a{i}", n, f"m{n}", n == 2) for i in range(60) for n in range(4)]])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for folder, row in ((tmp_path / "out/applied/batch=0", 120), (tmp_path / "out/pending/log/__batch=0", 120)):
        assert all(len(list(f.glob("*.parquet"))) == 1 for f in folder.iterdir() if f.is_dir())
        assert spark.read.parquet(str(folder)).count() == row
