"""MinHash near duplicates against SQL and loops over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import common, minhash

from ..oracle import check

CLASH = ["did", "key", "sig", "n", "bucket", "root", "node", "kept", "a", "b", "__parts"]
EDGE = [None, "", " \n\t ", "one", "ONE", "a b", "a  B", "a b c", "a b c d", "x " * 20000, "é́ ΑΣ \x01 \x1c ß", "same text that is here twice", "Same text that IS here\ttwice", "word" * 50_000]


def slow(ids, texts, percent=80):
    sets = []
    for t in texts:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
        sets.append({" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(c := least.get(find(i))), d == c) for i, (d, s) in enumerate(zip(ids, sets, strict=True)))


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def near(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice("uvwxyz")
    return " ".join(words)


def test_against_sql(spark):
    check(spark, minhash.query, minhash.ORACLE_SQL["op12_minhash"])


@pytest.mark.parametrize(("hot", "block"), [(1000, 200_000), (3, 300)])
def test_near_duplicates(spark, monkeypatch, hot, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BROADCAST_CLASSES", 2_000_000 if hot == 1000 else 0)
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rng = random.Random(5)
    texts = list(EDGE)
    for size, changes in ((2, 1), (3, 2), (40, 2), (25, 5)):  # the last two: large groups, at and below the limit
        base = " ".join(rng.choices([f"w{i}" for i in range(500)], k=120))
        texts += [near(rng, base, rng.randrange(changes + 1)) for _ in range(size)]
    chain = [f"c{i}" for i in range(140)]
    texts += [" ".join(chain[i : i + 90]) for i in range(0, 50, 6)]  # neighbours alone are alike
    texts += texts[-4:]
    ids = [None, 7, 7, *range(100, 100 + len(texts) - 5), None, 3]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(ids[i], texts[i]) for i in order], "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(5)
    assert found(minhash.near_duplicates(df)) == slow(ids, texts)


def test_exactly_at_the_limit(spark):
    words = [f"w{i}" for i in range(203)]
    texts = [" ".join(words[:k]) for k in (203, 163, 162)]  # 200, 160 and 159 shingles
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(minhash.near_duplicates(df.where("doc_id < 2"))) == [("0", 200, "0", True), ("1", 160, "0", False)]
    assert found(minhash.near_duplicates(df.where("doc_id <> 1"))) == [("0", 200, "0", True), ("2", 159, "2", True)]


def test_no_links(spark):
    df = spark.createDataFrame([(1, "all of these words"), (2, "are of their own here"), (3, None)], "doc_id long, text string")
    assert found(minhash.near_duplicates(df)) == [("1", 1, "1", True), ("2", 2, "2", True), ("3", 0, "3", True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n)) for n in (5, 40, 1, 30, 80)]
    found = [x.tolist() for x in minhash._overlaps(sets[:3], sets)]
    assert found == [[len(np.intersect1d(x, y)) for y in sets] for x in sets[:3]]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 3000, np.uint64)
    family = minhash.hash_family(4000)
    agree = (minhash.signature(x[:2500], family) == minhash.signature(x[500:], family)).mean()
    assert abs(agree - 2000 / 3000) < 0.03
