"""Source divergences against SQL and a loop in plain integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm import divergence

from ..oracle import check

CLASH = ["group", "other", "term", "value", "rank", "df", "counts", "item", "l", "n"]


def slow(rows, top=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        sources = {s for own, s, _ in docs if own == lang}

        def shares(of, kept=kept):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 1) // (n + len(kept)) for t in kept}

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources - {s}]
            term = [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def test_against_sql(spark):
    check(spark, divergence.query, divergence.ORACLE_SQL["op11_source_divergence"])


@pytest.mark.parametrize(("entries", "cells", "step", "top"), [(400_000, 4_000_000, 1 << 20, 200), (10, 3, 5, 4), (1, 1, 1, 1)])
def test_edges(spark, monkeypatch, entries, cells, step, top):
    for name, value in (("STRIPE_ENTRIES", entries), ("PAIR_CELLS", cells), ("STEP_CELLS", cells), ("TEXT_STEP", step)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(2)
    words = ["alpha", "Beta", "BETA2gamma", "é", "Éa", "日本", "x" * 50, "😀", "ﬀ", "A_b", "tie", "eit"]
    rows = [(" \n".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None, ""])) for _ in range(60)]
    rows += [(None, "en", "s9"), ("", "xx", "only"), (None, "yy", "a"), ("123 _", "yy", "b"), ("rare words", "zz", "c"), ("alpha " * 30_000, "en", "long"), ("same", "en", "s1"), ("same", "en", "s1"), ("same", "en", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in CLASH}).repartition(5)
    found = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df, top).collect())
    assert found == slow(rows, top)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).count() == 0
    rows = [(None, None, None), ("once", "en", "a")]
    assert divergence.audit(spark.createDataFrame(rows, df.schema)).count() == 0


def test_too_many_groups(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MAX_GROUPS", 2)
    rows = [("a", "en", s) for s in "abc"]
    with pytest.raises(ValueError, match="groups"):
        divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"))


@pytest.mark.parametrize("total", [1, 7, 9_223_372_036, 9_223_372_037, 10**12 + 7, (1 << 53) - 1])
def test_shares_are_exact(total):
    counts = np.array(sorted({0, total // 3, total // 2, total - 1}), np.int64)
    assert divergence.share(counts, total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts.tolist()]
