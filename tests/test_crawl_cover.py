"""Capped crawls against a queue, covering sets against a greedy loop."""

import random

import pytest

from noticelake.operators import graph, quality


def queue(links, seeds, cap):
    out, todo = {}, [(n, 0) for n, _ in sorted(seeds, key=lambda x: x[1])]
    while todo and len(out) < cap:
        node, depth = todo.pop(0)
        if node in out:
            continue
        out[node] = (depth, len(out))
        todo += [(d, depth + 1) for _, s, d in sorted((p, s, d) for s, d, p in links if s == node)]
    return out


@pytest.mark.parametrize("cap", [0, 1, 7, 25, 1000])
def test_crawl(spark, cap):
    rng = random.Random(cap)
    links = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", i) for i in range(110)]
    links += [(a, b, i + 500) for a, b, i in links[:9]] + [("n1", "n1", 900)]
    seeds = [("n1", 0), ("n2", 1), ("n1", 2)]
    found = [(f"n{i}", f"c{i % 7}", i) for i in range(0, 60, 3)]
    pages, items, hit = graph.crawl(spark.createDataFrame(links, "src string, dst string, pos int").repartition(3), spark.createDataFrame(seeds, "node string, pos int"), cap, spark.createDataFrame(found, "page string, item string, pos int"))
    wanted = queue(links, seeds, cap)
    assert {r["node"]: (r["depth"], r["place"]) for r in pages.collect()} == wanted
    first = {}
    for page, item, _ in sorted((f for f in found if f[0] in wanted), key=lambda f: wanted[f[0]][1]):
        first.setdefault(item, page)
    assert {r["item"]: r["referrer"] for r in items.collect()} == first
    assert hit == (len(wanted) >= cap)


def greedy(pairs):
    sets, out = {}, []
    for page, article in pairs:
        sets.setdefault(page, set()).add(article)
    open_ = {a for _, a in pairs}
    while open_:
        page = min(sets, key=lambda p: (-len(sets[p] & open_), p))
        out.append((page, len(sets[page] & open_)))
        open_ -= sets[page]
    return out


def test_cover(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(25), rng.randrange(60)) for _ in range(120)] + [(100 + i // 2, 1000 + i // 4) for i in range(16)] + [(3, 3), (3, 3)]
    found = quality.cover_pages(spark.createDataFrame(pairs, "page int, article int")).orderBy("turn").collect()
    assert sorted(((r["page"], r["gain"]) for r in found), key=lambda x: (-x[1], x[0])) == greedy(pairs)
    assert max(r["turn"] for r in found) < len(found) - 1
    assert quality.cover_pages(spark.createDataFrame([], "page int, article int")).count() == 0


def test_cover_looks_at_large_gains_first(spark, monkeypatch):
    """Turns over large pages hold no pairs of small ones; pairs without a page or an article change nothing."""
    chain = [(f"big{i:02}", 100 * i + j) for i in range(12) for j in range(102 - i)]  # neighbours share articles
    small = [(f"s{i:03}", 5000 + i // 3) for i in range(600)] + [(f"t{i:03}", i) for i in range(600)]
    pairs, turn, held = chain + small, quality._cover_turn, []
    monkeypatch.setattr(quality, "_cover_turn", lambda df, least: held.append(df.count()) or turn(df, least))
    odd = [(None, 1), ("big00", None), (None, None), ("only null", None), chain[0]]
    found = quality.cover_pages(spark.createDataFrame(pairs + odd, "page string, article long")).collect()
    assert sorted(((r["page"], r["gain"]) for r in found), key=lambda x: (-x[1], x[0])) == greedy(pairs)
    assert max(held) <= len(chain) and sum(held) < 2 * len(pairs)


def test_reachable_keeps_no_table_of_edges(spark, monkeypatch):
    """Repeated edges change nothing, and only nodes are made distinct."""
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    distinct, seen = type(edges).distinct, []
    monkeypatch.setattr(type(edges), "distinct", lambda df: seen.append(df.columns) or distinct(df))
    found = graph.reachable(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()
    assert sorted(map(tuple, found)) == [("a", 0), ("b", 1), ("c", 2)]
    assert seen and ["src", "dst"] not in seen
