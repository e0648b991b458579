"""Operator 1: near duplicates by SimHash and a generalised pigeonhole search.

A fingerprint's 64 bits are grouped into partitions of correlated bits. Two fingerprints that
differ in at most `radius` bits agree, in at least one partition i, up to its threshold t(i), if
the t(i) + 1 add up to radius + 1; a threshold of -1 leaves a partition out. The number of
partitions and the thresholds are those of the least estimated work, found by dynamic programming.
"""

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .components import components

SEED = 42
RADIUS = 3
#: The search plan is estimated from so many fingerprints at most; it decides speed, never results.
PLAN_SAMPLE = 4096
#: Work of a shuffled probe or index row, and of a compared pair.
ROW_COST, PAIR_COST = 1.0, 0.02


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles as an unsigned integer; no words: 0."""
    words = (text or "").encode().lower().split()  # bytes: exactly A-Z, and \x20 \x09-\x0D
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:]))
    n = max(1, len(words) - 2)
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    for at in range(0, n, 1 << 16):  # 64 bytes a shingle, so in steps
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def correlated_groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bit positions in m groups of about one size, each bit with those it correlates with."""
    centred = bits - bits.mean(0)
    spread = np.sqrt((centred**2).mean(0))
    spread[spread == 0] = 1
    near = np.abs(centred.T @ centred / len(bits) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    free, groups = set(range(64)), []
    for g in range(m):
        want = len(free) // (m - g)
        group = [max(free, key=lambda i: (near[i, sorted(free)].sum(), -i))]
        free.remove(group[0])
        while len(group) < want:
            group.append(max(free, key=lambda i: (near[i, group].sum(), -i)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _pair_rates(sample: np.ndarray, bits: np.ndarray, groups: list[list[int]], radius: int) -> np.ndarray:
    """Estimated share of pairs within each distance 0..radius in each group of bits."""
    masks = np.array([sum(1 << i for i in g) for g in groups], np.uint64)
    hits, pairs = np.zeros((len(groups), radius + 1)), max(1, len(sample) * (len(sample) - 1) // 2)
    for at in range(0, len(sample), 256):
        other = sample[at : at + 256, None] ^ sample[None, :]
        later = np.arange(len(sample))[None, :] > np.arange(at, min(at + 256, len(sample)))[:, None]
        for g, mask in enumerate(masks):
            dist = np.bitwise_count(other & mask)[later]
            hits[g] += [(dist <= t).sum() for t in range(radius + 1)]
    rates = hits / pairs
    q = bits.mean(0) if len(bits) else np.full(64, 0.5)
    for g, group in enumerate(groups):  # a small sample shows no rare pairs: independent bits as a floor
        dist = np.zeros(radius + 2)
        dist[0] = 1
        for p in (2 * q * (1 - q))[group]:
            dist = dist * (1 - p) + np.r_[0, dist[:-1]] * p
        rates[g] = np.maximum(rates[g], dist.cumsum()[: radius + 1])
    return rates


def allocate(costs: np.ndarray, radius: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = radius + 1; costs[i][t] for t = 0..radius."""
    best = {0: (0.0, [])}
    for row in costs:
        step = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, radius - used + 1):
                new = (cost + (row[t] if t >= 0 else 0), [*ts, t])
                if used + t + 1 not in step or new < step[used + t + 1]:
                    step[used + t + 1] = new
        best = step
    return best[radius + 1]


def search_plan(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """[(bit positions, threshold)] for n fingerprints, estimated from a sample of them (uint64)."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    plans = []
    for m in range(2, radius + 4):
        groups = correlated_groups(bits, m) if len(bits) else [list(range(g, 64, m)) for g in range(m)]
        rates = _pair_rates(sample, bits, groups, radius)
        probes = np.array([np.cumsum([comb(len(g), t) for t in range(radius + 1)]) for g in groups])
        costs = n * (1 + probes) * ROW_COST + n * n / 2 * rates * PAIR_COST
        cost, ts = allocate(costs, radius)
        plans.append((cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variant(part: int, own: Column, flip: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), own.bitwiseXOR(flip).alias("key"))


def links(fps: DataFrame, plan: list[tuple[list[int], int]], radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: every two of the distinct fingerprints in `fps` that differ in at most `radius` bits."""
    index, probe = [], []
    for part, (group, t) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << i for i in group))))
        flips = F.array(*[F.lit(_signed(sum(1 << i for i in c))) for k in range(t + 1) for c in combinations(group, k)])
        index.append(F.struct(F.lit(part).alias("part"), own.alias("key")))
        probe.append(F.transform(flips, partial(_variant, part, own)))
    right = fps.select(F.col("fp").alias("b"), F.explode(F.array(*index)).alias("k")).select("b", "k.part", "k.key")
    left = fps.select(F.col("fp").alias("a"), F.explode_outer(F.concat(*probe)).alias("k")).select("a", "k.part", "k.key")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    found = left.alias("l").join(right.alias("r"), (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key")) & near)
    return found.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint, component_id, n_links.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id reachable over links of
    at most `radius` differing bits, itself included. n_links: how many other fingerprints it links to.
    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows give
    repeated results. A null doc_id stays null in the result and never becomes a component_id unless its
    group has no other id. Other columns of `docs` are ignored. An empty table gives an empty result.
    """
    rows = saved(fingerprints(docs), "fingerprints")
    groups = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    n = groups.count()
    picked = groups.select("fp").orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).collect()
    sample = np.array([r.fp for r in picked], np.int64).view(np.uint64)
    edges = saved(links(groups.select("fp"), search_plan(sample, n, radius), radius), "near")
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    roots = components(edges).join(degree, "node")
    known = groups.join(roots, groups.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    known = saved(known, "known")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return (
        rows.join(known.join(smallest, "root").select("fp", "component_id", "n_links"), "fp")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": query}
ORACLE_SQL: dict[str, str] = {}
