"""Operator 7: URL verdicts by longest rule, else by a Bloom filter cascade.

Level 1 of a cascade holds the listed keys; level 2 holds those other keys of the universe that level 1
lets through (only these are held against the list by a join); level 3 the listed keys that level 2 lets through, and so on until none is left. Over the
universe it was built from, a cascade answers exactly, and a lookup touches no table. Keys are dealt to
shards of bounded size, each with a cascade of its own, so no filter outgrows its broadcast.
"""

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, lower_ascii, saved, table

#: Rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hash functions of each level; a level then takes K / ln 2 bits a key and lets 1 in 2**K through.
K = 6
#: Listed keys in a shard: its first level has about 9 bits each, 9 MB.
SHARD_KEYS = 8_000_000
MAX_LEVELS = 64
#: Cascades of several shards are broadcast together up to so many bytes.
LOOKUP_BYTES = 128 << 20


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path, or null."""
    whens = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*whens) if whens else F.lit(None).cast("struct<rule:string,verdict:string>")


@dataclass
class Level:
    """A Bloom filter: m bits as 64-bit words."""

    m: int
    words: np.ndarray

    def holds(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for k in range(K):
            bit = _position(h1, h2, level, k, self.m)
            found &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return found


def _position(h1: np.ndarray, h2: np.ndarray, level: int, k: int, m: int) -> np.ndarray:
    """Bit k of a level for each key: a mix of both hashes, modulo m."""
    mixed = h1 + np.uint64(level * K + k + 1) * h2
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)  # else small m see few bits of either
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))) % np.uint64(m)


def _build(keys: DataFrame, n: int, level: int) -> Level:
    """The filter of the n keys (h1, h2), its words or-ed together by Spark; they come to the driver, m / 64 at most."""
    m = max(64, math.ceil(n * K / math.log(2) / 64) * 64)

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            at = np.unique(np.concatenate([_position(h1, h2, level, k, m) for k in range(K)]))
            words, start = np.unique(at >> np.uint64(6), return_index=True)
            ored = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(ored.view(np.int64))], ["word", "bits"])

    set_bits = keys.select("h1", "h2").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = set_bits.toArrow()
    words = np.zeros(m // 64, np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Level(m, words)


def _through(keys: DataFrame, level: Level, number: int) -> DataFrame:
    """The keys (h1, h2) that one level lets through."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield batch.filter(pa.array(shared.value.holds(h1, h2, number)))

    return keys.mapInArrow(run, "h1 long, h2 long")


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell the keys (h1, h2) of `listed` from the other keys of `universe`; both tables distinct.

    Only what the first level lets through is held against the list, by a join.
    """
    if not (n := listed.count()):
        return []
    levels = [_build(listed, n, 0)]
    inside = saved(_through(universe, levels[0], 0).join(listed, ["h1", "h2"], "left_anti"), "through")
    outside = listed
    while n := inside.count():
        if len(levels) == MAX_LEVELS:
            raise RuntimeError(f"two keys have equal hashes: {MAX_LEVELS} levels don't part them")
        levels.append(_build(inside, n, len(levels)))
        inside, outside = saved(_through(outside, levels[-1], len(levels) - 1), "through"), inside
    return levels


def contains(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys the cascade lists."""
    listed, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for number, level in enumerate(levels):
        held = level.holds(h1[open_], h2[open_], number)
        listed[open_[~held]] = number % 2 == 1
        open_ = open_[held]
    listed[open_] = len(levels) % 2 == 1
    return listed


def with_hashes(keys: DataFrame, h1: str = "h1", h2: str = "h2") -> DataFrame:
    """`keys` with two hashes of the column `key`."""
    return keys.withColumns({h1: F.xxhash64("key"), h2: F.xxhash64(F.lit("cascade"), F.col("key"))})


def _shard(h1: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(h1), F.lit(shards)).cast("int")


def mark_listed(rows: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS, lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """`rows` (with a column key) and is_listed: whether `listed` (key) has the key; exact, without a join.

    Null and empty keys are never listed. Repeated keys count once. Listed keys that no row has don't matter. A
    column is_listed of `rows` is replaced, all others are kept. Cascades of several shards, up to `lookup_bytes`,
    are looked up in one pass over the rows.
    """
    rows = rows.drop("is_listed")
    key = F.coalesce("key", F.lit(""))
    wanted = with_hashes(listed.select("key").where(key != "")).select("h1", "h2").distinct()
    universe = with_hashes(rows.select("key").where(key != "")).select("h1", "h2").distinct()
    wanted = saved(wanted, "listed")
    shards = max(1, math.ceil(wanted.count() / shard_keys))
    if shards > 1:  # each shard is a folder, read alone
        wanted = saved(wanted.withColumn("shard", _shard("h1", shards)), "listed", ["shard"])
    universe = saved(universe.withColumn("shard", _shard("h1", shards)), "universe", ["shard"])
    h1, h2 = free_name("h1", rows.columns), free_name("h2", rows.columns)
    hashed = with_hashes(rows, h1, h2)
    parts, now, size = [], {}, 0
    for s in range(shards):
        own = wanted.where(F.col("shard") == s) if shards > 1 else wanted
        now[s] = cascade(own.select("h1", "h2"), universe.where(F.col("shard") == s).select("h1", "h2"))
        size += sum(level.m // 8 for level in now[s])
        if size >= lookup_bytes or s == shards - 1:
            mine = hashed.where(_shard(h1, shards).isin(*now)) if shards > 1 else hashed
            parts.append(_marked(mine, now, shards, (h1, h2)))
            now, size = {}, 0
    return reduce(DataFrame.unionAll, parts)


def _marked(rows: DataFrame, cascades: dict[int, list[Level]], shards: int, hashes: tuple[str, str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(cascades)  # LOOKUP_BYTES and one shard's at most
    dealt = rows.withColumn(free_name("shard", rows.columns), _shard(hashes[0], shards))
    at = [dealt.columns.index(c) for c in ("key", *hashes)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, (h1, h2) = batch.column(at[0]), (batch.column(i).to_numpy().view(np.uint64) for i in at[1:])
            shard = batch.column(batch.num_columns - 1).to_numpy()
            found = np.zeros(batch.num_rows, bool)
            for s in np.unique(shard):
                mine = shard == s
                found[mine] = contains(shared.value[int(s)], h1[mine], h2[mine])
            some = np.array([bool(x) for x in key.to_pylist()], bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found & some)], [*batch.schema.names, "is_listed"])

    out = T.StructType([*dealt.schema.fields, T.StructField("is_listed", T.BooleanType())])
    return dealt.mapInArrow(run, out).drop(*hashes, dealt.columns[-1])


def judge(pages: DataFrame, listed: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict and is_listed for each row of `pages` (page_id, url).

    The longest fitting rule (verdict, host, path) decides; without one, a url whose host and path `listed`
    (key) has is blocked, any other allowed. A null url or one without `://` has an empty host and path,
    which no rule fits and no list has. A url's length doesn't matter. Repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result.
    """
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    marked = mark_listed(parsed.withColumn("key", F.concat("host", "path")), listed, shard_keys)
    ruled = marked.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(F.col("is_listed"), "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "is_listed")


def tracked_keys(pages: DataFrame) -> DataFrame:
    """The list of the registered query: host and path of every url seen with a `utm_` parameter."""
    url = F.col("url")
    return pages.where(url.rlike("[?&]utm_")).select(F.concat(host(url), path(url)).alias("key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, tracked_keys(pages))


QUERIES = {"op7_url_filter": query}
ORACLE_SQL = {
    "op7_url_filter": r"""
WITH p AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
t AS (SELECT DISTINCT host || path AS key FROM p WHERE regexp_matches(url, '[?&]utm_') AND host || path <> ''),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN t.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       t.key IS NOT NULL AS is_listed
FROM r LEFT JOIN t ON r.host || r.path = t.key
"""
}
