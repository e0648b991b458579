"""Operator 12: near duplicates by MinHash.

A document's set of word shingles gives a signature of many minima, each of another universal hash. Documents of equal
sets are one class. Classes whose signatures agree in a whole band of minima share a bucket. Within a bucket all are
compared with one leader: signatures first, then the full sets. Components of the links come from alternating large and
small stars. Where a bucket then holds several components, classes outside of the largest are compared with all others,
in blocks, on full sets: nothing is lost, and no group of copies becomes rows of pairs.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_apart, join_salted, saved, table
from .components import components

WORDS, PERCENT = 4, 80
#: 32 bands of 4 minima: of two sets at the least similarity of 0.8, one pair in 20 million shares no bucket.
BANDS, ROWS = 32, 4
#: A signature may fall short of the similarity by so many standard deviations: one pair in a billion does.
DEVIATIONS = 6
SEED = 42
#: Shingles hashed at a time by all hash functions.
STEP = 2048
#: Shingles of a block of classes that meets another block in one task.
BLOCK = 50_000
#: Classes (two longs each) that go to all tasks, so that no text is shuffled; more meet their texts by a shuffle.
BROADCAST_CLASSES = 2_000_000
_LAST = (1 << 63) - 1


def shingles(text: bytes | None, words: int = WORDS) -> set[bytes]:
    """The distinct shingles of `words` words; of fewer words the whole sequence; of none nothing."""
    found = (text or b"").lower().split()  # bytes: exactly A-Z, and \x20 \x09-\x0D
    if not found:
        return set()
    return set(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))) if len(found) >= words else {b" ".join(found)}


def hashes(found: set[bytes]) -> np.ndarray:
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))


def hash_family(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of n universal hashes of 32 bits: the upper half of a * x + b modulo 2^64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def signature(h: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    least, x = np.full(len(a), 0xFFFFFFFF, np.uint64), h & np.uint64(0xFFFFFFFF)
    for at in range(0, len(x), STEP):
        least = np.minimum(least, ((a[:, None] * x[None, at : at + STEP] + b[:, None]) >> np.uint64(32)).min(1))
    return least.astype("<u4")


def _set_key(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, n, sig): the set of each row by a hash of all its shingles, its size, its minima of 4 bytes each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(bands * rows)
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                h = hashes(found)
                keys.append(_set_key(h))
                sizes.append(len(found))
                sigs.append(signature(h, family).tobytes() if found else None)
            columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "key", "n", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, key long, n long, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, shingles): the hashed set of each class in `wanted` (did, key), from a document that has it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # a batch a text: few are long
                h = hashes(shingles(text, words))
                if _set_key(h) == key:  # not another text of that doc_id
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([h.view(np.int64).tolist()], pa.list_(pa.int64()))], ["key", "shingles"])

    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    texts = docs.select(_did(), F.col("text").cast("binary").alias("text")).join(wanted, "did").select("key", "text")
    return texts.mapInArrow(run, "key long, shingles array<long>").dropDuplicates(["key"])


def _did() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("did")


def _bands(sig: Column, bands: int, rows: int) -> Column:
    at = F.sequence(F.lit(0), F.lit(bands - 1))
    return F.transform(at, lambda i: F.xxhash64(i, F.substring(sig, i * (4 * rows) + 1, F.lit(4 * rows))))


def buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, key) of every bucket that several classes share, stored."""
    held = saved(classes.select("key", F.explode(_bands(F.col("sig"), bands, rows)).alias("bucket")), "bands")
    several = saved(held.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "several")
    total = several.agg(F.sum("n")).first()[0] or 0
    return saved(join_apart(held, several, "bucket", total).select("bucket", "key").distinct(), "buckets")


def _attached(pairs: DataFrame, values: DataFrame, column: str, n: int) -> DataFrame:
    """`pairs` (a, b), a stored table of n rows, with `column` of both, as in_a and in_b."""
    for side in ("a", "b"):
        own = values.select(F.col("key").alias(side), F.col(column).alias(f"in_{side}"))
        found = join_salted(pairs if side == "a" else found, own, side, pairs, n)
    return found


def alike(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of `pairs` (a, b), a stored table, whose signatures agree in at least `least` minima."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((mine == other).sum(1) >= least))

    found = _attached(pairs, classes, "sig", pairs.count())
    return found.select("a", "b", "in_a", "in_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b), a stored table, whose full sets share at least `percent` of their union."""
    found = _attached(pairs, sets, "shingles", pairs.count())
    both = F.size(F.array_intersect("in_a", "in_b")).cast("long")
    return found.where(both * (100 + percent) >= (F.size("in_a") + F.size("in_b")) * percent).select("a", "b")


def _led(member: DataFrame) -> DataFrame:
    """(a, b): each class of a bucket with the one that shares most buckets, stored; the original of many copies is such."""
    weight = member.groupBy("key").agg(F.count("*").alias("weight"))  # a class is in `bands` buckets at most
    lead = member.join(weight, "key").groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.struct("weight", "key"))["key"].alias("leader"))
    lead = saved(lead, "leaders")
    met = join_apart(member, lead, "bucket", lead.agg(F.sum("n")).first()[0] or 0).where("key <> leader")
    return saved(met.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct(), "pairs")


def _regions(member: DataFrame) -> DataFrame:
    """(region, key, root), stored: of each bucket that still holds several components, the largest names the region of
    all its classes. `member`: bucket, key, root, stored.
    """
    parts = member.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    found = parts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("roots"), F.max(F.struct("c", "root"))["root"].alias("region"))
    found = saved(found.where("roots > 1").drop("roots"), "open")
    held = join_apart(member, found, "bucket", found.agg(F.sum("n")).first()[0] or 0)
    return saved(held.select("region", "key", "root").distinct(), "regions")


def _overlaps(few: list[np.ndarray], others: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each of `few` the number of elements it shares with each of `others`, by inverted lists."""
    owner = np.repeat(np.arange(len(others)), list(map(len, others)))
    flat = np.concatenate(others)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for x in few:
        start, end = np.searchsorted(flat, x), np.searchsorted(flat, x, "right")
        n = end - start
        at = np.repeat(start - (n.cumsum() - n), n) + np.arange(n.sum())
        yield np.bincount(owner[at], minlength=len(others))


def _rest(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a region, one at least for every two that are linked.

    Classes outside of the largest component meet all others of their region. Both are dealt to blocks of about BLOCK
    shingles; every two blocks meet in one group, where inverted lists give the exact overlaps. No pair is a row.
    """

    def run(group: pa.Table) -> pa.Table:
        keys, roots = (group.column(c).to_numpy() for c in ("key", "root"))
        few, side = (group.column(c).to_numpy(zero_copy_only=False) for c in ("few", "probe"))
        held = [x.values.to_numpy() for x in group.column("shingles")]
        probes, others = np.flatnonzero(side), np.flatnonzero(~side)
        a, b, joined = [], [], set()
        if len(probes) and len(others):
            sizes = np.array([len(held[i]) for i in others])
            for i, both in zip(probes.tolist(), _overlaps([held[i] for i in probes], [held[i] for i in others]), strict=True):
                linked = both * (100 + percent) >= (sizes + len(held[i])) * percent
                linked &= (roots[others] != roots[i]) & (~few[others] | (keys[others] > keys[i]))
                for j in others[linked].tolist():
                    if (at := (roots[i], roots[j])) not in joined:
                        joined.add(at)
                        a.append(min(keys[i], keys[j]))
                        b.append(max(keys[i], keys[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    few = F.col("root") != F.col("region")
    sized = regions.join(sets.select("key", F.size("shingles").cast("long").alias("size")), "key")  # no set moves yet
    sized = saved(sized.select("region", "key", "root", few.alias("few"), "size"), "sized")
    blocks = [F.ceil(F.sum(x) / BLOCK).cast("int").alias(n) for x, n in ((F.col("size"), "others"), (F.when(F.col("few"), F.col("size")), "probes"))]
    dealt = saved(sized.groupBy("region").agg(F.count("*").alias("n"), *blocks), "blocks")
    rows = join_apart(sized, dealt, "region", dealt.agg(F.sum("n")).first()[0] or 0)

    def sent(mine: str, all_: str) -> Column:  # the row's own block, with each of the other side's
        own = F.pmod(F.xxhash64("key"), mine).cast("int").alias(mine)
        return F.transform(F.sequence(F.lit(0), F.col(all_) - 1), lambda i: F.struct(F.lit(mine == "probes").alias("probe"), *((own, i.alias(all_)) if mine == "probes" else (i.alias(all_), own))))

    to = F.concat(sent("others", "probes"), F.when(F.col("few"), sent("probes", "others")).otherwise(F.array()))
    met = rows.select("region", "key", "root", "few", F.explode(to).alias("to")).select("region", "key", "root", "few", "to.*").join(sets, "key")
    return met.groupBy("region", "probes", "others").applyInArrow(run, "a long, b long")


def links(member: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, minima: int) -> DataFrame:
    """(node, root): the components of all classes that are linked with others."""
    least = minima * percent / 100 - DEVIATIONS * (minima * percent * (100 - percent)) ** 0.5 / 100
    near = saved(alike(_led(member), classes, least), "alike")
    good = saved(confirmed(near, sets, percent), "confirmed")
    roots = components(good)
    now = member.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rest = saved(_rest(_regions(saved(now, "members")), sets, percent), "rest")
    return components(good.union(rest)) if rest.count() else roots


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    n_shingles: distinct shingles of `words` words; fewer words are one shingle, no words (null, empty, blank) none, and
    such rows are linked with nothing. Two rows are linked if their sets share `percent` in 100 of their union, at least.
    component_id: the smallest doc_id reachable, itself included. kept: whether that is the row's own. Equal texts, and
    repeated rows, are linked. A null doc_id comes after all others: it is a component_id only where its group has no
    other. Texts are taken whole, long ones in steps. Other columns are ignored; an empty table gives an empty result.
    """
    signed = saved(signatures(docs, words, bands, rows), "signatures")
    counted = signed.where("n > 0").groupBy("key", "sig").agg(F.min(_did()).alias("did"), F.count("*").alias("n"))
    classes = saved(counted, "classes")
    member = buckets(classes, bands, rows)
    wanted = saved(classes.join(member.select("key").distinct(), "key").select("key", "did", "sig"), "wanted")
    sets = saved(full_sets(docs, wanted.select("did", "key"), words), "sets")
    roots = links(member, wanted, sets, percent, bands * rows).withColumnRenamed("node", "key")
    known = saved(classes.select("key", "did", "n").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "known")
    smallest = known.groupBy("root").agg(F.min("did").alias("least"), F.count("*").alias("n"))
    classes_of = saved(join_apart(known.withColumnRenamed("n", "held"), smallest, "root", known.count()).select("key", "least", F.col("held").alias("n")), "least")
    full = signed.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "key")
    out = join_apart(full, classes_of, "key", signed.count()).select("doc_id", "n_shingles", F.when(F.col("least") != _LAST, F.col("least")).alias("component_id"))
    blank = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_minhash": query}
ORACLE_SQL = {
    "op12_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ 	-
]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + 3], ' ') for i in range(1, len(words) - 2)] END) AS shingles
  FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM common WHERE 100 * c >= 80 * (na + nb - c)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.seen = link.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s.shingles) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN least ON node = s.doc_id
"""
}
