"""Operator 11: how far each source's word use is from its language's other sources, by in-mapper stripes.

Partitions fold whole documents into hash stripes, term to (document frequency, counts by source), hand them on when
they hold many entries, and start anew. Stripes are merged by (language, term) in sorted order, one at a time. Merged
stripes give the divergences directly: exact integer sums for pairs of sources, the largest terms for each source.
"""

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, slices, table

MIN_DOCUMENTS, TOP, SCALE = 3, 200, 1_000_000_000
#: A partition hands its stripes on at about so many (source, term) entries.
STRIPE_ENTRIES = 400_000
#: A task adds up so many pairs of sources at most before it hands them on; terms by sources in one step.
PAIR_CELLS, STEP_CELLS = 4_000_000, 1_000_000
#: The report of pairs has sources x sources rows a language: more (language, source) groups than this are refused.
MAX_GROUPS = 100_000
#: Bytes of a text folded at a time; it is cut only between terms.
TEXT_STEP = 1 << 20
_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, repeats included, in lists of about TEXT_STEP bytes of it: letters A-Z, lower-cased, and all beyond ASCII."""
    text, at = text.lower(), 0  # of bytes: exactly A-Z
    while at < len(text):
        gap = _GAP.search(text, at + TEXT_STEP)
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text, at, end)
        at = end


def _lists(owner: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """A list per owner 0..n-1 of each of `values`, which `owner` (sorted) assigns."""
    offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def stripes(docs: DataFrame, groups: dict[tuple[bytes, bytes], int], languages: dict[bytes, int]) -> DataFrame:
    """(lang int, term binary, df, groups, counts) as folded, several rows a term: counts[i] of the term in source groups[i]."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, dict[int, Counter]] = {}
        df: dict[bytes, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, known in df.items():
                at = dict(zip(known, range(len(known)), strict=True))
                term = np.concatenate([np.fromiter(map(at.__getitem__, c), np.int64, len(c)) for c in counts[lang].values()])
                group = np.repeat(np.array(list(counts[lang]), np.int32), list(map(len, counts[lang].values())))
                count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counts[lang].values()])
                order = np.argsort(term, kind="stable")
                lists = _lists(term[order], len(known), group[order], count[order])
                columns = [pa.array(np.full(len(known), languages[lang], np.int32)), pa.array(list(known), pa.binary()), pa.array(list(known.values()), pa.int64()), *lists]
                yield from pa.Table.from_arrays(columns, ["lang", "term", "df", "groups", "counts"]).to_batches(max_chunksize=10_000)
            counts.clear(), df.clear()

        for batch in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: set[bytes] = set()
                group = counts.setdefault(lang, {}).setdefault(groups[lang, source], Counter())
                for found in terms(text):
                    group.update(found)
                    seen.update(found)
                df.setdefault(lang, Counter()).update(seen)
            if sum(len(c) for by in counts.values() for c in by.values()) > STRIPE_ENTRIES:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang int, term binary, df long, groups array<int>, counts array<long>")


def merged(folded: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One stripe a (language, term) that enough documents have; sorted rows of one term are merged as they come."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["lang", "term", "df", "groups", "counts"], None

        def merge(part: pa.Table) -> pa.Table:
            lang, term, df, groups, counts = (part.column(n).combine_chunks() for n in names)
            first = np.ones(len(term), bool)
            same = pc.and_(pc.equal(term[1:], term[:-1]), pc.equal(lang[1:], lang[:-1]))
            first[1:] = ~same.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(first)
            run_of = np.repeat(first.cumsum() - 1, pc.list_value_length(groups).to_numpy())
            group, count = groups.flatten().to_numpy(), counts.flatten().to_numpy()
            order = np.lexsort([group, run_of])
            run_of, group, count = run_of[order], group[order], count[order]
            new = np.ones(len(group), bool)
            new[1:] = (np.diff(run_of) != 0) | (np.diff(group) != 0)
            at = np.flatnonzero(new)
            lists = _lists(run_of[at], len(starts), group[at], np.add.reduceat(count, at))
            columns = [lang.take(pa.array(starts)), term.take(pa.array(starts)), pa.array(np.add.reduceat(df.to_numpy(), starts)), *lists]
            return pa.Table.from_arrays(columns, names)

        def kept(part: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from part.filter(pc.greater_equal(part.column("df"), min_documents)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch]).select(names)
            part = merge(part if held is None else pa.concat_tables([held, part.cast(held.schema)]))
            held = part.slice(part.num_rows - 1)  # its term may go on in the next batch
            yield from kept(part.slice(0, part.num_rows - 1))
        if held is not None:
            yield from kept(held)

    dealt = folded.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang int, term binary, df long, groups array<int>, counts array<long>")


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly, for 0 <= count < total < 2**53."""
    if total < (1 << 63) // SCALE:
        return 1 + (count + 1) * SCALE // total
    value, rest = np.divmod(count + 1, total)
    for _ in range(3):  # long division, three decimal digits a step
        digits, rest = np.divmod(rest * 1000, total)
        value = value * 1000 + digits
    return 1 + value


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def divergences(kept: DataFrame, members: list[list[int]], totals: list[list[int]], sizes: list[int], top: int = TOP) -> DataFrame:
    """(group, other, term, value): of merged stripes, each task's sums for pairs of groups (term null) and largest terms
    (other null). members[l]: the groups of language l; totals[l]: their counts added up; sizes[l]: its kept terms.
    """
    blocks = [max(1, -(-len(m) * len(m) // PAIR_CELLS)) for m in members]
    slot = {g: i for m in members for i, g in enumerate(m)}
    slots = np.array([slot.get(g, 0) for g in range(max(slot, default=-1) + 1)], np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def rows(group, other, term, value) -> pa.RecordBatch:
            n = len(value)
            columns = [pa.array(group, pa.int32()), pa.nulls(n, pa.int32()) if other is None else pa.array(other, pa.int32()), pa.nulls(n, pa.binary()) if term is None else term, pa.array(value, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["group", "other", "term", "value"])

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, first), total in sums.items():
                m = np.array(members[lang], np.int32)
                mine = m[first : first + len(total)]
                yield rows(np.repeat(mine, len(m)), np.tile(m, len(mine)), None, total.ravel())
            sums.clear()

        widest = max(map(len, members))
        for batch in slices(batches, max(1, STEP_CELLS // widest)):
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 4)], 1)
            for lang, block in np.unique(keys, axis=0).tolist():
                part = batch.filter(pa.array((keys == [lang, block]).all(1)))
                m, n = members[lang], part.num_rows
                lists = part.column(2)
                row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
                count = np.zeros((n, len(m)), np.int64)
                count[row, slots[lists.flatten().to_numpy()]] = part.column(3).flatten().to_numpy()
                p = np.stack([share(count[:, i], totals[lang][i] + sizes[lang]) for i in range(len(m))], 1)
                wide = -(-len(m) // blocks[lang])
                first = block * wide
                mine = range(first, min(len(m), first + wide))
                if (lang, first) not in sums:
                    if sum(x.size for x in sums.values()) + len(mine) * len(m) > PAIR_CELLS:
                        yield from out()
                    sums[lang, first] = np.zeros((len(mine), len(m)), np.int64)
                total = sums[lang, first]
                q = share(count.sum(1), sum(totals[lang]) + sizes[lang])
                for i in mine:
                    total[i - first] += gain(p[:, i : i + 1], p).sum(0)
                    at = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
                    if not len(at):
                        continue
                    value = gain(p[at, i], q[at])
                    if len(at) > top:  # equal values stay
                        large = value >= np.partition(value, len(at) - top)[len(at) - top]
                        at, value = at[large], value[large]
                    yield rows(np.full(len(at), m[i], np.int32), None, part.column(1).take(pa.array(at)), value)
        yield from out()

    many = F.element_at(F.array(*map(F.lit, blocks)), F.col("lang") + 1)
    dealt = kept.select("lang", "term", "groups", "counts", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"))
    return dealt.mapInArrow(run, "group int, other int, term binary, value long")


def audit(docs: DataFrame, top: int = TOP, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank) of `docs` (text, lang, source), nulls read as ''.

    Each language keeps the terms of at least `min_documents` of its documents. With V kept terms, of which a source has
    N occurrences, a term's share is p = 1 + floor(10^9 * (count + 1) / (N + V)). Part `pair`: item is each other source
    of the language, value the sum of floor((p - q)^2 / q) over all kept terms, q the other's share. Part `term`: item is
    each kept term that the source has with p above the language's q, the `top` first ranks only. Ranks go from 1 by value
    downwards, equal values by the item's bytes. A source without terms has shares too; a language with one source has no
    pairs. Every row of `docs` is a document, repeated ones too. Long texts are folded in steps. Other columns are ignored;
    an empty table gives an empty result. Over MAX_GROUPS (language, source) groups raise ValueError.
    """
    spark = docs.sparkSession
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c) for c in ("text", "lang", "source")])
    found = read.groupBy("lang", "source").count().select("lang", "source").limit(MAX_GROUPS + 1).collect()
    if len(found) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of language and source")
    names = sorted((bytes(r["lang"]), bytes(r["source"])) for r in found)
    groups = dict(zip(names, range(len(names)), strict=True))
    languages = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in names}))}
    label = spark.createDataFrame([(g, languages[lang], lang, source) for (lang, source), g in groups.items()], "group int, l int, lang binary, source binary")
    label = label.select("group", "l", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    if not names:
        empty = "lang string, source string, part string, item string, value long, rank int"
        return spark.createDataFrame([], empty)
    kept = saved(merged(stripes(read, groups, languages), min_documents), "stripes")
    held = kept.select(F.explode(F.arrays_zip("groups", "counts")).alias("x")).groupBy("x.groups").agg(F.sum("x.counts").alias("n"))
    n = {r["groups"]: r["n"] for r in held.collect()}  # a row a group
    v = {r["lang"]: r["count"] for r in kept.groupBy("lang").count().collect()}
    members = [[g for (own, _), g in groups.items() if own == lang] for lang in languages]
    totals, sizes = [[n.get(g, 0) for g in m] for m in members], [v.get(i, 0) for i in range(len(languages))]
    values = saved(divergences(kept, members, totals, sizes, top), "divergences")
    label = F.broadcast(label)  # MAX_GROUPS rows at most
    other = label.select(F.col("group").alias("other"), "l", F.col("source").alias("item"))
    pairs = label.join(other, "l").where(F.col("group") != F.col("other"))  # the rows of the report itself
    sums = values.where(F.col("term").isNull()).groupBy("group", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["group", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    large = values.where(F.col("term").isNotNull()).join(label, "group")
    large = large.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    return pairs.union(large.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": query}
ORACLE_SQL = {
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
      FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.total + v.v) AS HUGEINT) AS p
      FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, CAST(1 + 1000000000::HUGEINT * (sum(p.n) + 1) // (any_value(l.total) + any_value(v.v)) AS HUGEINT) AS q
      FROM k JOIN p ON p.lang = k.lang AND p.term = k.term JOIN v ON v.lang = k.lang
      JOIN (SELECT lang, sum(total) AS total FROM s GROUP BY lang) l ON l.lang = k.lang GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (
  SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""
}
