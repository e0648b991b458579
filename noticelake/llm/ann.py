"""Operator 5: nearest neighbours by score-aware (anisotropic) product quantisation.

A unit vector is coded as its coarse centre, the length of what is left, and the direction of that in four bits for
each subspace; a factor makes the code's product with the vector one. Codebooks and codes minimise a loss in which the residual along the vector, which changes large inner
products, weighs more than the residual across it. The index is dealt to shards by a hash, each vector once; queries
go to every shard. There look-ups over the codes choose a short list, and only its exact cosines are taken. As shards
are drawn by a hash, each holds about its share of the best candidates of any query, so short lists of a share each,
and a margin for chance, make up the short list of the whole index. Vectors of one direction are indexed once, with
their smallest ids.
"""

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_apart, saved, slices, table

K = 5
CENTRES = 16
#: Dimensions of a subspace.
SUBSPACE = 2
#: Codebooks are fitted on so many vectors at most.
TRAIN_ROWS = 8192
ROUNDS = 6
#: Inner products over this share of the vector's length are those whose error matters.
THRESHOLD = 0.2
#: Coarse centres, fitted on the same sample.
CELLS = 64
#: Exact cosines a query, over the whole index: this many, or twice the root of the index's size if that is more.
CANDIDATES = 300
#: A shard has about so many bytes of vectors at most, and about so many rows at least.
SHARD_BYTES, SHARD_ROWS = 64 << 20, 4096
#: Shards are made smaller than SHARD_BYTES until there are so many.
SHARDS = 64
#: Queries whose look-up tables are made together.
TOGETHER = 256


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel residual, against 1 for the orthogonal one."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


@dataclass
class Codebook:
    """cells: coarse centres; centres: subspaces x CENTRES x SUBSPACE, of the directions that residuals have.

    Vectors are padded with zeros to whole subspaces.
    """

    cells: np.ndarray
    centres: np.ndarray
    weight: float

    def parts(self, x: np.ndarray) -> np.ndarray:
        m, _, s = self.centres.shape
        return np.pad(x, ((0, 0), (0, m * s - x.shape[1]))).reshape(len(x), m, s)

    def residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: the coarse cell, the length of the residual and its direction."""
        cell = (x @ self.cells.T - (self.cells**2).sum(1) / 2).argmax(1)
        left = x - self.cells[cell]
        scale = np.sqrt((left * left).sum(1))
        return cell, scale, left / np.where(scale > 0, scale, 1)[:, None]

    def encode(self, x: np.ndarray, left: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes of residual directions (rows of left) of unit vectors x, by coordinate descent on the anisotropic loss."""
        p, u = self.parts(x), self.parts(left)
        across = ((u[:, :, None, :] - self.centres[None]) ** 2).sum(-1)  # n x m x CENTRES
        along = ((u[:, :, None, :] - self.centres[None]) * p[:, :, None, :]).sum(-1)
        codes = across.argmin(-1)
        total = np.take_along_axis(along, codes[..., None], -1)[..., 0].sum(1)
        rows = np.arange(len(x))
        for _ in range(sweeps):
            for m in range(codes.shape[1]):
                rest = total - along[rows, m, codes[:, m]]
                loss = across[:, m] + (self.weight - 1) * (rest[:, None] + along[:, m]) ** 2
                codes[:, m] = loss.argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of unit vectors: codes, cell, factor and scale of the look-up factor * cell's product + scale * sum of the
        tables' places, and the length of the code's error.

        The factor takes the parallel residual that the code leaves to zero: vectors close to each other differ in
        their cosines by less than that residual.
        """
        cell, length, left = self.residuals(x)
        codes = self.encode(x, left)
        back = self.cells[cell] + length[:, None] * self.decode(codes).reshape(len(x), -1)[:, : x.shape[1]]
        along = (back * x).sum(1)
        factor = 1 / np.where(along > 0.5, along, 1.0)
        off = factor[:, None] * back - x
        return codes, cell.astype(np.int32), factor.astype(np.float32), (factor * length).astype(np.float32), np.sqrt((off * off).sum(1)).astype(np.float32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(codes.shape[1]), codes]

    def refit(self, x: np.ndarray, left: np.ndarray, codes: np.ndarray) -> None:
        """The centres of least loss for these codes: one linear system over all of them."""
        p, u, (m, k, s) = self.parts(x), self.parts(left), self.centres.shape
        system, right = np.zeros((m * k * s, m * k * s)), np.zeros(m * k * s)
        at = ((np.arange(m) * k + codes)[:, :, None] * s + np.arange(s)).reshape(len(x), -1)
        along = (u * p).sum((1, 2))
        for a in range(0, len(x), 1024):
            here = at[a : a + 1024]
            z = np.zeros((len(here), m * k * s))
            np.put_along_axis(z, here, p[a : a + 1024].reshape(len(z), -1), 1)
            system += (self.weight - 1) * (z.T @ z)
            right += (self.weight - 1) * (along[a : a + 1024] @ z)
        right += np.bincount(at.ravel(), u.reshape(len(x), -1).ravel(), m * k * s)
        system[np.diag_indices_from(system)] += np.bincount(at.ravel(), minlength=m * k * s) + 1e-6
        fitted = np.linalg.solve(system, right).reshape(m, k, s)
        used = np.bincount((np.arange(m) * k + codes).ravel(), minlength=m * k).reshape(m, k) > 0
        self.centres = np.where(used[..., None], fitted, self.centres)


def coarse(x: np.ndarray, cells: int = CELLS, rounds: int = 8) -> np.ndarray:
    """Centres of at most so many cells of unit vectors, by k-means; fewer, if there are not 64 vectors a cell."""
    cells = max(1, min(cells, len(x) // 64))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        at = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=cells)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def fit(x: np.ndarray, rounds: int = ROUNDS) -> Codebook:
    """A codebook for unit vectors, from a sample of them."""
    m = ceil(x.shape[1] / SUBSPACE)
    book = Codebook(coarse(x), np.zeros((m, CENTRES, SUBSPACE)), eta(x.shape[1]))
    _, _, left = book.residuals(x)
    book.centres = book.parts(left)[np.linspace(0, len(x) - 1, CENTRES).astype(int)].transpose(1, 0, 2).copy()
    for turn in range(rounds):
        book.refit(x, left, book.encode(x, left, 1 if turn < rounds - 1 else 3))
    return book


def matrix(batch: pa.Array) -> np.ndarray:
    """The vectors, each divided by a power of two so that no square overflows; cosines stay as they are."""
    x = np.stack([v.values.to_numpy(zero_copy_only=False) for v in batch]).astype(float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, direction, embedding), one row an id, of the rows that take part: id and vector not
    null, no null or non-finite component, not zero. Of several vectors under one id, the one of the smallest
    direction, then the smallest, counts. Divided by their largest component, multiples of one vector are equal to the last bit.
    """
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & fine & F.exists(e, lambda v: v != 0))
    largest = F.array_max(F.transform(e, lambda v: F.abs(v).cast("double")))
    turned = rows.withColumn("largest", largest).select("vec_id", F.transform(e, lambda v: v.cast("double") / F.col("largest")).alias("direction"), "embedding")
    return turned.groupBy("vec_id").agg(F.min(F.struct("direction", "embedding")).alias("v")).select("vec_id", "v.direction", "v.embedding")


@dataclass
class Shard:
    """Vectors with their ids and codes; codes have two places a byte."""

    book: Codebook
    ids: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    cell: np.ndarray
    factor: np.ndarray
    scale: np.ndarray
    error: np.ndarray

    def search(self, queries: np.ndarray, keep: int, candidates: int, exact: bool = False) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each query (a row) the `keep` largest cosines of a short list: indices and cosines, ties to the smaller
        id. And how many cosines were taken.

        The short list: the `candidates` best look-ups. With `exact`, all vectors whose look-up, with the length of their
        code's error, reaches the keep-th largest look-up less that length, so none of the largest cosines is missing.
        """
        turned = unit(queries)
        tables = np.einsum("qms,mks->qmk", self.book.parts(turned), self.book.centres).astype(np.float32)
        if tables.shape[1] % 2:
            tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
        base = (turned @ self.book.cells.T).astype(np.float32)
        columns = np.ascontiguousarray(self.codes.T)
        keep, first = min(keep, len(self.ids)), min(max(keep, candidates), len(self.ids))
        found, taken = [], 0
        for q, tab, cells in zip(queries, tables, base, strict=True):
            both = (tab[1::2, :, None] + tab[::2, None, :]).reshape(len(columns), 256)  # two four-bit codes in a byte
            total = both[0].take(columns[0])
            for i in range(1, len(columns)):
                total += both[i].take(columns[i])
            total = self.factor * cells.take(self.cell) + self.scale * total
            if exact:
                reach = self.error + np.float32(1e-4)  # and the rounding of look-ups
                at = np.flatnonzero(total + reach >= np.partition(total - reach, len(total) - keep)[len(total) - keep])
            else:
                at = np.argpartition(-total, first - 1)[:first]
            near = self.x[at].astype(float)
            score = (near * q).sum(1) / (np.sqrt((near * near).sum(1)) * sqrt((q * q).sum()))
            order = np.lexsort((self.ids[at], -score))[:keep]
            found.append((at[order], score[order]))
            taken += len(at)
        return found, taken


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def share(candidates: int, n: int, shards: int) -> int:
    """Length of a shard's short list, for so many candidates over an index of n vectors: its share and five deviations of it."""
    mean = max(candidates, isqrt(4 * n)) / shards
    return ceil(mean + 5 * sqrt(mean)) if shards > 1 else ceil(mean)


def shards_of(n: int, dim: int) -> int:
    return max(ceil(n * dim * 4 / SHARD_BYTES), min(SHARDS, ceil(n / SHARD_ROWS)))


COLUMNS = "shard int, kind int, id long, embedding {}, code binary, cell int, factor float, scale float, error float"


def coder(book: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds codes to batches of (shard, kind, id, embedding)."""

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            codes, *others = book.value.coded(unit(matrix(batch.column(3))))
            more = [pa.array([c.tobytes() for c in packed(codes)], pa.binary()), *map(pa.array, others)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "code", "cell", "factor", "scale", "error"])

    return coded


def scanner(book: Broadcast, keep: int, candidates: int, exact: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers queries from rows in the order of (shard, kind): a shard's vectors (0), which are kept, then its queries (1), which pass by."""

    def loaded(pieces: list[pa.RecordBatch]) -> Shard:
        def column(i: int) -> np.ndarray:
            return np.concatenate([p.column(i).to_numpy() for p in pieces])

        codes = np.concatenate([np.frombuffer(b"".join(p.column(4).to_pylist()), np.uint8).reshape(p.num_rows, -1) for p in pieces])
        plain = pieces[0].column(3).type.value_type
        x = [matrix(p.column(3)) for p in pieces]
        return Shard(book.value, column(2), np.concatenate([v.astype(np.float32) if plain == pa.float32() else v for v in x]), codes, *map(column, (5, 6, 7, 8)))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces, shard = -1, [], None
        for batch in slices(batches, TOGETHER):
            place = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                number, kind = divmod(int(place[a]), 2)
                if number != current:
                    current, pieces, shard = number, [], None
                run = batch.slice(a, b - a)
                if kind == 0:
                    pieces.append(run)
                    continue
                if pieces:
                    shard, pieces = loaded(pieces), []
                if shard is None:
                    continue
                found, taken = shard.search(matrix(run.column(3)), keep, candidates, exact)
                sizes = [len(at) for at, _ in found]
                asker = np.repeat(run.column(2).to_numpy(), sizes)
                near = shard.ids[np.concatenate([at for at, _ in found])]
                score = np.concatenate([s for _, s in found])
                yield pa.RecordBatch.from_arrays([pa.array(asker), pa.array(near), pa.array(score)], ["q", "c", "score"])

    return scan


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, candidates: int = CANDIDATES, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines found for each row of `queries` among `vectors`.

    Both have vec_id and embedding; rows that `usable` leaves out take no part, as queries or candidates. Vectors of
    another dimension have no cosine with a query's: each dimension is searched for itself. A query's own id is no
    candidate. Ties (equal doubles) go to the smaller vec_id. Repeated rows count once, and an id with one vector (see
    `usable`). Fewer candidates than k give all of them; an empty table gives an empty result.

    For each query about max(candidates, 2 * sqrt(vectors)) exact cosines are taken, of the best look-ups over all codes.
    `exact` takes all that the codes' errors allow instead: the result is then that of all cosines.
    """
    spark = vectors.sparkSession
    rows = saved(usable(vectors).withColumn("dim", F.size("embedding")), "vectors")
    first = F.row_number().over(W.partitionBy("direction").orderBy("vec_id"))
    members = saved(rows.withColumn("n", first).where(F.col("n") <= k + 1), "members")  # of one direction, the smallest ids
    reps = members.where("n = 1").select(F.col("vec_id").alias("rep"), "direction")
    asked = saved(rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "direction"), "asked")
    total = asked.count()
    alike = reps.join(asked.groupBy("direction").agg(F.count("*").alias("n")), "direction")
    by_rep = saved(join_apart(asked, alike, "direction", total).select("query_id", F.col("rep").alias("q")), "queries")
    found = spark.createDataFrame([], "q long, c long, score double")
    for dim, n in sorted((r["dim"], r["count"]) for r in members.where("n = 1").groupBy("dim").count().collect()):  # as many as there are dimensions
        index = members.where((F.col("n") == 1) & (F.col("dim") == dim)).select(F.col("vec_id").alias("id"), "embedding")
        found = found.unionByName(searched(index, by_rep.select(F.col("q").alias("id")).distinct(), n, dim, k + 1, candidates, exact))
    near = W.partitionBy("q").orderBy(F.desc("score"), "c")
    top = found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).drop("n")
    ids = members.join(reps.withColumnRenamed("rep", "c"), "direction").groupBy("c").agg(F.collect_list("vec_id").alias("ids"))  # k + 1 at most
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("vec_id")))
    best = top.join(ids, "c").groupBy("q").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("best"))
    values = best.withColumn("best", F.slice("best", 1, k + 1)).join(by_rep.groupBy("q").agg(F.count("*").alias("n")), "q")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    answers = join_apart(by_rep, saved(values, "best"), "q", total).select("query_id", F.posexplode(others).alias("at", "b"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def searched(index: DataFrame, asking: DataFrame, n: int, dim: int, keep: int, candidates: int, exact: bool) -> DataFrame:
    """(q, c, score): of each shard the `keep` largest cosines found for the vectors of `index` (id, embedding; n of one dimension) that `asking` (id) names."""
    spark = index.sparkSession
    sample = index.orderBy(F.xxhash64("id")).limit(TRAIN_ROWS).select("embedding").toArrow()["embedding"].combine_chunks()
    book = spark.sparkContext.broadcast(fit(unit(matrix(sample))))  # 64 centres, and 16 a subspace
    shards = shards_of(n, dim)
    columns = COLUMNS.format(dict(index.dtypes)["embedding"])
    dealt = index.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "embedding")
    codes = dealt.mapInArrow(coder(book), columns)
    wanted = index.join(asking, "id").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "embedding")
    together = codes.unionByName(wanted, allowMissingColumns=True).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return together.mapInArrow(scanner(book, keep, share(candidates, n, shards), exact), "q long, c long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {"op5_ann": query}
ORACLE_SQL: dict[str, str] = {}
