"""Operator 8: a quality score by hashed word n-gram logistic regression.

Two families of n-grams are hashed into one space: single words and pairs, and one to three shapes of words (which kinds
of characters a word has, and whether it repeats the word before), which also cover words never seen.
Trained with follow-the-regularised-leader updates on a bounded sample; scored as a sparse dot product.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn, held_out, saved, table
from .ftrl import FTRL, Example

FEATURES = 1 << 18
#: The weights are fitted on so many labelled documents at most, and on so many feature values in all: what the
#: driver holds is bounded, whatever the documents' length.
TRAIN_ROWS, TRAIN_VALUES = 8000, 30_000_000
EPOCHS = 3
THRESHOLD = 0.7
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bits: lower case or beyond ASCII, upper case, digit, sentence mark, other mark.
_KIND = np.full(256, 16, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 8
_POWERS = np.cumprod(np.full(256, 1099511628211, np.uint64), dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _family(grams: list[np.ndarray], salt: int) -> Example:
    """Hashed n-grams with square roots of their counts, of length 1 in all."""
    mixed = [(g + np.uint64(salt + i)) * _M1 for i, g in enumerate(grams) if len(g)]
    if not mixed:
        return np.zeros(0, np.int64), np.zeros(0)
    at, counts = np.unique(np.concatenate(mixed) >> np.uint64(64 - 18), return_counts=True)
    return at.astype(np.int64), np.sqrt(counts / counts.sum())


def features(text: str | None) -> Example:
    """Feature indices and values of a whole text; index 0 is a constant."""
    b = np.frombuffer((text or "").encode(), np.uint8)
    inside = ~_BLANK[b]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(1, np.int64), np.ones(1)
    place = np.arange(len(b)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(b)]))
    value = np.where(inside, (b.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255], np.uint64(0))
    word = np.add.reduceat(value, starts)
    shape = np.bitwise_or.reduceat(np.where(inside, _KIND[b], np.uint8(0)), starts).astype(np.uint64)
    same = np.r_[False, word[1:] == word[:-1]]
    shape = (shape + np.where(same, np.uint64(64), np.uint64(0)) + np.uint64(1)) * _M2
    pairs = word[:-1] * _M3 + word[1:]
    shapes = [shape, shape[:-1] * _M3 + shape[1:], (shape[:-2] * _M3 + shape[1:-1]) * _M3 + shape[2:]]
    families = [_family([word, pairs], 11), _family(shapes, 101)]
    at = np.concatenate([[0], *(a for a, _ in families)])
    values = np.concatenate([[1.0], *(v for _, v in families)])
    at, back = np.unique(at, return_inverse=True)
    return at, np.bincount(back, values)


@dataclass
class Model:
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        at, values = features(text)
        return float(1 / (1 + np.exp(-np.clip(values @ self.weights[at], -35, 35))))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS, train_values: int = TRAIN_VALUES) -> np.ndarray:
    """Weights learned from the rows (text, quality 0/1) of smallest hash; other labels are left out.

    Rows count until one would bring the feature values over `train_values`. Equal rows count each; an empty
    table gives weights of zero, and any text the score one half.
    """
    rows = labelled.select("text", "quality").where(F.col("quality").isin(0, 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([a.astype(np.int32) for a, _ in found]), pa.array([v.astype(np.float32) for _, v in found])],
                ["quality", "h", "at", "values"],
            )

    hashed = rows.withColumn("h", F.xxhash64("text", "quality"))
    kind = labelled.schema["quality"].dataType.simpleString()
    found = saved(drawn(hashed, F.lit(hashed.count()), train_rows).mapInArrow(run, f"quality {kind}, h long, at array<int>, values array<float>"), "examples")
    sizes = found.select("h", F.size("at").alias("n")).orderBy("h").limit(train_rows).toArrow()  # narrow rows
    fit = int((np.cumsum(sizes["n"].to_numpy()) <= train_values).sum())
    last = sizes["h"][fit - 1].as_py() if fit else -(1 << 63)
    got = found.where(F.col("h") <= last).toArrow().sort_by("h")
    examples = [(a.values.to_numpy(), v.values.to_numpy().astype(float)) for a, v in zip(got["at"], got["values"], strict=True)]
    return FTRL(FEATURES, 1, l1=0.02).fit(examples, got["quality"].to_numpy().reshape(-1, 1).astype(float), epochs)[:, 0]


def rate(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """`docs` (text, any others) with score: the probability of quality 1, also for null and empty texts.

    A column score of `docs` is replaced. Long texts count whole; repeated rows give repeated results; an empty
    table gives an empty result.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(Model(weights))  # FEATURES weights
    column = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([shared.value.score(t) for t in batch.column(column).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, quality) of up to `train_rows` labelled documents that may be learned from.

    Labels are drawn by a hash of doc_id before any text is read. A document with several labels counts
    with its smallest.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = drawn(known, F.lit(known.count()), train_rows)
    first = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # train_rows rows: small enough to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("text", "quality")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = rate(docs.select("doc_id", "text"), weights)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


QUERIES = {"op8_quality": query}
ORACLE_SQL: dict[str, str] = {}
