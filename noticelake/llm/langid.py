"""Operator 3: language identification by multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader under elastic-net penalties on a bounded sample, with
document frequencies over all documents that may be learned from, then temperature-calibrated on a part
of the sample that the weights haven't seen.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn, free_name, held_out, saved, table
from .ftrl import FTRL, softmax, temperature

FEATURES = 1 << 15
NGRAMS = (1, 2, 3)
#: The weights are fitted on so many labelled documents at most, as many of each language as there are, and on
#: so many feature values in all: what the driver holds is bounded, whatever the documents' length.
TRAIN_ROWS, TRAIN_VALUES = 3000, 30_000_000
EPOCHS = 3
MAX_LANGUAGES = 1000
#: `reject` drops documents whose best language has less than this probability.
MIN_SCORE = 0.3
UNDETERMINED = "und"


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature indices, counts) of the hashed character n-grams of a whole text."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint32)
    hashes, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        if n in NGRAMS:
            hashes.append((h + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(17))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = np.bincount(np.concatenate(hashes), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: str | None) -> bool:
    """Whether the text has a character of Unicode's category L; numerals such as ½ aren't."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        at, counts = ngram_counts(text)
        p = softmax(self.vector(at, counts) @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many of the rows have each feature; counted by tasks, FEATURES rows at most come to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[ngram_counts(text)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["feature", "df"])

    got = docs.select("text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(FEATURES)
    df[got["feature"].to_numpy()] = got["df"].to_numpy()
    return df


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS, train_values: int = TRAIN_VALUES) -> Model:
    """A model of the rows (text, lang) whose lang isn't null and whose text has a letter.

    Other columns only tell equal texts apart when the sample is drawn.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0), np.float32))
    languages, rows = [r["lang"] for r in counts], sum(r["count"] for r in counts)
    idf = np.log((1 + rows) / (1 + document_frequencies(labelled))) + 1
    each = max(2, train_rows // len(languages))
    known = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], r["count"])]), F.col("lang"))
    few = drawn(labelled, known, each).select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    sample = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("rank") <= each)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([a.astype(np.int32) for a, _ in found]), pa.array([c.astype(np.int32) for _, c in found])],
                ["lang", "rank", "at", "counts"],
            )

    found = sample.select("text", "lang", "rank").mapInArrow(run, "lang string, rank int, at array<int>, counts array<int>")
    found = saved(found, "examples")
    sizes = found.groupBy("rank").agg(F.sum(F.size("at")).alias("n")).toArrow().sort_by("rank")  # train_rows rows at most
    last = max(2, int((np.cumsum(sizes["n"].to_numpy()) <= train_values).sum()))
    got = found.where(F.col("rank") <= last).toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    model = Model(languages, idf, np.zeros((FEATURES, len(languages)), np.float32))
    examples = []
    for a, c in zip(got["at"], got["counts"], strict=True):
        at = a.values.to_numpy()
        examples.append((at, model.vector(at, c.values.to_numpy())))
    label = np.array([languages.index(x) for x in got["lang"].to_pylist()])
    late = got["rank"].to_numpy() % 5 == 0  # kept for the temperature
    targets = np.eye(len(languages))[label]
    fit = np.flatnonzero(~late)
    model.weights = FTRL(FEATURES, len(languages)).fit([examples[i] for i in fit], targets[fit], epochs)
    scores = np.array([examples[i][1] @ model.weights[examples[i][0]] for i in np.flatnonzero(late)]).reshape(-1, len(languages))
    model.temperature = temperature(scores, label[late])
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (text, any others) with lang_pred and score, the calibrated probability of that language.

    A null text, one without a letter, or a model that has learned no language gives `und` and 0. Equal
    probabilities go to the first language by name. Long texts count whole; repeated rows give repeated results;
    an empty table gives an empty result. Columns lang_pred and score of `docs` are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages weights at most
    column = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(column).to_pylist()]
            new = [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def reject(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs`, their columns as they are, that have a language with at least `min_score`."""
    own = {c: free_name(c, [*docs.columns, "lang_pred", "score"]) for c in docs.columns if c.lower() in ("lang_pred", "score")}
    told = identify(docs.withColumnsRenamed(own), model)
    kept = told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({new: old for old, new in own.items()})


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = identify(docs.select("doc_id", "text"), train(learnable(docs)))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_langid": query}
ORACLE_SQL: dict[str, str] = {}
