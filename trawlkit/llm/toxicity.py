"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = logistic(threshold_j - w.x): one weight per feature is shared by all ordered
thresholds. Features are the distinct words of a text, hashed. The result is the expected severity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.llm.batches import as_bytes, portions
from trawlkit.llm.common import MARK, lookup, sampled
from trawlkit.llm.word_hashes import byte_table, word_hashes

FEATURE_BITS = 20
# Expected number of labelled rows per grade that training sees: the bound of the sample.
SAMPLE_PER_GRADE = 4000
# A feature must occur in so many texts of the sample, and be so many standard errors more or less
# frequent above some threshold than below it.
LEAST_TEXTS, LEAST_DEVIATION = 4, 4.5
EPOCHS, RATE, SHRINK = 12, 0.3, 2e-4
# A text counts as toxic where the chance of the highest grade is at least this.
TOXIC_CHANCE = 0.5

# ASCII bytes that are neither letters nor digits part words.
ENDS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: bucket and text number, by text."""
    hashes, owner = word_hashes(texts, ENDS)
    pair = np.unique((owner.astype(np.int64) << FEATURE_BITS) | (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    return pair & ((1 << FEATURE_BITS) - 1), pair >> FEATURE_BITS


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, score: np.ndarray) -> np.ndarray:
        """A column per grade."""
        upto = logistic(self.thresholds[None, :] - score[:, None])
        return np.diff(np.concatenate([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))], axis=1), axis=1)


def telling(rows: list[tuple[np.ndarray, int]], grades: int) -> np.ndarray:
    """Which features tell the grades on some side of a threshold apart."""
    counts = np.stack([np.bincount(np.concatenate([i for i, g in rows if g == k] or [np.zeros(0, np.int64)]), minlength=1 << FEATURE_BITS) for k in range(grades)])
    texts = np.bincount([g for _, g in rows], minlength=grades)
    kept = np.zeros(1 << FEATURE_BITS, bool)
    for j in range(1, grades):
        low, high = texts[:j].sum(), texts[j:].sum()
        if low and high:
            p = counts.sum(axis=0) / (low + high)
            error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / low + 1 / high))
            kept |= np.abs(counts[j:].sum(axis=0) / high - counts[:j].sum(axis=0) / low) >= LEAST_DEVIATION * error
    return kept & (counts.sum(axis=0) >= LEAST_TEXTS)


def fit(rows: list[tuple[np.ndarray, int]], weights: np.ndarray, grades: int, seed: int = 5) -> Model:
    """Adaptive gradient descent on the likelihood with an absolute-value penalty.

    rows are (features, grade); weights say how many rows of the table each grade's rows stand for.
    """
    kept = telling(rows, grades)
    rows = [(ids[kept[ids]], grade) for ids, grade in rows]
    w, squares = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-2)
    share = np.cumsum(weights)[:-1] / weights.sum()
    theta = np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))
    theta_squares = np.full(grades - 1, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, grade = rows[k]
            score = w[ids].sum()
            upper = logistic(theta[grade] - score) if grade < grades - 1 else 1.0
            lower = logistic(theta[grade - 1] - score) if grade else 0.0
            # Derivatives of -log(upper - lower); upper (1 - upper) and lower (1 - lower) are the slopes.
            gap = max(upper - lower, 1e-9)
            up, low = upper * (1 - upper) / gap, lower * (1 - lower) / gap
            back = up - low
            squares[ids] += back * back
            step = RATE / np.sqrt(squares[ids])
            moved = w[ids] - step * back
            w[ids] = np.sign(moved) * np.maximum(np.abs(moved) - step * SHRINK, 0)
            for j, slope in ((grade, -up), (grade - 1, low)):
                if 0 <= j < grades - 1:
                    theta_squares[j] += slope * slope
                    theta[j] -= RATE / np.sqrt(theta_squares[j]) * slope
            theta = np.maximum.accumulate(theta)
    return Model(w, theta)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        found, owner = features(as_bytes(batch.column("text")))
        edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), lists], names=["doc_id", "grade", "ids"])


def train(docs: DataFrame, grades: DataFrame, n_grades: int, per_grade: int = SAMPLE_PER_GRADE) -> Model | None:
    """A model from about per_grade rows of each grade, chosen by a hash of the id.

    docs has doc_id and text, grades has doc_id and grade (0 to n_grades - 1). The sample is the
    only data that reaches the driver. Other grades are none; of several grades of one id the
    highest counts. None if no row is graded.
    """
    known = grades.where(F.col("grade").between(0, n_grades - 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    sizes = {r[0]: r[1] for r in known.groupBy("grade").agg(F.count("*")).collect()}
    if not sizes:
        return None
    chosen = known.where(sampled(F.col("doc_id"), F.col("grade"), sizes, per_grade))
    sample = docs.select(lookup(docs, "doc_id").cast("long").alias("doc_id"), F.col("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = sample.select("doc_id", "grade", "text").mapInArrow(_sample_features, "doc_id long, grade int, ids array<int>").toArrow().to_pylist()
    rows = sorted(((r["doc_id"], r["grade"], r["ids"]) for r in rows), key=lambda r: (r[0], r[1], r[2]))
    if not rows:
        return None
    return fit([(np.array(ids, np.int64), grade) for _, grade, ids in rows], np.array([sizes.get(g, 0) for g in range(n_grades)], float), n_grades)


def grade_labels(labels: DataFrame) -> DataFrame:
    """Grades of severity from labels: 2 for toxic, 1 for poor quality that is not toxic, else 0."""
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("toxic") == 0, 0)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds severity (expected grade), grade (the likeliest), chance_toxic and toxic to every row.

    The whole text is read; null and empty texts have no features and get the severity of the base
    rates. Without a model the severity is null and nothing is toxic. Own columns of these names
    give way.
    """
    outputs = {"severity": T.DoubleType(), "grade": T.IntegerType(), "chance_toxic": T.DoubleType(), "toxic": T.BooleanType()}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in outputs])
    kept = [c for c in docs.columns if keep_text or c != text]
    if model is None:
        nothing: dict[str, Column] = {c: F.lit(None).cast(kind) for c, kind in outputs.items()}
        return docs.select(*[F.col(f"`{c}`") for c in kept], *[(F.lit(False) if c == "toxic" else v).alias(c) for c, v in nothing.items()])
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, kind) for c, kind in outputs.items()]])
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, thresholds = shared.value
        weights = np.zeros(1 << FEATURE_BITS)
        weights[places] = values
        own = Model(weights, thresholds)
        for batch in portions(batches, text):
            found, owner = features(as_bytes(batch.column(batch.schema.get_field_index(text))))
            score = np.bincount(owner, weights=weights[found], minlength=batch.num_rows)
            chance = own.chances(score)
            severity = chance @ np.arange(chance.shape[1])
            made = [pa.array(severity), pa.array(chance.argmax(axis=1), pa.int32()), pa.array(chance[:, -1]), pa.array(chance[:, -1] >= TOXIC_CHANCE)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names=[*kept, *outputs])

    return docs.mapInArrow(run, schema)
