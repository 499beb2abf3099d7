"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated.

The whole text of a document becomes a short row of statistics. Cosines of random projections of
that row approximate a Gaussian kernel, so that a linear fit on them is a kernel fit. Every task
sums its own part of the normal equations, per fold; the driver only solves small systems. Scores
of rows by a model that has not seen their fold give the isotonic calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.llm.batches import as_bytes, portions
from trawlkit.llm.common import MARK, lookup
from trawlkit.llm.word_hashes import LOWER, byte_table, word_hashes
from trawlkit.session import written_table

STATISTICS = f"{MARK}statistics"
# A text counts as good from this score on.
GOOD = 0.3
FEATURES, RIDGE, FOLDS = 300, 1e-3, 5
# Width of the kernel in standard deviations of a statistic, for each root of their number.
WIDTH = 1.0
# Standardised statistics end here, so that one odd text moves nothing far away.
REACH = 5.0
# Raw scores from -0.5 to 1.5 fall into so many bins for the calibration.
BINS = 2000
# Sums of tasks are added in so many portions first.
PORTIONS = 64

_PRINTABLE = bytes(range(33, 127))
CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digits": bytes(range(48, 58)),
    "blanks": b" \t\r\x0b\x0c",
    "line_ends": b"\n",
    "stops": b".?",
    "commas": b",;:",
    "shouts": b"!",
    "pipes": b"|",
    "quotes": b"'\"()-",
    "symbols": bytes(b for b in _PRINTABLE if not chr(b).isalnum() and b not in b".?,;:!|'\"()-"),
    "beyond_ascii": bytes(range(128, 256)),
}
_CLASS_TABLE = np.stack([byte_table(members) for members in CLASSES.values()], axis=1).astype(float)
_LINE_END = byte_table(b"\n")
NAMES = (
    *CLASSES, "empty", "log_bytes", "entropy", "upper_of_letters", "word_length", "word_spread", "distinct_words", "commonest_word",
    "distinct_pairs", "distinct_fives", "distinct_lines", "log_line_words",
)


def _distinct_share(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: distinct hashes by all, and the share of the commonest."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    times = np.diff(np.append(at, len(h)))
    total = np.maximum(np.bincount(owner, minlength=n), 1)
    most = np.zeros(n)
    np.maximum.at(most, o[at], times)
    return np.bincount(o[at], minlength=n) / total, most / total


def _runs(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of so many words within a text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0], owner[:0]
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    whole = owner[:n] == owner[size - 1 :]
    return mixed[whole], owner[:n][whole]


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES per text, all zero but `empty` for an empty one."""
    n = len(texts)
    lengths = np.fromiter((len(t) for t in texts), np.int64, n)
    codes = np.frombuffer(b"".join(texts), np.uint8)
    text_of = np.repeat(np.arange(n), lengths)
    bytes_of = np.bincount(text_of * 256 + codes, minlength=n * 256).reshape(n, 256)
    some = np.maximum(lengths, 1)
    classes = bytes_of @ _CLASS_TABLE
    share = bytes_of / some[:, None]
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
    letters = classes[:, 0] + classes[:, 1]
    words, owner = word_hashes(texts)
    n_words = np.bincount(owner, minlength=n)
    joined = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)] > 32
    starts = np.flatnonzero(joined & ~np.concatenate([[False], joined[:-1]]))
    stops = np.flatnonzero(~joined & np.concatenate([[False], joined[:-1]]))
    word_of = np.searchsorted(np.cumsum(lengths + 1) - 1, starts)
    long = (stops - starts).astype(float)
    count = np.maximum(np.bincount(word_of, minlength=n), 1)
    mean = np.bincount(word_of, weights=long, minlength=n) / count
    spread = np.sqrt(np.maximum(np.bincount(word_of, weights=long * long, minlength=n) / count - mean * mean, 0))
    distinct, most = _distinct_share(words, owner, n)
    pairs, _ = _distinct_share(*_runs(words, owner, 2), n)
    fives, _ = _distinct_share(*_runs(words, owner, 5), n)
    lines, line_of = word_hashes(texts, _LINE_END)
    line_share, _ = _distinct_share(lines, line_of, n)
    n_lines = np.maximum(np.bincount(line_of, minlength=n), 1)
    rest = [lengths == 0, np.log1p(lengths), entropy, classes[:, 0] / np.maximum(letters, 1), mean, spread, distinct, most, pairs, fives, line_share, np.log1p(n_words / n_lines)]
    return np.concatenate([classes / some[:, None], np.stack(rest, axis=1).astype(float)], axis=1)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees. A null id is none of them, and has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows without their text, with a column of statistics of the whole text instead (null: empty)."""
    kept = [c for c in docs.columns if c not in (text, STATISTICS)]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(STATISTICS, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            rows = statistics(as_bytes(batch.column(batch.schema.get_field_index(text))))
            edges = pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32())
            lists = pa.ListArray.from_arrays(edges, pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], lists], names=[*kept, STATISTICS])

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text]]).mapInArrow(run, schema)


@dataclass(frozen=True)
class Space:
    """Statistics to random Fourier features."""

    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        standard = np.clip((rows - self.mean) / self.deviation, -REACH, REACH)
        waves = np.cos(standard @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(rows), 1))], axis=1)


@dataclass(frozen=True)
class Model:
    space: Space
    weights: np.ndarray
    raw: np.ndarray  # raw scores and the shares of good texts there, both ascending
    share: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.space.features(rows) @ self.weights, self.raw, self.share)


def _space(described: DataFrame, seed: int) -> Space:
    """Means and deviations over all documents, and fixed random directions."""
    place = [F.element_at(STATISTICS, i + 1) for i in range(len(NAMES))]
    found = described.select([f(x) for x in place for f in (F.avg, F.stddev_pop)]).first()
    numbers = np.array([x or 0.0 for x in found]).reshape(-1, 2)
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / (WIDTH * np.sqrt(len(NAMES))), (len(NAMES), FEATURES))
    return Space(numbers[:, 0], np.maximum(numbers[:, 1], 1e-9), directions, rng.uniform(0, 2 * np.pi, FEATURES))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def normal_equations(labelled: DataFrame, space: Space) -> np.ndarray:
    """Per fold Z'Z with Z'y as last column: summed within tasks, then over them."""
    shared = labelled.sparkSession.sparkContext.broadcast(space)
    size = FEATURES + 1

    def add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = shared.value.features(_matrix(batch.column(STATISTICS)))
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("quality", "fold"))
            for k in np.unique(fold):
                mine = z[fold == k]
                sums[k] += mine.T @ np.concatenate([mine, y[fold == k, None]], axis=1)
        task = TaskContext.get().partitionId()
        for k in np.flatnonzero(sums[:, -1, -2]):  # folds with rows
            edges = pa.array(np.arange(size + 1) * (size + 1), pa.int32())
            columns = [pa.array([task % PORTIONS] * size, pa.int32()), pa.array([task] * size, pa.int32()), pa.array([k] * size, pa.int32()), pa.array(np.arange(size), pa.int32()), pa.ListArray.from_arrays(edges, pa.array(sums[k].ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["portion", "task", "fold", "place", "sums"])

    def add_tasks(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # floating sums depend on their order
        rows = table.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        total = rows.sum(axis=0)
        one = {c: [table.column(c)[0].as_py()] for c in ("portion", "task", "fold", "place")}
        return pa.table({**one, "sums": [total.tolist()]}, schema=table.schema)

    schema = "portion int, task int, fold int, place int, sums array<double>"
    partial = labelled.select(STATISTICS, "quality", "fold").mapInArrow(add_rows, schema)
    partial = partial.groupBy("portion", "fold", "place").applyInArrow(add_tasks, schema)
    found = partial.groupBy("fold", "place").applyInArrow(add_tasks, schema).toArrow().to_pydict()
    sums = np.zeros((FOLDS, size, size + 1))
    for k, place, row in zip(found["fold"], found["place"], found["sums"], strict=True):
        sums[k, place] = row
    return sums


def solve(sums: np.ndarray) -> np.ndarray:
    """Ridge weights; the last feature, the constant, is not shrunk."""
    n = sums[-1, -2]
    shrink = np.eye(len(sums)) * RIDGE * max(n, 1)
    shrink[-1, -1] = 1e-9
    return np.linalg.solve(sums[:, :-1] + shrink / len(sums), sums[:, -1])


def isotonic(raw: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending raw scores and the non-descending shares of good there."""
    blocks: list[list[float]] = []  # weight, weighted raw, good
    for x, g, n in zip(raw.tolist(), good.tolist(), total.tolist(), strict=True):
        blocks.append([n, n * x, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[1] / b[0] for b in blocks]), np.array([b[2] / b[0] for b in blocks])


def _calibration(labelled: DataFrame, space: Space, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From scores of each fold by the model of the other folds, counted in bins."""
    shared = labelled.sparkSession.sparkContext.broadcast((space, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, by_fold = shared.value
        good, total = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("quality", "fold"))
            raw = (own.features(_matrix(batch.column(STATISTICS))) * by_fold[fold]).sum(axis=1)
            bin_of = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            good += np.bincount(bin_of, weights=y, minlength=BINS).astype(np.int64)
            total += np.bincount(bin_of, minlength=BINS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(good[used]), pa.array(total[used])], names=["bin", "good", "total"])

    counted = labelled.select(STATISTICS, "quality", "fold").mapInArrow(run, "bin int, good long, total long")
    rows = sorted(tuple(r) for r in counted.groupBy("bin").agg(F.sum("good"), F.sum("total")).collect())
    bins, good, total = np.array(rows, float).T
    return isotonic((bins + 0.5) / BINS * 2 - 0.5, good, total)


def train(described: DataFrame, labels: DataFrame, doc_id: str = "doc_id", seed: int = 13) -> Model | None:
    """A model from all labelled rows outside the held-out part; described comes from describe().

    labels has the id and quality. Qualities other than 0 and 1 are no labels; a document labelled
    twice counts twice, with either label. None if no row is labelled.
    """
    known = labels.select(lookup(labels, doc_id).alias(doc_id), F.col("quality").cast("double").alias("quality"))
    known = known.where(F.col("quality").isin(0.0, 1.0) & ~held_out(F.col(doc_id)))
    narrow = described.select(lookup(described, doc_id).alias(doc_id), STATISTICS)
    fold = F.pmod(F.xxhash64(F.lit(29), F.col(doc_id).cast("string")), F.lit(FOLDS)).cast("int").alias("fold")
    labelled = written_table(narrow.join(known, doc_id).select(STATISTICS, "quality", fold), "labelled")
    space = _space(described, seed)
    sums = normal_equations(labelled, space)
    whole = sums.sum(axis=0)
    if not whole[-1, -2]:
        return None
    others = np.stack([solve(whole - own) if (whole - own)[-1, -2] else solve(whole) for own in sums])
    return Model(space, solve(whole), *_calibration(labelled, space, others))


def score(described: DataFrame, model: Model | None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from GOOD on); without a model the score is 0.5.

    Own columns of these names give way. Equal texts get equal scores.
    """
    outputs = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    kept = [c for c in described.columns if c.lower() not in outputs]
    rest = [c for c in kept if c != STATISTICS]
    if model is None:
        return described.select(*[F.col(f"`{c}`") for c in rest], F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    schema = T.StructType([*[described.schema[c] for c in rest], *[T.StructField(c, kind) for c, kind in outputs.items()]])
    shared = described.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.clip(shared.value.score(_matrix(batch.column(batch.schema.get_field_index(STATISTICS)))), 0, 1)
            made = [pa.array(found), pa.array((found >= GOOD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], *made], names=[*rest, *outputs])

    return described.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
