"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's words are padded and cut into subwords of two to four characters, which hash to rows of
an embedding table. The average of the rows goes through a linear softmax. Trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows; scores are calibrated by a
temperature on rows kept back, and a text is rejected below a threshold set on those rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.llm.batches import portions
from trawlkit.llm.common import MARK, lookup, sampled

UNKNOWN = "und"
BUCKET_BITS = 16
DIMENSIONS = 16
SIZES = (2, 3, 4)
# Expected number of labelled rows per language that training sees: the bound of the sample.
SAMPLE_PER_LANGUAGE = 1000
# Words per training example drawn from a text, next to the whole text.
WINDOWS = (3, 8, 25)
WHOLE_WORDS = 400
EPOCHS, RATE = 4, 0.4
# Share of rows kept back that a rejection may cost.
REJECTED_SHARE = 0.0005

FOLD = f"{MARK}fold"


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees. A null id is none of them, and is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@cache
def letter_table() -> np.ndarray:
    """Per code point: 0 for what is no letter, else 1."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed subwords of all texts: buckets, text number of each, word number of each; letters per text.

    What is no letter ends a word. A word's ends are marked by a space, which counts as a character.
    """
    joined = "\n \n".join(t.lower() for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = letter_table()[codes]
    # Keep letters and the first of each run of others, so that every gap is one character.
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    lengths = np.array([len(t.lower()) + 3 for t in texts])
    text_of = np.repeat(np.arange(len(texts)), lengths)[: len(codes)]
    n_letters = np.bincount(text_of[letters], minlength=len(texts))
    codes, text_of, letters = np.where(letters, codes, 32)[keep], text_of[keep], letters[keep]
    n = len(codes)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, n_letters
    word_of = np.cumsum(~letters)
    ring = np.concatenate([[32], codes]).astype(np.uint64)  # a gap before the first word
    texts_at, words_at = text_of, word_of
    found, owner, word = [], [], []
    value = ring.copy()
    for size in range(2, max(SIZES) + 1):
        value = value[:-1] * np.uint64(1000003) + ring[size - 1 :] if len(ring) >= size else value[:0]
        if size not in SIZES or not len(value):
            continue
        # Start i covers ring[i : i + size]; all but its ends must be letters, and one end at least.
        inner = np.ones(len(value), bool)
        for k in range(1, size - 1):
            inner &= ring[k : k + len(value)] != 32
        inner &= (ring[: len(value)] != 32) | (ring[size - 1 :] != 32)
        at = np.flatnonzero(inner)
        mixed = (value[at] ^ np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        # ring[i] is codes[i - 1]; the second character decides whose word it is.
        owner.append(texts_at[np.minimum(at, n - 1)])
        word.append(words_at[np.minimum(at, n - 1)])
    return np.concatenate(found), np.concatenate(owner), np.concatenate(word), n_letters


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # embeddings, a row per bucket
    weights: np.ndarray  # of the softmax
    bias: np.ndarray
    temperature: float
    threshold: float

    def folded(self) -> np.ndarray:
        """Embeddings already multiplied by the weights: averaging and the linear layer commute."""
        return (self.table @ self.weights).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(examples: list[tuple[str, bool, np.ndarray, np.ndarray]], seed: int = 11) -> Model:
    """Train on (language, kept back, buckets, counts) and calibrate on those kept back."""
    languages = tuple(sorted({e[0] for e in examples}))
    place = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    learned = [e for e in examples if not e[1]] or examples
    steps, done = EPOCHS * len(learned), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(learned)):
            name, _, ids, counts = learned[k]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ table[ids]
            error = softmax(hidden @ weights + bias)
            error[place[name]] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            # Rows are as rare as their share, so the step is made larger by the number of rows.
            table[ids] -= rate * np.outer(share * min(len(ids), 20), back)
    kept = [e for e in examples if e[1]] or examples
    folded = table @ weights
    logits = np.stack([(e[3] / e[3].sum()) @ folded[e[2]] + bias for e in kept])
    truth = np.array([place[e[0]] for e in kept])
    grid = np.geomspace(0.02, 20, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = softmax(logits / temperature).max(axis=1)
    # What is hardly better than a guess is rejected, as long as that costs few of the rows kept back.
    least = float(min(np.quantile(sure, REJECTED_SHARE), 1.5 / len(languages)))
    return Model(languages, table, weights, bias, temperature, least)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Several examples per labelled row: windows of words at places the text's hash decides."""
    for batch in portions(batches, "text"):
        texts = batch.column("text").to_pylist()
        buckets, owner, word, _ = subwords(texts)
        order = np.lexsort((word, owner))
        buckets, owner, word = buckets[order], owner[order], word[order]
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        rows = []
        for i, (doc_id, lang, fold) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", FOLD)), strict=True)):
            mine, words = buckets[edges[i] : edges[i + 1]], word[edges[i] : edges[i + 1]]
            if not len(mine):
                continue
            rng = np.random.default_rng(abs(hash((doc_id, len(mine)))))
            first, last = int(words[0]), int(words[-1])
            for k, width in enumerate((WHOLE_WORDS, *WINDOWS)):
                start = int(rng.integers(first, max(first, last - width + 1) + 1))
                a, b = np.searchsorted(words, (start, start + width))
                if b > a:
                    ids, counts = np.unique(mine[a:b], return_counts=True)
                    rows.append({"doc_id": doc_id, "k": k, "lang": lang, "kept_back": fold == 0, "ids": ids, "counts": counts})
        yield pa.RecordBatch.from_pylist(rows, schema=EXAMPLES)


EXAMPLES = pa.schema([("doc_id", pa.int64()), ("k", pa.int32()), ("lang", pa.string()), ("kept_back", pa.bool_()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
EXAMPLE_SCHEMA = "doc_id long, k int, lang string, kept_back boolean, ids array<int>, counts array<int>"


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model from about per_language labelled rows of each language, chosen by a hash of the id.

    The sample is the only data that reaches the driver, and the number of languages times
    per_language bounds it. None if no row is labelled.
    """
    own = docs.select(lookup(docs, doc_id).cast("long").alias("doc_id"), lookup(docs, text).cast("string").alias("text"), lookup(docs, lang).cast("string").alias("lang"))
    labelled = own.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.count("*")).collect()}
    if not sizes:
        return None
    sample = labelled.where(F.col("text").isNotNull() & sampled(F.col("doc_id"), F.col("lang"), sizes, per_language))
    sample = sample.withColumn(FOLD, F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)))
    held = sample.mapInArrow(_examples, EXAMPLE_SCHEMA).toArrow().combine_chunks()
    if not held.num_rows:
        return None
    # Views of the collected arrays: a list of Python numbers would take many times their memory.
    ids, counts = (_lists(held.column(c)) for c in ("ids", "counts"))
    plain = zip(*(held.column(c).to_pylist() for c in ("doc_id", "k", "lang", "kept_back")), strict=True)
    rows = sorted(zip(plain, ids, counts, strict=True), key=lambda r: (*r[0][:3], r[1].tobytes()))
    return fit([(lang, kept_back, own, times) for (_, _, lang, kept_back), own, times in rows])


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of its values."""
    made = []
    for chunk in column.chunks:
        values, edges = chunk.values.to_numpy(), chunk.offsets.to_pylist()
        made += [values[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    return made


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected to every row, from the whole text.

    A text that is null or has no letter gives `und`, score 0 and a rejection, and so does every
    text if nothing was learned. Own columns of the output names give way. Ties go to the language
    whose name comes first. keep_text=False leaves the text out of the result, so that it is not
    sent back from the Python workers.
    """
    outputs = ("lang_pred", "score", "rejected")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in outputs])
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([*[docs.schema[c] for c in kept], *map(T.StructField, outputs, kinds)])
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast((model.folded(), model.bias, model.languages, model.temperature, model.threshold))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, bias, languages, temperature, threshold = shared.value
        names = np.array(languages, dtype=object)
        for batch in portions(batches, text):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            buckets, owner, _, n_letters = subwords(texts)
            n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
            sums = np.stack([np.bincount(owner, weights=folded[buckets, k], minlength=len(texts)) for k in range(len(names))], axis=1)
            chance = softmax((sums / n[:, None] + bias) / temperature)
            known = n_letters > 0
            best = chance.argmax(axis=1)
            score = np.where(known, chance.max(axis=1), 0.0)
            named = np.where(known, names[best], UNKNOWN)
            columns = [*[batch.column(c) for c in kept], pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(~known | (score < threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *outputs])

    return docs.mapInArrow(label, schema)
