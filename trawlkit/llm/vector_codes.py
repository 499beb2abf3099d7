"""Vector code compression: codebooks per part of the vectors, fitted by active-entry Lloyd rounds.

Components become integers and all arithmetic is exact. Each part keeps its entry and the exact
distance to it. In the next round a part whose entry stayed where it was compares only the entries
that moved against that distance; all other parts rescan the whole codebook. Equal distances go to
the lower entry either way, so the result is that of full scans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.llm.common import lookup
from trawlkit.session import broadcast_if_small, written_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Scaled components below this and vectors up to 4096 components keep every sum of squares in a long.
LIMIT = 1 << 24
# Vectors of a batch that are compared at once hold about so many numbers.
CELLS = 1 << 21


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part, and which of them the last round moved."""

    entries: list[np.ndarray]
    moved: list[np.ndarray]

    def digest(self) -> str:
        numbers = ",".join(str(x) for part in self.entries for x in part.ravel().tolist())
        return hashlib.sha256(numbers.encode()).hexdigest()


def edges(length: int) -> list[int]:
    """Where parts begin and end; if the length does not divide, the first parts are one longer."""
    return [0, *np.cumsum([len(p) for p in np.array_split(np.arange(length), PARTS)]).tolist()]


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    # Doubles hold whole numbers exactly up to 2^53, and their products are much faster.
    kind = np.float64 if 4 * x.shape[1] * largest * largest < 1 << 53 else np.int64
    x, book = x.astype(kind), book.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]).astype(np.int64)


def full_scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, the lower one of equals, and its distance."""
    d = distances(x, book)
    nearest = d.argmin(axis=1)
    return nearest, d[np.arange(len(x)), nearest]


def active_scan(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as full_scan, given the assignment before the entries in `moved` moved."""
    entry, distance = entry.copy(), distance.copy()
    rescan = moved[entry]
    if rescan.any():
        entry[rescan], distance[rescan] = full_scan(x[rescan], book)
    active, fixed = np.flatnonzero(moved), np.flatnonzero(~rescan)
    if len(active) and len(fixed):
        found, near = full_scan(x[fixed], book[active])
        found = active[found]
        better = (near < distance[fixed]) | ((near == distance[fixed]) & (found < entry[fixed]))
        entry[fixed[better]], distance[fixed[better]] = found[better], near[better]
    return entry, distance


def _usable(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    own = vectors.select(lookup(vectors, id).alias("id"), lookup(vectors, label).alias("label"), lookup(vectors, vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    scaled = F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    whole = own.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    fits = F.forall("x", lambda c: F.abs(c) < LIMIT)
    return whole.select("id", "label", scaled.alias("x")).where(fits).withColumn("x", F.col("x").cast("array<int>"))


def _numbers(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _state_schema(df: DataFrame) -> T.StructType:
    return T.StructType([df.schema["id"], df.schema["label"], df.schema["x"], T.StructField("code", T.BinaryType()), T.StructField("distance", T.ArrayType(T.LongType()))])


def _assign(state: DataFrame, books: Codebooks, length: int, first: bool) -> DataFrame:
    """Rows with the entry of each part (a byte each) and its distance."""
    shared = state.sparkSession.sparkContext.broadcast(books)
    cuts = edges(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        size = max(1, CELLS // max(length, ENTRIES))
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                piece = batch.slice(start, size)
                x = _numbers(piece.column("x"), length)
                code, distance = np.zeros((len(x), PARTS), np.uint8), np.zeros((len(x), PARTS), np.int64)
                if not first:
                    before = np.frombuffer(b"".join(piece.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
                    far = _numbers(piece.column("distance"), PARTS)
                for j, book in enumerate(held.entries):
                    part = x[:, cuts[j] : cuts[j + 1]]
                    code[:, j], distance[:, j] = full_scan(part, book) if first else active_scan(part, book, held.moved[j], before[:, j].astype(np.int64), far[:, j])
                codes = pa.array([row.tobytes() for row in code], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * PARTS, pa.int32()), pa.array(distance.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), piece.column("x"), codes, lists], names=["id", "label", "x", "code", "distance"])

    return state.mapInArrow(run, _state_schema(state))


def _means(state: DataFrame, books: Codebooks, length: int) -> Codebooks:
    """Entries replaced by the floor of their parts' mean. Every task sums its own rows first."""
    cuts = edges(length)
    most = max(len(b) for b in books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((most, length), np.int64), np.zeros((PARTS, most), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch.column("x"), length)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            for j in range(PARTS):
                order = np.argsort(code[:, j], kind="stable")
                used, at, times = np.unique(code[order, j], return_index=True, return_counts=True)
                sums[used, cuts[j] : cuts[j + 1]] += np.add.reduceat(x[order, cuts[j] : cuts[j + 1]], at, axis=0)
                counts[j, used] += times
        for j in range(PARTS):
            used = np.flatnonzero(counts[j])
            rows = [{"part": j, "entry": int(k), "n": int(counts[j, k]), "sums": sums[k, cuts[j] : cuts[j + 1]].tolist()} for k in used]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    partial = state.select("x", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    placed = partial.select("part", "entry", "n", F.posexplode("sums").alias("place", "total"))
    # As many rows as the codebooks have numbers.
    found = placed.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow().to_pydict()
    entries = [b.copy() for b in books.entries]
    for j, k, place, total, n in zip(found["part"], found["entry"], found["place"], found["total"], found["n"], strict=True):
        entries[j][k, place] = total // n
    return Codebooks(entries, [(new != old).any(axis=1) for new, old in zip(entries, books.entries, strict=True)])


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """One row per usable vector: id, label, code, error, label_error, codebooks_sha256; and the codebooks.

    Vectors that are null, empty or hold null or non-finite components are left out, as are those
    with components of 16384 and more, whose distances do not fit a long. The vector with the least
    id says how long vectors are; those of another length have nothing to be compared with and are
    left out. The codebooks start as the parts of the ENTRIES rows of least id (null ids last; rows
    of one id in the order of their components); fewer rows make fewer entries. Repeated rows count
    and are returned as often as they occur. A null label is a label. Own columns other than the
    three named ones play no part. Without a usable vector the result is empty and codebooks None.
    """
    usable = _usable(vectors, id, vector, label)
    names = {"id": id, "label": label}
    seeds = usable.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).select("x").collect()
    if not seeds:
        empty = usable.select(F.col("id").alias(id), F.col("label").alias(label), F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
        return empty.limit(0), None
    length = len(seeds[0].x)
    state = usable.where(F.size("x") == length)
    first = np.array([r.x for r in state.orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()], np.int64)
    cuts = edges(length)
    books = Codebooks([first[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)], [np.ones(len(first), bool)] * PARTS)
    state = written_table(_assign(state, books, length, True), "codes")
    for _ in range(rounds):
        books = _means(state, books, length)
        if not any(m.any() for m in books.moved):
            break  # nothing moved, so no assignment can change
        state = written_table(_assign(state, books, length, False), "codes")
    coded = state.select("id", "label", F.lower(F.hex("code")).alias("code"), F.aggregate("distance", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"))
    sums = broadcast_if_small(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "label_of_sum"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("label_of_sum")))
    return joined.select(*[F.col(c).alias(n) for c, n in names.items()], "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), books
