"""Exact top-k search by no-random-access aggregation over sorted lists.

A score is a sum over the dimensions. The dimensions are dealt to a few lists, and a list sorts the
rows of a block by what its dimensions add. The lists are read in step from their best ends. What a
row is known to have gives a lower bound; adding, for each list it was not met in, that list's front
gives an upper bound. Reading stops when rows not met in any list cannot qualify, rows whose upper
bound is too low are dropped, and the scores of the others are resolved. The k-th best score found
in one block is the bar that the next one has to reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawlkit.llm.common import lookup
from trawlkit.session import written_table

# Rows and queries that one task holds at once; rows whose lists are made at once, and queries.
TASK_ROWS, GROUP_QUERIES = 16_384, 512
BLOCK_ROWS, BATCH_QUERIES = 4096, 64
# Lists per query, and places read from each in the first step; each step reads as many as all before.
LISTS, FIRST_READ = 4, 64


class Reading:
    """What was read, for reports: entries of the lists, and all that they held."""

    def __init__(self):
        self.read = self.held = 0


def list_entries(values: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """What each list adds to the score of each row: (query, list, row), whole numbers as doubles."""
    cuts = np.array_split(np.arange(values.shape[1]), min(LISTS, values.shape[1]))
    wide, asked = values.astype(np.float64), queries.astype(np.float64)
    return np.stack([asked[:, c] @ wide[:, c].T for c in cuts], axis=1)


def candidates(entries: np.ndarray, k: int, bar: float, reading: Reading) -> np.ndarray:
    """Rows that may be among the k best, or reach the bar; ties included. entries is (list, row)."""
    lists, n = entries.shape
    reading.held += lists * n
    if n <= k:
        reading.read += lists * n
        return np.arange(n)
    least = entries.min(axis=1)
    met, depth = np.zeros((lists, n), bool), 0
    while True:
        depth = min(n, max(FIRST_READ, 2 * depth, k))
        if depth < n:
            front = np.partition(entries, n - depth, axis=1)[:, n - depth]
            met = entries >= front[:, None]
        else:
            front, met = least, np.ones((lists, n), bool)
        rows = np.flatnonzero(met.any(axis=0))
        known = met[:, rows]
        lower = np.where(known, entries[:, rows], least[:, None]).sum(axis=0)
        reached = max(bar, np.partition(lower, len(rows) - k)[len(rows) - k])
        if depth == n or front.sum() < reached:
            reading.read += int(met.sum())
            upper = np.where(known, entries[:, rows], front[:, None]).sum(axis=0)
            return rows[upper >= reached]


def exact_scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond what 64 bits hold, exact ones cut to that range."""
    bound = float(np.abs(values).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, values.shape[1])
    if bound < 2**53:
        return (values.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return values @ query
    sums = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in values]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


def quantised(vector: Column) -> Column:
    """floor(1024 x) of each component; null for vectors that are null, empty or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fit = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(wide, lambda x: F.floor(x * 1024.0))
    return F.when(fit & (F.size(vector) > 0), whole)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.int64)


RESULT = "query_id long, vec_id long, score long, q_mark long"


def task_search(queries: pa.Table, rows: pa.Table, k: int, reading: Reading | None = None) -> pa.Table:
    """The k best rows a task holds for each query of its group."""
    reading = reading or Reading()
    found: tuple[list, list, list, list] = ([], [], [], [])
    if len(queries) and len(rows):
        ids, values = rows.column("vec_id").to_numpy(), _matrix(rows.column("vec"))
        norms = np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))
        # The longest vectors first: they set the bar, and blocks of short ones may never reach it.
        order = np.lexsort((ids, -norms))
        ids, values, norms = ids[order], values[order], norms[order]
        own_ids, marks, asked = queries.column("vec_id").to_numpy(), queries.column("mark").to_numpy(), _matrix(queries.column("vec"))
        # Beyond 2^53 doubles are no whole numbers any more, and every row is scored.
        exact = float(np.abs(values).max(initial=0)) * float(np.abs(asked).max(initial=0)) * values.shape[1] < 2**53
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own_ids]
        for start in range(0, len(ids), BLOCK_ROWS):
            block, block_ids = values[start : start + BLOCK_ROWS], ids[start : start + BLOCK_ROWS]
            for first in range(0, len(asked), BATCH_QUERIES):
                batch = asked[first : first + BATCH_QUERIES]
                entries = list_entries(block, batch) if exact else None
                for i, query in enumerate(batch, first):
                    bar = float(best[i][0][k - 1]) if len(best[i][0]) == k else -np.inf
                    if exact and float(np.sqrt((query.astype(np.float64) ** 2).sum())) * norms[start] * (1 + 1e-9) + 1 < bar:
                        reading.held += entries.shape[1] * len(block)
                        continue
                    own = int((block_ids == own_ids[i]).sum())
                    picked = candidates(entries[i - first], k + own, bar, reading) if exact else np.arange(len(block))
                    picked = picked[block_ids[picked] != own_ids[i]]
                    scores = np.concatenate([best[i][0], exact_scores(block[picked], query)])
                    rows_of = np.concatenate([best[i][1], block_ids[picked]])
                    top = np.lexsort((rows_of, -scores))[:k]
                    best[i] = scores[top], rows_of[top]
        for i, (scores, rows_of) in enumerate(best):
            for part, made in zip(found, (np.full(len(scores), own_ids[i]), rows_of, scores, np.full(len(scores), marks[i])), strict=True):
                part.append(made)
    columns = [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "q_mark"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows by integer inner product per query.

    Components x count as floor(1024 x). Every row but those of the query's own id is a candidate,
    ties go to the smaller id. Rows with a null id, and vectors that are null, empty or hold a null
    or a component that is not finite, take no part; neither do rows of another length than the
    query's. Repeated rows count once; different vectors under one id are rows and queries of their
    own. Fewer rows than k give all. Rows are dealt to tasks by hash and every group of queries
    meets them all, so that no task holds more than TASK_ROWS rows and a group, give or take chance.
    """
    own = vectors.select(
        lookup(vectors, vec_id).cast("long").alias("vec_id"), quantised(lookup(vectors, vector)).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    rows = written_table(own.withColumn("mark", F.xxhash64("vec")).dropDuplicates(["vec_id", "mark"]), "quantised")
    counts = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, groups = max(1, -(-counts[0] // TASK_ROWS)), max(1, -(-counts[1] // GROUP_QUERIES))
    spot = F.xxhash64("vec_id", "mark")
    size = F.size("vec").alias("size")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where("asks").select("vec_id", "mark", "vec", size, F.pmod(spot, F.lit(groups)).cast("int").alias("grp"), every(blocks).alias("blk"))
    right = rows.select("vec_id", "vec", size, F.pmod(spot, F.lit(blocks)).cast("int").alias("blk"), every(groups).alias("grp"))
    keys = ["size", "grp", "blk"]

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        return task_search(asked, held, k)

    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, RESULT)
    best = Window.partitionBy("query_id", "q_mark").orderBy(F.col("score").desc(), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
