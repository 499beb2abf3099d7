"""Near duplicates among embeddings: Euclidean p-stable hashing, then exact cosines.

Normalised vectors are projected on random Gaussian directions; the quantised projections of a
table form its bucket key. Vectors that share a bucket in any table are compared exactly. Counts
and links leave a bucket as one row per member, never as all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.common import lookup
from trawlkit.llm.components import connected
from trawlkit.session import written_table

LEAST_COSINE = 0.93
# Tables, projections per table and bucket width. At the threshold (distance 0.374) one projection
# agrees with chance 0.85, a table with 0.144, and one of 48 tables with 0.9994.
TABLES, PROJECTIONS, WIDTH = 48, 12, 2.0
# Members of a bucket compared at once; a larger bucket is compared chunk by chunk.
CHUNK = 1024
# Member rows handled together in one task.
TASK_ROWS = 20_000

# Projections are of whole numbers, so that a sum is exact in whatever order it is taken, and a
# vector gets the same keys in every task.
SCALE_VECTOR, SCALE_DIRECTION = 2.0**20, 2.0**12


@cache
def directions(dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_2)
    ways = np.rint(rng.standard_normal((dims, TABLES * PROJECTIONS)) * SCALE_DIRECTION)
    shifts = np.rint(rng.uniform(0, WIDTH, TABLES * PROJECTIONS) * SCALE_VECTOR * SCALE_DIRECTION)
    return ways, shifts


def table_keys(unit: np.ndarray) -> np.ndarray:
    """A 64-bit key per vector and table."""
    ways, shifts = directions(unit.shape[1])
    cells = np.floor((np.rint(unit * SCALE_VECTOR) @ ways + shifts) / (WIDTH * SCALE_VECTOR * SCALE_DIRECTION))
    cells = cells.astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, PROJECTIONS)
    keys = np.zeros((len(unit), TABLES), np.uint64)
    for k in range(PROJECTIONS):
        keys = (keys ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    # Scaled first, so that squares of very large or small components stay in range.
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for mixed in batches:
        for dims in pa.compute.unique(mixed.column("dims")).to_pylist():
            batch = mixed.filter(pa.compute.equal(mixed.column("dims"), dims))
            keys = table_keys(units(batch.column("vec")))
            slots = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), TABLES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("label"), batch.column("dims"), slots], names=["rid", "label", "dims", "slots"])


def links_within(unit: np.ndarray, keys: np.ndarray, table: int, first: np.ndarray, second: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs between two chunks (or in one), and which meet first in this table."""
    near = unit[first] @ unit[second].T >= least
    if first is second:
        near &= np.triu(np.ones(near.shape, bool), 1)
    a, b = np.nonzero(near)
    a, b = first[a], second[b]
    fresh = ~(keys[a, :table] == keys[b, :table]).any(axis=1) if table else np.ones(len(a), bool)
    return a, b, fresh


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable index of each of n members."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root[a] == root[b]).all():
            return root


def compare_members(held: pa.Table, least: float) -> pa.Table:
    """Per member: weight of the members it is linked with and meets here first; its least link."""
    out: tuple[list, list, list] = ([], [], [])
    order = held.sort_by([(c, "ascending") for c in ("slot", "low", "high", "rid")])
    rid, copies, slot = (order.column(c).to_numpy() for c in ("rid", "copies", "slot"))
    low, high, part, table = (order.column(c).to_numpy() for c in ("low", "high", "part", "tab"))
    unit = units(order.column("vec")) if len(held) else np.zeros((0, 1))
    keys = table_keys(unit) if len(held) else np.zeros((0, TABLES), np.int64)
    change = np.flatnonzero((np.diff(slot) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
    for run in np.split(np.arange(len(rid)), change):
        if len(run) < 2:
            continue
        first, second = run[part[run] == low[run[0]]], run[part[run] == high[run[0]]]
        if low[run[0]] == high[run[0]]:
            second = first
        a, b, fresh = links_within(unit, keys, int(table[run[0]]), first, second, least)
        if not len(a):
            continue
        weight = np.bincount(a[fresh] - run[0], copies[b[fresh]], len(run)) + np.bincount(b[fresh] - run[0], copies[a[fresh]], len(run))
        root = _roots(len(run), a - run[0], b - run[0])
        seen = np.unique(np.concatenate([a, b])) - run[0]
        out[0].append(rid[run[seen]])
        out[1].append(weight[seen].astype(np.int64))
        out[2].append(rid[run[root[seen]]])
    columns = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["rid", "links", "root"])


def usable(vector: Column) -> Column:
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0.0), F.lit(False))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of one label, not null, and of one length are compared. Vectors that are null,
    empty, zero or hold a null or a component that is not finite link with nothing, and so do rows
    without a label or an id; they are their own component. Equal vectors are compared once and
    count as often as they occur; rows repeated under one id are links of each other.
    """
    known = vectors.select(lookup(vectors, vec_id).cast("long").alias("vec_id"), lookup(vectors, label).cast("string").alias("label"), lookup(vectors, vector).alias("vec"))
    fit = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    pinned = known.select("*", fit.alias("fit"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(3), "vec").alias("h2"), F.coalesce(F.size("vec"), F.lit(0)).alias("dims"))
    rows = written_table(pinned.drop("vec").where("fit").drop("fit"), "vector-rows")
    rest = pinned.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    kinds = ["label", "h1", "h2", "dims"]
    single = pinned.where("fit").groupBy(*kinds).agg(F.min("vec_id").alias("rid"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    # A row id for each distinct vector; the least id of its rows, unless two vectors share that.
    single = single.select(F.col("rid").alias("least_id"), F.xxhash64("label", "h1", "h2", "rid").alias("rid"), "label", "h1", "h2", "dims", "copies", "vec")
    single = written_table(single, "distinct-vectors")
    hashed = single.select("rid", "label", "dims", "vec").mapInArrow(_hash, "rid long, label string, dims int, slots array<long>")
    slots = hashed.select("rid", "label", "dims", F.posexplode("slots").alias("tab", "key"))
    slots = written_table(slots.select("rid", "tab", F.xxhash64("label", "dims", "tab", "key").alias("slot")), "slots")
    busy = slots.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    busy = written_table(busy.select("slot", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "busy-slots")
    members = slots.join(busy, "slot").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = written_table(members.select("rid", "slot", "tab", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")), "members")
    tasks = max(1, math.ceil(members.count() / TASK_ROWS))
    full = members.join(single.select("rid", "vec", "copies", "dims"), "rid")
    spot = F.pmod(F.xxhash64("slot", "low", "high"), F.lit(tasks))
    compared = full.groupBy("dims", spot.alias("task")).applyInArrow(lambda held: compare_members(held, least), "rid long, links long, root long")
    compared = written_table(compared, "compared")
    links = compared.groupBy("rid").agg(F.sum("links").alias("links"))
    groups = connected(compared.select("rid", "root"), "rid", "root")
    # A component goes by the least vec_id in it.
    named = groups.join(single.select(F.col("rid").alias("node"), "least_id"), "node")
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    tied = groups.join(names, "component").select(F.col("node").alias("rid"), "component_id")
    result = single.select("rid", "least_id", "copies", *kinds).join(links, "rid", "left").join(tied, "rid", "left")
    result = written_table(
        result.select(
            *kinds,
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "least_id").alias("component_id"),
        ),
        "vector-results",
    )
    out = rows.join(result, kinds).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(rest)
