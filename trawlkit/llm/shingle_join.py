"""N-gram Jaccard join by groups of equal prefix.

Two texts link when their sets of word shingles are similar enough. Shingles have one global order,
the frequent ones last; similar sets then share one of their first shingles (the prefix). Texts with
one prefix and set size form a group, and groups are filtered as one. Links are found in two rounds:
first every group is held against the hub of each list it stands in, the group that shares most, then
only pairs that are not connected yet are expanded and verified. So a group of copies, or of texts
made from one by small changes, costs rows in proportion to its size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.batches import as_bytes, portions
from trawlkit.llm.common import lookup
from trawlkit.llm.components import connected
from trawlkit.llm.word_hashes import mixed, word_hashes
from trawlkit.session import written_table

WORDS = 5
# Linked when PERCENT of the union is shared.
PERCENT = 80
# Counters of the frequency sketch, the slices it is sent in and how many parts are added at once.
SKETCH_BITS, SLICES, FAN_IN = 22, 16, 128
# Rows of a list compared at once, and rows that one task compares.
CHUNK, TASK_ROWS = 512, 20_000
# Prefix entries that one partition of the inverted lists is planned for.
PARTITION_ROWS = 500_000
# Groups a task remembers to have listed; more only cost repeated rows.
REMEMBERED = 500_000

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Per text the distinct hashes of its five-word shingles, ascending.

    A text of fewer words has its whole sequence as the one shingle; one without words has none.
    """
    hashes, owner = word_hashes(texts)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    full = max(0, len(hashes) - WORDS + 1)
    rolled = np.zeros(full, np.uint64)
    for k in range(WORDS):
        rolled += hashes[k : k + full] * FACTORS[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            short = (hashes[a:b] * FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(size_a: np.ndarray, size_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least intersection with which sets of these sizes link."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def counters(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's shingles by counter, once per text; 255 stands for more."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in portions(batches, "text"):
        counts += np.bincount(counters(np.concatenate([*shingle_sets(as_bytes(batch.column("text"))), np.zeros(0, np.uint64)])), minlength=1 << SKETCH_BITS).astype(np.uint32)
    part = TaskContext.get().partitionId()
    packed = [zlib.compress(s.tobytes(), 1) for s in np.split(np.minimum(counts, 255).astype(np.uint32), SLICES)]
    yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "part": pa.array([part] * SLICES, pa.int32()), "counts": pa.array(packed, pa.binary())})


def _add_slices(held: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64) for c in held.column("counts").to_pylist())
    packed = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
    return pa.table({"slice": held.column("slice").slice(0, 1), "part": pa.array([held.column("part")[0].as_py() // FAN_IN], pa.int32()), "counts": pa.array([packed], pa.binary())})


def frequency_classes(docs: DataFrame) -> np.ndarray:
    """A class per counter, 0 for the usual, more for counters that hold frequent shingles.

    The sketch covers every text and has one size for any corpus. Classes only decide the order of
    shingles; any order gives the same links.
    """
    schema = "slice int, part int, counts binary"
    parts = written_table(docs.select("text").mapInArrow(_sketch, schema), "sketches")
    while True:
        many = (parts.agg(F.max("part")).first()[0] or 0) + 1
        parts = written_table(parts.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("pack")).applyInArrow(_add_slices, schema), "sketches")
        if many <= FAN_IN:
            break
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES))
    for row in parts.collect():  # SLICES rows of a fixed size
        counts[row["slice"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    counts = counts.ravel()
    usual = max(1.0, counts.mean())
    return np.where(counts > usual + 8 * math.sqrt(usual), np.log2(np.maximum(counts / usual, 1)).astype(int) + 1, 0).astype(np.uint8)


def prefix_of(shingles: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which a similar set must have one."""
    order = np.argsort(classes[counters(shingles)], kind="stable")
    return shingles[order[: len(shingles) - -(-percent * len(shingles) // 100) + 1]]


def digest(shingles: np.ndarray, seed: int) -> np.uint64:
    """A hash of a sequence; the place of each entry counts."""
    places = np.arange(1, len(shingles) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(np.array([mixed((shingles ^ np.uint64(seed)) + places).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0]


@dataclass(frozen=True)
class Keys:
    """unit stands for a set, group for its size and prefix."""

    unit: int
    group: int


def keys_of(shingles: np.ndarray, prefix: np.ndarray) -> Keys:
    unit = digest(shingles, 17)
    return Keys(int(unit.view(np.int64)), int((digest(prefix, 29) + np.uint64(len(shingles))).view(np.int64)))


def _describe(classes: Broadcast, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            sets = shingle_sets(as_bytes(batch.column("text")))
            prefixes = [prefix_of(s, classes.value, percent) if len(s) else s for s in sets]
            keys = [keys_of(s, p) if len(s) else None for s, p in zip(sets, prefixes, strict=True)]
            made = {
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "unit": pa.array([k and k.unit for k in keys], pa.int64()),
                "grp": pa.array([k and k.group for k in keys], pa.int64()),
                "listed": pa.array([len(p) for p in prefixes], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *made.values()], names=["row", "doc_id", *made])

    return run


def _entries(classes: Broadcast, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in portions(batches, "text"):
            found = []
            for shingles in shingle_sets(as_bytes(batch.column("text"))):
                if not len(shingles):
                    continue
                prefix = prefix_of(shingles, classes.value, percent)
                group = keys_of(shingles, prefix).group
                if group in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add(group)
                found.append((prefix.view(np.int64), group, len(shingles)))
            if found:
                sizes = [len(p) for p, _, _ in found]
                columns = {
                    "shingle": np.concatenate([p for p, _, _ in found]),
                    "grp": np.repeat(np.array([g for _, g, _ in found], np.int64), sizes),
                    "n": np.repeat(np.array([n for _, _, n in found], np.int64), sizes),
                    "pos": np.concatenate([np.arange(s) for s in sizes]),
                }
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    return run


ENTRY = ("shingle", "grp", "n", "pos")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by shingle, size and group, those of lists with two groups or more.

    Holds one batch and one row besides.
    """
    held = np.zeros((0, 4), np.int64)
    later = False  # whether the held row is not its list's first

    def put(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=list(ENTRY))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ENTRY], axis=1)])
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
        rows = rows[fresh]
        same = rows[1:, 0] == rows[:-1, 0]
        wanted = np.concatenate([[later], same]) | np.concatenate([same, [False]])
        later = bool(same[-1]) if len(same) else later
        held = rows[-1:]
        yield put(rows[:-1][wanted[:-1]])
    if later:
        yield put(held)


def may_link(n_a, pos_a, n_b, pos_b, percent: int):
    """Whether sizes and places of a shared shingle leave room for a link; arrays or columns' values.

    Sets share at most what comes from the place on, if this is their first shared shingle; for a
    later one the bound is met by the first.
    """
    rest = np.minimum(n_a - pos_a, n_b - pos_b)
    return rest >= least_overlap(n_a, n_b, percent)


def _may_link_columns(n_a: str, pos_a: str, n_b: str, pos_b: str, percent: int) -> Column:
    rest = F.least(F.col(n_a) - F.col(pos_a), F.col(n_b) - F.col(pos_b))
    return rest * (100 + percent) >= F.lit(percent) * (F.col(n_a) + F.col(n_b))


def _unconnected(percent: int):
    """Pairs of groups of one list that sizes and places let link and that are not connected yet."""

    def run(held: pa.Table) -> pa.Table:
        held = held.sort_by([(c, "ascending") for c in ("shingle", "low", "high", "n", "grp")])
        column = {c: held.column(c).to_numpy() for c in ("shingle", "low", "high", "part", "grp", "n", "pos", "least", "most")}
        change = np.flatnonzero((np.diff(column["shingle"]) != 0) | (np.diff(column["low"]) != 0) | (np.diff(column["high"]) != 0)) + 1
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for run_rows in np.split(np.arange(len(held)), change):
            if not len(run_rows):
                continue
            low, high = column["low"][run_rows[0]], column["high"][run_rows[0]]
            a, b = (run_rows[column["part"][run_rows] == p] for p in (low, high))
            at = lambda c, i, j: (column[c][i][:, None], column[c][j][None, :])  # noqa: E731, B023
            (na, nb), (pa_, pb), (la, lb), (ma, mb) = (at(c, a, b) for c in ("n", "pos", "least", "most"))
            ok = may_link(na, pa_, nb, pb, percent) & ~((la == ma) & (lb == mb) & (la == lb))
            if low == high:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            i, j = np.nonzero(ok)
            left.append(column["grp"][a[i]])
            right.append(column["grp"][b[j]])
        x, y = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                if not batch.num_rows:
                    continue
                first, second = (shingle_sets(as_bytes(batch.column(c))) for c in ("text_a", "text_b"))
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(first, second, strict=True)]
                linked = [100 * c >= percent * (len(x) + len(y) - c) for c, x, y in zip(common, first, second, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs of units, those that link by their whole sets."""
    full = pairs.join(texts.select(F.col("unit").alias("b"), F.col("text").alias("text_b")), "b")
    full = full.join(texts.select(F.col("unit").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_verify(percent), "a long, b long")


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(doc_id, text, F.xxhash64(F.lit(41), text))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, row, unit, family.

    A-Z count as a-z; words are what white space (space, tab to carriage return) parts. Documents
    link when the intersection is at least `percent` of the union, and component_id is the least
    doc_id reachable by links. Texts without words, null ones among them, have 0 shingles, link with
    nothing and are their own component. Repeated rows are copies of one another. A null doc_id
    stays null and counts for component_id only if its component has no other.

    row is a hash of id and text, unit of the set, family of the component (null without words).
    """
    body = lookup(docs, text).cast("string")
    ids = lookup(docs, doc_id).cast("long")
    work = docs.select(row_key(ids, body).alias("row"), ids.alias("doc_id"), body.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequency_classes(work))
    described = work.mapInArrow(_describe(shared, percent), "row long, doc_id long, n long, unit long, grp long, listed long")
    described = written_table(described, "described")
    units = described.where(F.col("unit").isNotNull()).groupBy("unit").agg(F.min("row").alias("row"), F.min("grp").alias("grp"), F.min("doc_id").alias("least_id"))
    units = written_table(units, "units")
    groups = units.groupBy("grp").agg(F.min("unit").alias("head"))

    # Inverted lists over the prefixes; only those that several groups share are kept.
    entries = work.select("text").mapInArrow(_entries(shared, percent), "shingle long, grp long, n long, pos long")
    planned = described.agg(F.coalesce(F.sum("listed"), F.lit(0))).first()[0]
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(planned / PARTITION_ROWS))
    kinds = "shingle long, grp long, n long, pos long"
    lists = written_table(entries.repartition(width, "shingle").sortWithinPartitions("shingle", "n", "grp").mapInArrow(_shared, kinds), "lists")

    # First round: each group's head against the heads of its hubs, each unit against its group's head.
    # The hub of a list is the group with the most partners over all its lists: where texts were made
    # from one, that is the text they were made from, to which each of them is closest.
    sizes = lists.groupBy("shingle").agg(F.count("*").alias("size"))
    fame = lists.join(sizes, "shingle").groupBy("grp").agg(F.sum("size").alias("fame"))
    hub = lists.join(fame, "grp").groupBy("shingle").agg(F.max(F.struct("fame", "grp", "n", "pos")).alias("hub"))
    hub = hub.select("shingle", F.col("hub.grp").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"))
    hubs = lists.join(hub, "shingle").where(F.col("grp") != F.col("hub")).where(_may_link_columns("n", "pos", "hub_n", "hub_pos", percent)).select("grp", "hub").distinct()
    heads = groups.select(F.col("grp").alias("hub"), F.col("head").alias("b"))
    across = hubs.join(groups, "grp").join(heads, "hub").select(F.col("head").alias("a"), "b")
    within = units.join(groups, "grp").select(F.col("unit").alias("a"), F.col("head").alias("b"))
    first = written_table(_ordered_pairs(across.unionByName(within)), "hub-pairs")

    # Texts of the units that stand in a shared list or share a group; one row of each.
    busy = lists.select("grp").unionByName(units.groupBy("grp").agg(F.count("*").alias("many")).where("many > 1").select("grp")).distinct()
    needed = written_table(units.join(busy, "grp").select("row", "unit"), "needed")
    texts = written_table(work.select("row", "text").join(needed, "row").dropDuplicates(["row"]).select("unit", "text"), "texts", "zstd")
    found = written_table(_verified(first, texts, percent), "links")

    # Second round: what is not connected yet.
    stars = connected(found, "a", "b")
    placed = units.join(stars, units["unit"] == stars["node"], "left").select("unit", "grp", F.coalesce("component", "unit").alias("star"))
    placed = written_table(placed, "placed")
    spans = placed.groupBy("grp").agg(F.min("star").alias("least"), F.max("star").alias("most"))
    open_lists = lists.select(*ENTRY).join(spans, "grp")
    open_lists = written_table(open_lists, "spans")
    mixed_lists = open_lists.groupBy("shingle").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    chunks = mixed_lists.select("shingle", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    dealt = open_lists.join(chunks, "shingle").withColumn("part", F.pmod(F.xxhash64("grp"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = written_table(dealt.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other", "chunks"), "dealt")
    tasks = max(1, math.ceil(dealt.count() / TASK_ROWS))
    spot = F.pmod(F.xxhash64("shingle", "low", "high"), F.lit(tasks)).alias("task")
    pairs = dealt.groupBy(spot).applyInArrow(_unconnected(percent), "a long, b long")
    inner = spans.where("least < most").select(F.col("grp").alias("a"), F.col("grp").alias("b"))
    pairs = pairs.unionByName(inner).distinct()
    member = lambda side: placed.select(F.col("grp").alias(side), F.col("unit").alias(f"unit_{side}"), F.col("star").alias(f"star_{side}"))
    expanded = pairs.join(member("a"), "a").join(member("b"), "b").where("star_a <> star_b").select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"))
    second = written_table(_ordered_pairs(expanded).join(first, ["a", "b"], "left_anti"), "open-pairs")
    found = found.unionByName(_verified(second, texts, percent))

    named = connected(found, "a", "b").select(F.col("node").alias("unit"), F.col("component").alias("family"))
    full = units.join(named, "unit", "left").select("unit", "least_id", F.coalesce("family", "unit").alias("family"))
    names = full.groupBy("family").agg(F.min("least_id").alias("component_id"))
    known = written_table(full.join(names, "family").select("unit", "family", "component_id"), "families")
    out = described.select("row", "doc_id", F.col("n").alias("n_shingles"), "unit").join(known, "unit", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row", "unit", "family")
