"""Removal of byte strings that repeat anywhere, by merging Burrows-Wheeler transforms.

Every WINDOW-byte string is filed under its anchor, the sampled gram with the least hash inside it,
so all occurrences of a string meet under one anchor. Runs of strings with one anchor are segments.
Equal segments are counted by an aggregation. Where one anchor has different segments, their bytes
are gathered: shards of segments are sorted on their own, and the shards' Burrows-Wheeler transforms
are merged by refining the interleave one symbol at a time. Its blocks, after as many symbols as a
window has, are the repeated strings; no suffix is sorted again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.llm.batches import as_bytes, portions
from trawlkit.llm.common import lookup
from trawlkit.llm.word_hashes import mixed, powers
from trawlkit.session import written_table

# Bytes of a string that counts as repeated, and of the grams that anchors are chosen from.
WINDOW, GRAM = 400, 40
# Bytes per symbol of the transforms: a window is a whole number of them.
SYMBOL = 50
# Bytes of a text handled at once; a longer one is cut into overlapping parts.
PART_BITS = 20
# Segments of a shard, and bytes of segments that one task merges.
SHARD_SEGMENTS, TASK_BYTES = 256, 1 << 19
# Different segments under one anchor beyond which they are cut into pieces by where their strings
# have the anchor, so that they are compared under longer shared contents.
HOT_SEGMENTS = 1000

GRAMS = WINDOW - GRAM + 1
# Strings of a piece at most, finer and finer; pieces of one string need no comparison.
PIECES = (46, 6, 1)


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any substring follows, and the powers that shift it."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return sums, down


def substring_hashes(sums: np.ndarray, down: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values: running minima within blocks, from both sides."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Segments of all texts: text number, first start, number of starts, anchor and content hash."""
    out: dict[str, list] = {c: [np.zeros(0, np.int64)] for c in ("text", "start", "starts", "anchor", "content")}
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.frombuffer(b"".join(texts), np.uint8)
    size = 1 << PART_BITS
    for at in range(0, max(1, len(codes) - WINDOW + 1), size):
        part = codes[at : at + size + WINDOW - 1]
        if len(part) < WINDOW:
            continue
        sums, down = prefix_sums(part)
        places = np.arange(len(part) - GRAM + 1)
        grams = substring_hashes(sums, down, places, places + GRAM)
        # The place in the low bits breaks ties to the left.
        bits = np.uint64(PART_BITS + 1)
        packed = (grams >> bits << bits) | places.astype(np.uint64)
        anchor = (sliding_least(packed, GRAMS) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        starts = np.arange(len(anchor))
        owner = np.searchsorted(first, starts + at, "right") - 1
        fits = starts + at + WINDOW <= first[owner + 1]
        change = np.ones(len(starts), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(change & fits)
        if not len(begin):
            continue
        # Strings that cross into the next text end a run.
        stops = np.flatnonzero(np.concatenate([change[1:] | ~fits[1:], [True]]) & fits)
        ends = stops + 1
        out["text"].append(owner[begin])
        out["start"].append(begin + at - first[owner[begin]])
        out["starts"].append(ends - begin)
        out["anchor"].append(grams[anchor[begin]].view(np.int64))
        out["content"].append(substring_hashes(sums, down, begin, ends - 1 + WINDOW).view(np.int64))
    return {c: np.concatenate(v) for c, v in out.items()}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        found = segments(as_bytes(batch.column("text")))
        owner = pa.array(found["text"])
        keys = [batch.column(c).take(owner) for c in ("k1", "k2")]
        yield pa.RecordBatch.from_arrays([*keys, *[pa.array(found[c]) for c in ("start", "starts", "anchor", "content")]], names=["k1", "k2", "start", "starts", "anchor", "content"])


def shard_order(symbols: np.ndarray, right: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """A shard's positions sorted by their next symbols, of which the end of a segment is the least.

    right says how many bytes of its segment stand from a position on.
    """
    order = positions
    for k in reversed(range(depth)):
        at = np.minimum(order + k * SYMBOL, len(symbols) - 1)
        key = np.where(right[order] >= (k + 1) * SYMBOL, symbols[at], -1)
        order = order[np.argsort(key, kind="stable")]
    return order


def merged_blocks(symbols: np.ndarray, left: np.ndarray, shards: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """Positions whose next `depth` symbols occur at another position too, block by block.

    shards are sorted orders of positions. `order` is the interleave of them by the first k symbols.
    One step goes back over the symbol before each position (the merged transform) and deals the
    positions out by it, stably: that is the interleave by k + 1 symbols. A block is a run of equal
    prefixes. A position alone in its block is out: what stands before it is alone as well.
    left says how many bytes of its segment stand before a position.
    """
    order = np.concatenate(shards) if shards else np.zeros(0, np.int64)
    # By one symbol: the shards' orders, merged by their first symbols.
    order = order[np.argsort(symbols[order], kind="stable")]
    head = symbols[order]
    block = np.cumsum(np.concatenate([[True], head[1:] != head[:-1]])) if len(order) else np.zeros(0, np.int64)
    for _ in range(depth - 1):
        order, block = _repeated(order, block)
        back = left[order] >= SYMBOL
        order, block = order[back] - SYMBOL, block[back]
        before = symbols[order]
        place = np.argsort(before, kind="stable")
        order, block, before = order[place], block[place], before[place]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (before[1:] != before[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(fresh)
    order, block = _repeated(order, block)
    return np.split(order, np.flatnonzero(np.diff(block)) + 1) if len(order) else []


def _repeated(order: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    many = np.bincount(block)[block] > 1 if len(block) else np.zeros(0, bool)
    return order[many], block[many]


def repeated_starts(parts: list[bytes]) -> np.ndarray:
    """Of the segments laid end to end, the positions where a repeated string starts."""
    codes = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    ends = np.cumsum(lengths)
    sums, down = prefix_sums(codes)
    places = np.arange(len(codes))
    owner = np.repeat(np.arange(len(parts)), lengths)
    whole = places + SYMBOL <= ends[owner]
    symbols = np.full(len(codes), -1, np.int64)
    hashes = substring_hashes(sums, down, places[whole], places[whole] + SYMBOL)
    symbols[whole] = np.unique(hashes, return_inverse=True)[1]
    left = places - (ends - lengths)[owner]
    right, shards, depth = ends[owner] - places, [], WINDOW // SYMBOL
    for at in range(0, len(parts), SHARD_SEGMENTS):
        last = min(at + SHARD_SEGMENTS, len(parts)) - 1
        own = np.arange(ends[at] - lengths[at], ends[last])
        shards.append(shard_order(symbols, right, own[whole[own]], depth))
    blocks = merged_blocks(symbols, left, shards, depth)
    return np.sort(np.concatenate(blocks)) if blocks else np.zeros(0, np.int64)


SPAN = "k1 long, k2 long, begin long, stop long"


def _merge_task(held: pa.Table) -> pa.Table:
    """Spans of the repeated strings of one task's segments."""
    parts = held.column("bytes").to_pylist()
    lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    first = np.cumsum(lengths) - lengths
    found = repeated_starts(parts)
    owner = np.searchsorted(first, found, "right") - 1
    edge = np.ones(len(found), bool)
    edge[1:] = (np.diff(found) != 1) | (np.diff(owner) != 0)
    begin = np.flatnonzero(edge)
    end = np.concatenate([begin[1:], [len(found)]]) - 1 if len(found) else begin
    rows = owner[begin]
    start = held.column("start").to_numpy()[rows]
    columns = [held.column(c).to_numpy()[rows] for c in ("k1", "k2")]
    columns += [start + found[begin] - first[rows], start + found[end] - first[rows] + WINDOW]
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["k1", "k2", "begin", "stop"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in portions(batches, "text"):
        rows = []
        texts = as_bytes(batch.column("text"))
        for text, k1, k2, wanted in zip(texts, batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            rows += [(k1, k2, w["start"], w["anchor"], text[w["start"] : w["start"] + w["starts"] - 1 + WINDOW]) for w in wanted]
        kinds = {"k1": pa.int64(), "k2": pa.int64(), "start": pa.int64(), "anchor": pa.int64(), "bytes": pa.binary()}
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def anchor_of(part: bytes) -> int:
    """Where the anchor of a segment's strings stands in it."""
    sums, down = prefix_sums(np.frombuffer(part[:WINDOW], np.uint8))
    places = np.arange(GRAMS)
    return int(np.argmin(substring_hashes(sums, down, places, places + GRAM) >> np.uint64(PART_BITS + 1)))


def _cut_pieces(width: int):
    """Segments or pieces as pieces of at most `width` strings each.

    Cuts lie at fixed distances from the anchor, so equal strings fall into like pieces. The bytes that
    all strings of a whole piece share are its new anchor; a string lies in one piece only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "bytes"):
            rows = []
            for part, k1, k2, start in zip(as_bytes(batch.column("bytes")), *(batch.column(c).to_pylist() for c in ("k1", "k2", "start")), strict=True):
                sums, down = prefix_sums(np.frombuffer(part, np.uint8))
                strings, pivot = len(part) - WINDOW + 1, anchor_of(part)
                # A string that starts at s has the anchor at pivot - s; a piece is a range of these.
                slots = (pivot - np.arange(strings)) // width
                begin = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
                end = np.concatenate([begin[1:], [strings]])
                low = slots[begin] * width
                keys = mixed(substring_hashes(sums, down, pivot - low, pivot - low - width + 1 + WINDOW) + low.astype(np.uint64))
                contents = substring_hashes(sums, down, begin, end - 1 + WINDOW)
                for i, j, key, content in zip(begin.tolist(), end.tolist(), keys.view(np.int64).tolist(), contents.view(np.int64).tolist(), strict=True):
                    rows.append((k1, k2, start + i, key, content, part[i : j - 1 + WINDOW]))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            names = ("k1", "k2", "start", "anchor", "content", "bytes")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "bytes" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=list(names))

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        made: list[list] = [[], [], [], [], []]
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            kept, at, removed, runs = [], 0, 0, 0
            for begin, stop in sorted((s["begin"], s["stop"]) for s in spans or []):
                if begin > at or not runs:
                    kept.append(text[at:begin])
                    runs += 1
                    removed += stop - begin
                elif stop > at:
                    removed += stop - at
                at = max(at, stop)
            kept.append(text[at:])
            rest = b"".join(kept)
            for column, value in zip(made, (len(text), removed, runs, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                column.append(value)
        other = [c for c in batch.schema.names if c not in ("text", "spans")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in other], *[pa.array(v, k) for v, k in zip(made, kinds, strict=True)]], names=[*other, *names])


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(43), text).alias("k2")]


def _merged(cut: DataFrame, size: int) -> DataFrame:
    """Spans of the strings that repeat among the segments or pieces of an anchor."""
    tasks = max(1, math.ceil(size / TASK_BYTES))
    return cut.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("task")).applyInArrow(_merge_task, SPAN)


def _piece_spans(segments: DataFrame) -> Iterator[DataFrame]:
    """The same for segments of anchors with too many contents: k1, k2, start and bytes, each content once.

    Level by level, segments are cut into finer pieces. Equal pieces are counted, different ones
    under one new anchor are merged, and where those are too many one of each goes to the next level.
    """
    for width in PIECES:
        pieces = written_table(segments.mapInArrow(_cut_pieces(width), "k1 long, k2 long, start long, anchor long, content long, bytes binary"), "pieces")
        equal = pieces.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "start")).alias("first"))
        equal = written_table(equal, "equal-pieces")
        twice = equal.where("times > 1").select("anchor", "content")
        yield pieces.join(twice, ["anchor", "content"]).select("k1", "k2", F.col("start").alias("begin"), (F.col("start") + F.length("bytes")).alias("stop"))
        several = equal.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1")
        chosen = equal.join(several, "anchor").select("anchor", "content", "first.*", (F.col("contents") > HOT_SEGMENTS).alias("hot"))
        chosen = written_table(pieces.join(chosen, ["anchor", "content", "k1", "k2", "start"]), "compared-pieces")
        sizes = {r["hot"]: r["size"] for r in chosen.groupBy("hot").agg(F.sum(F.length("bytes")).alias("size")).collect()}
        if False in sizes:
            yield _merged(chosen.where("NOT hot"), sizes[False])
        if True not in sizes:
            return
        segments = chosen.where("hot").select("k1", "k2", "start", "bytes")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """k1, k2 (of a text) and begin, stop of spans all of whose WINDOW-byte strings occur elsewhere too."""
    body = F.coalesce(lookup(docs, text).cast("string"), F.lit(""))
    work = docs.select(*text_keys(body), body.alias("text"))
    found = work.mapInArrow(_segments, "k1 long, k2 long, start long, starts long, anchor long, content long")
    found = written_table(found.withColumn("place", F.xxhash64("k1", "k2", "start")), "segments")
    equal = found.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min("place").alias("place"))
    equal = written_table(equal, "equal-segments")
    several = equal.groupBy("anchor").agg(F.count("*").alias("contents"))
    several = written_table(several.where("contents > 1"), "open-anchors")
    stop = (F.col("start") + F.col("starts") - 1 + WINDOW).alias("stop")
    # Equal segments: all their strings repeat.
    twice = equal.where("times > 1").select("anchor", "content")
    whole = found.join(twice, ["anchor", "content"]).select("k1", "k2", F.col("start").alias("begin"), stop).distinct()
    # One of each content under anchors with several contents is compared byte by byte.
    chosen = equal.join(several, "anchor").select("place", "anchor", (F.col("contents") > HOT_SEGMENTS).alias("hot"))
    chosen = written_table(found.select("k1", "k2", "start", "starts", "place", "anchor").distinct().join(chosen, ["place", "anchor"]), "compared-segments")
    size = chosen.agg(F.coalesce(F.sum(F.col("starts") + WINDOW), F.lit(0))).first()[0]
    # Texts of the chosen segments, each once.
    lists = chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "starts", "anchor")).alias("wanted"))
    texts = work.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    cut = texts.join(lists, ["k1", "k2"]).mapInArrow(_cut_out, "k1 long, k2 long, start long, anchor long, bytes binary")
    hot = several.where(F.col("contents") > HOT_SEGMENTS).select("anchor")
    cut = written_table(cut, "segment-bytes")
    merged = _merged(cut.join(hot, "anchor", "left_anti"), size)
    spans = whole.unionByName(merged)
    if not hot.isEmpty():
        for more in _piece_spans(cut.join(hot, "anchor", "left_semi")):
            spans = spans.unionByName(more)
    return written_table(spans, "spans")


def remove_repeats(docs: DataFrame, text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """Removes every byte of a WINDOW-byte string that also starts anywhere else.

    Texts count as UTF-8 bytes; null and empty ones have none. Matches do not cross documents, but
    may lie in one, and may overlap. Adds n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and kept (the bytes left, unless keep_bytes is off) in place of the text; own columns of these names give way.
    Repeated rows are copies, so all their strings of WINDOW bytes or more repeat.
    """
    outputs = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    spans = repeated_spans(docs, text)
    lists = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    lists = written_table(lists, "span-lists")
    body = F.coalesce(lookup(docs, text).cast("string"), F.lit(""))
    own = [c for c in docs.columns if c != text and c.lower() not in (*outputs, "k1", "k2", "spans", "text")]
    work = docs.select(*[F.col(f"`{c}`") for c in own], body.alias("text"), *text_keys(body))
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BinaryType())
    schema = T.StructType([*[docs.schema[c] for c in own], *map(T.StructField, outputs, kinds)])
    joined = work.join(lists, ["k1", "k2"], "left").drop("k1", "k2")
    if keep_bytes:
        return joined.mapInArrow(_remove, schema)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.drop_columns(["kept"]) for b in _remove(batches))

    return joined.mapInArrow(without, T.StructType(schema.fields[:-1]))
