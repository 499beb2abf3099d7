"""Ordered diff of two pages: hunks of removed, added and context lines.

Lines are aligned where both pages begin and end alike and at lines that occur once on either side, as far as
those stand in the same order (their longest increasing run); the gaps between are aligned the same way. In a
gap without such lines all of the left is removed and all of the right added. Pairs meet pages as arrays of line
digests, one row a page; texts of lines are fetched only for the lines that hunks hold.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.operators.compare import page_lines, pages_of_pairs
from trawlkit.session import written_table

CONTEXT = 3
# Lines of hunks a batch holds.
PORTION = 65_536


def _rising(places: np.ndarray) -> list[int]:
    """Indices of a longest increasing run of distinct numbers."""
    ends, at, back = [], [], []
    for k, place in enumerate(places.tolist()):
        slot = bisect_left(ends, place)
        back.append(at[slot - 1] if slot else -1)
        if slot == len(ends):
            ends.append(place)
            at.append(k)
        else:
            ends[slot], at[slot] = place, k
    run, k = [], at[-1] if at else -1
    while k >= 0:
        run.append(k)
        k = back[k]
    return run[::-1]


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries two arrays have in common at their start."""
    short = min(len(a), len(b))
    other = np.flatnonzero(a[:short] != b[:short])
    return int(other[0]) if len(other) else short


def _single(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, first, many = np.unique(lines, return_index=True, return_counts=True)
    return values[many == 1], first[many == 1]


def edits(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(from, to) in a and (from, to) in b of what differs, in order; lines are numbers."""
    open_, kept = [(0, len(a), 0, len(b))], []
    while open_:
        a0, a1, b0, b1 = open_.pop()
        head = _alike(a[a0:a1], b[b0:b1])
        kept.append((a0, b0, head))
        a0, b0 = a0 + head, b0 + head
        tail = _alike(a[a0:a1][::-1], b[b0:b1][::-1])
        a1, b1 = a1 - tail, b1 - tail
        kept.append((a1, b1, tail))
        if a0 == a1 or b0 == b1:
            continue
        (mine, at_a), (other, at_b) = _single(a[a0:a1]), _single(b[b0:b1])
        _, i, j = np.intersect1d(mine, other, assume_unique=True, return_indices=True)
        order = np.argsort(at_a[i])
        left, right = at_a[i][order] + a0, at_b[j][order] + b0
        run = _rising(right)
        for k in run:
            x, y = int(left[k]), int(right[k])
            kept.append((x, y, 1))
            if x > a0 or y > b0:
                open_.append((a0, x, b0, y))
            a0, b0 = x + 1, y + 1
        if run:
            open_.append((a0, a1, b0, b1))
    found, x, y = [], 0, 0
    for i, j, n in sorted(k for k in kept if k[2]):
        if i > x or j > y:
            found.append((x, i, y, j))
        x, y = i + n, j + n
    if x < len(a) or y < len(b):
        found.append((x, len(a), y, len(b)))
    return found


def hunks(a: np.ndarray, b: np.ndarray, context: int = CONTEXT) -> Iterator[list[tuple[str, int | None, int | None]]]:
    """Lists of (tag, place in a, place in b); changes at most twice the context apart share one."""
    group: list = []
    for change in [*edits(a, b), None]:
        if group and (change is None or change[0] - group[-1][1] > 2 * context):
            lead = min(context, group[0][0])
            lines = [(" ", group[0][0] - k, group[0][2] - k) for k in range(lead, 0, -1)]
            for at, (a0, a1, b0, b1) in enumerate(group):
                if at:
                    _, x, _, y = group[at - 1]
                    lines += [(" ", x + k, y + k) for k in range(a0 - x)]
                lines += [("-", k, None) for k in range(a0, a1)] + [("+", None, k) for k in range(b0, b1)]
            _, x, _, y = group[-1]
            lines += [(" ", x + k, y + k) for k in range(min(context, len(a) - x))]
            yield lines
            group = []
        if change is not None:
            group.append(change)


def _placed(context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("left", "right", "hunk", "pos", "tag", "left_no", "right_no")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

        held = []
        for batch in batches:
            for at in range(batch.num_rows):
                left, right = batch.column("left")[at].as_py(), batch.column("right")[at].as_py()
                sides = [batch.column(c)[at].values for c in ("lines_left", "lines_right")]
                both = pa.concat_arrays(sides).dictionary_encode().indices.to_numpy()
                cut = len(sides[0])
                for number, lines in enumerate(hunks(both[:cut], both[cut:], context), 1):
                    for pos, (tag, x, y) in enumerate(lines):
                        held.append((left, right, number, pos, tag, None if x is None else x + 1, None if y is None else y + 1))
                        if len(held) >= PORTION:
                            yield batch_of(held)
                            held = []
        if held:
            yield batch_of(held)

    return run


def page_diff(pages: DataFrame, pairs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(left, right, hunk, pos, tag, left_no, right_no, line) per line of a hunk, for pairs(left, right) of seq in pages(seq, body).

    tag is ' ', '-' or '+'; hunks count from 1, places in them from 0, line numbers from 1 and are null on the
    side that lacks the line. Lines keep their ends. seq is unique. Equal pages, pairs with a page that is not there
    and pairs with a null give no rows; a null body is an empty page; repeated pairs count once. Bytes that are
    no UTF-8 become replacement characters.
    """
    wanted = pairs.select(F.col("left").cast("bigint").alias("left"), F.col("right").cast("bigint").alias("right")).dropna().distinct()
    text = F.make_valid_utf8(F.coalesce(F.col("body").cast("string"), F.lit("")))
    near = pages_of_pairs(pages, wanted)
    cut = written_table(near.select(F.col("seq").cast("bigint").alias("seq"), page_lines(text).alias("lines")), "cut")
    digests = cut.select("seq", F.transform("lines", lambda line: F.unhex(F.md5(line))).alias("digests"))
    side = lambda name: digests.select(F.col("seq").alias(name), F.col("digests").alias(f"lines_{name}"))
    met = wanted.join(side("left"), "left").join(side("right"), "right").select("left", "right", "lines_left", "lines_right")
    kinds = "left bigint, right bigint, hunk int, pos int, tag string, left_no int, right_no int"
    placed = written_table(met.mapInArrow(_placed(context), kinds), "hunks")
    origin = placed.withColumns({"seq": F.when(F.col("tag") == "+", F.col("right")).otherwise(F.col("left")), "no": F.coalesce(F.when(F.col("tag") == "+", F.col("right_no")), "left_no")})
    lines = cut.select("seq", F.posexplode("lines").alias("at", "line")).select("seq", (F.col("at") + 1).alias("no"), "line")
    return origin.join(lines, ["seq", "no"]).select("left", "right", "hunk", "pos", "tag", "left_no", "right_no", "line")


def _range(first: str, many: str):
    """Start and length of a hunk's lines on a side, as unified diffs state them."""
    start = F.col(first)
    return F.when(F.col(many) == 1, start.cast("string")).otherwise(F.concat_ws(",", start, many))


def unified(diff: DataFrame) -> DataFrame:
    """(left, right, hunk, text) per hunk of `page_diff`: its header and lines as a unified diff has them.

    A line without a newline gets one. Holds for a context of 1 or more, where only an empty page has no line in a hunk.
    """
    keys = ["left", "right", "hunk"]
    sides = {}
    for name, lost in (("left", "+"), ("right", "-")):
        number = F.col(f"{name}_no")
        sides[f"{name}_many"] = F.count_if(F.col("tag") != lost)
        sides[f"{name}_first"] = F.coalesce(F.min(number), F.lit(0))
    shown = F.concat("tag", "line", F.when(F.col("line").contains("\n"), "").otherwise("\n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown")))), lambda r: r["shown"]), "")
    made = diff.groupBy(*keys).agg(*[c.alias(n) for n, c in sides.items()], listed.alias("body"))
    header = F.concat(F.lit("@@ -"), _range("left_first", "left_many"), F.lit(" +"), _range("right_first", "right_many"), F.lit(" @@\n"))
    return made.select(*keys, F.concat(header, "body").alias("text"))
