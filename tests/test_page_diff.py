"""Ordered diff: a plain implementation of the same rule, replay of the hunks, unified form."""

import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from trawlkit.operators import page_diff as P

SCHEMA = "seq bigint, body binary, line string"


def plain(a: list, b: list, x: int = 0, y: int = 0) -> list[tuple[int, int]]:
    """Aligned places: equal ends, then the longest common order of lines single on both sides, then the gaps."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(x, y), *plain(a[1:], b[1:], x + 1, y + 1)]
    if a[-1] == b[-1]:
        return [*plain(a[:-1], b[:-1], x, y), (x + len(a) - 1, y + len(b) - 1)]
    single = [(i, b.index(v)) for i, v in enumerate(a) if a.count(v) == 1 and b.count(v) == 1]
    if not single:
        return []
    best = []
    for k, (_, j) in enumerate(single):
        best.append(1 + max([best[m] for m in range(k) if single[m][1] < j], default=0))
    # Of runs equally long the one with the least places, from its end.
    run, level, before = [], max(best), len(single)
    while level:
        before = min((m for m in range(before) if best[m] == level), key=lambda m: single[m][1])
        run.append(single[before])
        level -= 1
    out, i0, j0 = [], 0, 0
    for i, j in [*run[::-1], (len(a), len(b))]:
        out += plain(a[i0:i], b[j0:j], x + i0, y + j0) + ([(x + i, y + j)] if i < len(a) else [])
        i0, j0 = i + 1, j + 1
    return out


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    left, right = set(range(len(a))), set(range(len(b)))
    for a0, a1, b0, b1 in P.edits(np.array(a, int), np.array(b, int)):
        left -= set(range(a0, a1))
        right -= set(range(b0, b1))
    return list(zip(sorted(left), sorted(right), strict=True))


def test_alignment_equals_a_plain_implementation():
    dice = random.Random(3)
    for _ in range(1500):
        kinds = dice.choice([2, 4, 12, 40])
        a = [dice.randrange(kinds) for _ in range(dice.randrange(25))]
        b = [dice.randrange(kinds) for _ in range(dice.randrange(25))]
        if dice.random() < 0.5:
            b = [v for v in a if dice.random() < 0.8]
            b.insert(dice.randrange(len(b) + 1), 99)
        found = aligned(a, b)
        assert found == plain(a, b)
        assert all(a[i] == b[j] for i, j in found)


def as_pages(spark, bodies: list):
    return spark.createDataFrame([(i, None if b is None else bytearray(b), "own") for i, b in enumerate(bodies)], SCHEMA)


def edited(dice: random.Random, lines: list[bytes]) -> list[bytes]:
    out = []
    for line in lines:
        if dice.random() > 0.06:
            out.append(line)
        if dice.random() < 0.06:
            out.append(b"new %d\n" % dice.randrange(10**9))
    return out


def test_unified_form_equals_the_standard_library(spark):
    """Where no line repeats or moves there is one shortest diff."""
    dice = random.Random(8)
    bodies = []
    for k in range(60):
        lines = [b"line %d of %d \xc3\xa9\n" % (i, k) for i in range(dice.randrange(150))]
        bodies += [b"".join(lines), b"".join(edited(dice, lines))]
    bodies += [b"", b"one\ntwo\n", b"a\nb", b"a\nc", b"same\n", b"same\n", b"x\r\ny\rz\n", b"x\r\ny\rq\n", b"bad \xff\n", b"bad \xfe\n", b"", b""]
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, len(bodies), 2)], "left int, right int")
    for context in (1, 3):
        texts: dict = {}
        for row in P.unified(P.page_diff(as_pages(spark, bodies), pairs, context)).orderBy("left", "hunk").collect():
            texts[row.left] = texts.get(row.left, "") + row.text
        for i in range(0, len(bodies), 2):
            sides = [bodies[k].decode("utf-8", "replace").splitlines(keepends=True) for k in (i, i + 1)]
            wanted = [line if "\n" in line else line + "\n" for line in list(difflib.unified_diff(*sides, n=context))[2:]]
            assert texts.get(i, "") == "".join(wanted)


def test_hunks_turn_left_into_right(spark):
    dice = random.Random(5)
    words = [b"%d\n" % k for k in range(9)]
    bodies = [b"".join(dice.choice(words) for _ in range(dice.randrange(40))) for _ in range(30)]
    pairs = spark.createDataFrame([(i, j) for i in range(30) for j in (i, (i * 7 + 1) % 30)], "left bigint, right bigint")
    rows = P.page_diff(as_pages(spark, bodies), pairs.unionByName(pairs), 2).orderBy("left", "right", "hunk", "pos").collect()
    split = [b.decode().splitlines(keepends=True) for b in bodies]
    for i, j in {(r.left, r.right) for r in pairs.collect()}:
        out, at = [], 0
        for row in (r for r in rows if (r.left, r.right) == (i, j)):
            if row.tag == "+":
                out.append(row.line)
                assert row.right_no == len(out) or row.left_no is None
            else:
                out += split[i][at : row.left_no - 1]
                assert row.line == split[i][row.left_no - 1]
                at = row.left_no
                out += [row.line] if row.tag == " " else []
            if row.tag != "-":
                assert row.line == split[j][row.right_no - 1] and row.right_no == len(out)
        assert out + split[i][at:] == split[j]


def test_nulls_missing_pages_and_extra_columns(spark):
    pages = as_pages(spark, [None, b"a\n", b"a\n"])
    pairs = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (1, 9), (None, 1), (1, None)], "left bigint, right bigint").withColumn("body", F.lit("own"))
    found = sorted((r.left, r.right, r.tag, r.line) for r in P.page_diff(pages, pairs).collect())
    assert found == [(0, 1, "+", "a\n"), (1, 0, "-", "a\n")]
    assert P.page_diff(pages.limit(0), pairs).count() == P.page_diff(pages, pairs.limit(0)).count() == 0


def test_long_pages(spark):
    """200,000 lines a page, one of them changed, and a page of one line of 5,000,000 characters."""
    lines = [b"%d\n" % i for i in range(200_000)]
    other = [*lines[:100_000], b"changed\n", *lines[100_001:]]
    pages = as_pages(spark, [b"".join(lines), b"".join(other), b"x" * 5_000_000, b"x" * 4_999_999])
    rows = P.page_diff(pages, spark.createDataFrame([(0, 1), (2, 3)], "left bigint, right bigint"), 1).orderBy("left", "pos").collect()
    assert [(r.tag, r.left_no, r.right_no) for r in rows] == [
        (" ", 100_000, 100_000), ("-", 100_001, None), ("+", None, 100_001), (" ", 100_002, 100_002), ("-", 1, None), ("+", None, 1),
    ]
