"""Running values along a group in order, without putting a whole group into one task.

The order column is a whole number, unique within the group. It is cut into spans of 2**20
values, so no span holds more rows than that however large its group is. Spans are summed
first (combined before the shuffle), their running totals are found the same way one level up,
and rows only add what precedes their span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN_BITS = 20


def _so_far(kind: str, column: Column) -> Column:
    """Over the rows of a window, which stand in order."""
    return {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[kind](column)


def _total(kind: str, column: Column, order: str) -> Column:
    if kind == "last":
        return F.max_by(column, F.when(column.isNotNull(), F.col(order)))
    return F.sum(column) if kind == "sum" else F.max(column)


def _before(df: DataFrame, keys: list[str], order: str, names: dict[str, str], level: int) -> DataFrame:
    """For rows unique by (keys, order): merge of `names` over all earlier rows of the group."""
    span = f"_span{level}"
    parts = [*keys, span] if level else keys
    back = W.partitionBy(*parts).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    staged = df.withColumn(span, F.shiftright(F.col(order), SPAN_BITS))
    inner = staged.withColumns({f"_in_{n}": _so_far(kind, F.col(n)).over(back) for n, kind in names.items()})
    if not level:
        return inner.select(*keys, order, *[F.col(f"_in_{n}").alias(n) for n in names])
    carried = _carried(staged, keys, order, span, {n: (kind, F.col(n)) for n, kind in names.items()}, level)
    return _combine(inner.join(carried, parts, "left"), names).select(*keys, order, *names)


def _carried(df: DataFrame, keys: list[str], order: str, span: str, values: dict[str, tuple[str, Column]], level: int) -> DataFrame:
    """What precedes each span of each group."""
    totals = df.groupBy(*keys, span).agg(*[_total(kind, expr, order).alias(n) for n, (kind, expr) in values.items()])
    names = {n: kind for n, (kind, _) in values.items()}
    before = _before(totals, keys, span, names, level - 1)
    return before.select(*keys, span, *[F.col(n).alias(f"_up_{n}") for n in names])


def _combine(df: DataFrame, names: dict[str, str]) -> DataFrame:
    out = {}
    for n, kind in names.items():
        up, own = F.col(f"_up_{n}"), F.col(f"_in_{n}")
        # What is in the span comes after what was carried into it.
        out[n] = {"sum": F.coalesce(up + own, up, own), "max": F.greatest(up, own), "last": F.coalesce(own, up)}[kind]
    return df.withColumns(out)


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Add running values: {name: ("sum" | "max" | "last", expression)} over the rows up to this one.

    The last value is the last that is not null.

    With `inclusive=False` the row itself does not count, and the first row gets null.
    Two levels of spans leave at most 2**24 totals per group for any 64-bit order value.
    """
    names = {name: kind for name, (kind, _) in values.items()}
    span = "_span2"
    staged = df.withColumns({f"_v_{n}": expr for n, (_, expr) in values.items()}).withColumn(
        span, F.shiftright(F.col(order), SPAN_BITS)
    )
    frame = W.partitionBy(*keys, span).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    inner = staged.withColumns({f"_in_{n}": _so_far(kind, F.col(f"_v_{n}")).over(frame) for n, kind in names.items()})
    carried = _carried(staged, keys, order, span, {n: (kind, F.col(f"_v_{n}")) for n, kind in names.items()}, 2)
    joined = inner.join(carried, [*keys, span], "left")
    drops = [span, *[f"_{p}_{n}" for n in names for p in ("v", "in", "up")]]
    return _combine(joined, names).drop(*drops)
