"""As-of lookup of sparse changes: each event gets the values last set at or before it.

Time is cut into buckets that hold only few changes each. A bucket's changes, and one row that
carries in what held before it, become intervals; events meet them by one equality join on the
bucket with a range test. The same plan serves logs of every size, and a crawl with most of the
events is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawlkit.operators.running import running
from trawlkit.session import written_table

# Widths of a bucket, as powers of two of a microsecond: about 19 hours down to one instant.
BUCKET_BITS = (36, 30, 24, 18, 12, 6, 0)
# The widest buckets are taken of which none holds more changes of a group than this.
CHANGES_IN_BUCKET = 64


def micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def bucket_bits(changes: DataFrame, keys: list[str]) -> int:
    """How wide buckets may be. At one instant a group has one change, so some width always does."""
    for bits in BUCKET_BITS[:-1]:
        sizes = changes.groupBy(*keys, F.shiftright("_at", bits)).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= CHANGES_IN_BUCKET:
            return bits
    return BUCKET_BITS[-1]


def _intervals(asked: DataFrame, changes: DataFrame, keys: list[str], values: list[str], bits: int) -> DataFrame:
    """keys, _bucket, _from, _until and the values in force, for buckets with changes or events."""
    placed = changes.withColumn("_bucket", F.shiftright("_at", bits))
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(v) for v in values]
    totals = placed.groupBy(*keys, "_bucket").agg(*last).unionByName(asked, allowMissingColumns=True)
    totals = totals.groupBy(*keys, "_bucket").agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])  # one of the two has them
    carried = running(totals, keys, "_bucket", {f"_held_{v}": ("last", F.col(v)) for v in values}, inclusive=False)
    start = F.shiftleft(F.col("_bucket"), bits) - 1  # before every change of the bucket
    carry_in = carried.select(*keys, "_bucket", start.alias("_at"), *[F.col(f"_held_{v}").alias(v) for v in values])
    line = W.partitionBy(*keys, "_bucket").orderBy("_at")
    so_far = line.rowsBetween(W.unboundedPreceding, 0)
    rows = placed.select(*keys, "_bucket", "_at", *values).unionByName(carry_in)
    filled = [F.last(v, ignorenulls=True).over(so_far).alias(v) for v in values]
    return rows.select(*keys, "_bucket", F.col("_at").alias("_from"), F.lead("_at").over(line).alias("_until"), *filled)


def as_of(events: DataFrame, changes: DataFrame, keys: list[str], values: list[str], at: Column) -> DataFrame:
    """Add `values` as last set at or before `at` (microseconds), null before any.

    changes has keys, _at (microseconds, unique per group) and the values, null where a change does
    not touch one. Own columns of the events with those names give way. Events without a time or
    with a null key get nulls. The events are scanned once more for their buckets.
    """
    taken = {v.lower() for v in values}
    timed = events.select(*[c for c in events.columns if c.lower() not in taken], at.alias("_at"))
    bits = bucket_bits(changes, keys)
    placed = timed.withColumn("_bucket", F.shiftright("_at", bits))
    asked = placed.where(F.col("_at").isNotNull()).select(*keys, "_bucket").distinct()
    # Written out: Spark knows the bytes and broadcasts a small table; the join with a large one
    # stands on plain shuffles, whose hot buckets it can split.
    spans = written_table(_intervals(asked, changes, keys, values, bits), "intervals")
    own, span = placed.alias("own"), spans.alias("span")
    same = [F.col(f"own.{k}") == F.col(f"span.{k}") for k in [*keys, "_bucket"]]
    inside = (F.col("own._at") >= F.col("span._from")) & (F.col("span._until").isNull() | (F.col("own._at") < F.col("span._until")))
    joined = own.join(span, [*same, inside], "left")
    kept = [c for c in timed.columns if c != "_at"]
    return joined.select(*[F.col(f"own.`{c}`") for c in kept], *[F.col(f"span.{v}") for v in values])
