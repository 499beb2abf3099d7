"""Packing into length buckets that minimise padding.

Texts become pieces of at most MAX_LENGTH tokens. A dynamic programme over the global histogram
of piece lengths chooses the bucket boundaries with the least padding; inside a bucket, batches
are filled up to a budget of padded tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawlkit.llm.common import MARK
from trawlkit.session import written_table

# Tokens a piece may have; it bounds the histogram.
MAX_LENGTH = 4096
BUCKETS = 12
# Padded tokens a batch may have.
BUDGET = 65_536
# Pieces of one share of a bucket, which one task orders.
SHARE_ROWS = 50_000

OUTPUTS = ("doc_id", "piece", "start", "n_tokens", "bucket", "batch", "slot")


def word_count(text: Column) -> Column:
    """Words as white space divides them; the default count of tokens."""
    return F.size(F.filter(F.split(text, "[ \t\n\u000b\f\r]+"), lambda w: w != ""))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding in total.

    lengths ascend and are distinct. best[k][j] is the least padded size of the first j lengths in
    k buckets; of equal choices the one whose last bucket starts first is taken.
    """
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    best = np.concatenate([[0], lengths.astype(np.int64) * total[1:]])
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        now, cut = best.copy(), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (total[j] - total[:j])
            cut[j] = int(np.argmin(cost))
            now[j] = cost[cut[j]]
        best = now
        cuts.append(cut)
    found, j = [], n
    for cut in reversed(cuts):
        if j <= 0:
            break
        found.append(int(lengths[j - 1]))
        j = int(cut[j])
    return found[::-1]


def pieces_of(docs: DataFrame, doc_id: str, n_tokens: Column, max_length: int) -> DataFrame:
    """A row per piece: ids and lengths, without texts."""
    counted = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(n_tokens, F.lit(0)).cast("long").alias(f"{MARK}n"))
    last = F.floor((F.col(f"{MARK}n") - 1) / max_length).cast("int")
    cut = counted.where(F.col(f"{MARK}n") > 0).select("doc_id", f"{MARK}n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = (F.col("piece") * max_length).cast("long")
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(max_length).cast("long"), F.col(f"{MARK}n") - start).alias("n_tokens"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_tokens: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, max_length: int = MAX_LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, n_tokens, bucket, batch, slot.

    bucket is the length its pieces are padded to. batch counts from 0 in its bucket and holds
    budget div bucket pieces (one, if a single piece is over the budget); only a bucket's last batch
    is not full. Every token of a text is in one piece. Texts without words, empty and null ones,
    have no piece. Repeated rows are packed as often as they occur; ties go by doc_id, piece and
    length. n_tokens replaces the count of words.
    """
    counted = word_count(F.col(f"`{text}`")) if n_tokens is None else n_tokens
    pieces = written_table(pieces_of(docs, doc_id, counted, max_length), "pieces")
    # At most max_length rows reach the driver.
    rows = pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    lengths, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    bounds = boundaries(lengths, counts, buckets)
    bucket = F.lit(None).cast("long")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound).cast("long")).otherwise(bucket)
    # A bucket may hold most rows: shares of it are ordered apart, and each adds what comes before it.
    shares = int(max(1, counts.sum() // SHARE_ROWS)) if len(counts) else 1
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares))
    placed = pieces.select("*", bucket.alias("bucket"), share.alias(f"{MARK}share"))
    sizes = placed.groupBy("bucket", f"{MARK}share").agg(F.count("*").alias(f"{MARK}size"))
    before = Window.partitionBy("bucket").orderBy(f"{MARK}share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", f"{MARK}share", F.coalesce(F.sum(f"{MARK}size").over(before), F.lit(0)).alias(f"{MARK}before"))
    own = Window.partitionBy("bucket", f"{MARK}share").orderBy("doc_id", "piece", "n_tokens")
    ranked = placed.withColumn(f"{MARK}rank", F.row_number().over(own)).join(offsets, ["bucket", f"{MARK}share"])
    place = F.col(f"{MARK}rank") - 1 + F.col(f"{MARK}before")
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")))
    return ranked.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", F.floor(place / room).alias("batch"), (place % room).cast("int").alias("slot")
    )
