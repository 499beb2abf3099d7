"""Counters per crawl. Aggregates combine before the shuffle; running forms use spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import values as V
from trawlkit.operators.running import running

# Counter names and retry rule.
CLASSES = ["r1xx", "r2xx", "r3xx", "r4xx", "r5xx", "runk"]
TRIES = 3


def class_of(results: DataFrame) -> Column:
    """Class of results(status_code, error) or results(status_code, ftp_code, error)."""
    ftp = F.col("ftp_code") if "ftp_code" in results.columns else None
    return V.status_class(V.result_code(F.col("status_code"), ftp), F.col("error"))


def class_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    counted = [F.count_if(F.col("_class") == c).alias(c) for c in CLASSES]
    return results.withColumn("_class", class_of(results)).groupBy(*keys).agg(*counted)


def bytes_downloaded(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.sum(F.coalesce(F.col("body_size"), F.lit(0))).alias("bytes_downloaded"))


def event_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """items_queued, items_downloaded and the backlog of crawls, from events(event, ...)."""
    queued, left = F.count_if(F.col("event") == "queued"), F.count_if(F.col("event") == "dequeued")
    return events.groupBy(*keys).agg(
        queued.alias("items_queued"), left.alias("items_downloaded"), (queued - left).alias("backlog")
    )


def job_counters(results: DataFrame, keys: list[str]) -> DataFrame:
    """All counters of a crawl in one pass over its results."""
    counted = [F.count_if(F.col("_class") == c).alias(c) for c in CLASSES]
    size = F.sum(F.coalesce(F.col("body_size"), F.lit(0))).alias("bytes_downloaded")
    return results.withColumn("_class", class_of(results)).groupBy(*keys).agg(size, *counted)


def running_counters(results: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Counters as of each result, the result itself included."""
    values = {"bytes_downloaded": ("sum", F.coalesce(F.col("body_size"), F.lit(0)))}
    for c in CLASSES:
        values[c] = ("sum", (F.col("_class") == c).cast("bigint"))
    return running(results.withColumn("_class", class_of(results)), keys, order, values).drop("_class")


def latest_snapshot(messages: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each crawl."""
    rest = [c for c in messages.columns if c not in (*keys, order)]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("last")
    return messages.groupBy(*keys).agg(last, F.max(order).alias(order)).select(*keys, order, "last.*")


def attempts(results: DataFrame, keys: list[str], permanent: Column, ok: Column, order: str = "seq") -> DataFrame:
    """Tries of each URL and where they leave it: done, error, or back to todo."""
    last = F.max_by(F.struct(ok.alias("ok"), permanent.alias("permanent")), F.col(order)).alias("last")
    grouped = results.groupBy(*keys).agg(F.count("*").alias("tries"), last)
    state = (
        F.when(F.col("last.ok"), F.lit("done"))
        .when(F.col("last.permanent") | (F.col("tries") >= TRIES), F.lit("error"))
        .otherwise(F.lit("todo"))
    )
    return grouped.select(*keys, "tries", state.alias("status"))
