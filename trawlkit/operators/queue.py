"""Inspection of the URL queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of a queued URL.
STATUSES = ["done", "error", "in_progress", "skipped", "todo"]


def with_status(queue: DataFrame, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}, use one of {', '.join(STATUSES)}")
    return queue.where(F.col("status") == status)


def queue_urls(queue: DataFrame, url_strings: DataFrame) -> DataFrame:
    """(url, status) of every queued URL."""
    strings = url_strings.select(F.col("id").alias("url_string_id"), "url")
    return queue.select("url_string_id", "status").join(strings, "url_string_id").select("url", "status")


def dump_queue(queue: DataFrame, url_strings: DataFrame, status: str, ordered: bool = False) -> DataFrame:
    found = queue_urls(with_status(queue, status), url_strings).select("url")
    return found.orderBy("url") if ordered else found
