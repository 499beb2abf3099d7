"""Duplicate pages by content digest.

Only (scope, digest, url, seq) is shuffled, never a body. First sightings are aggregated, so a
digest shared by a third of all pages costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import bodies as B
from trawlkit.functions import headers as H
from trawlkit.session import broadcast_if_small, lookup_side, written_table

# Fixed value: bodies of this size and above are neither compared nor remembered.
BODY_LIMIT = 30 * 1024 * 1024

_HTML_START = r"(?is)^\s*(?:<!doctype html|<html)"


def is_eligible(body: Column) -> Column:
    return F.octet_length(body) < BODY_LIMIT


def is_html(body: Column, headers: Column | None = None) -> Column:
    """By Content-Type if headers are given, or by how the body begins."""
    starts = B.byte_view(body.cast("binary")).rlike(_HTML_START)
    if headers is None:
        return starts
    kind = F.lower(H.first_header(headers, "Content-Type"))
    return F.coalesce(kind.rlike(r"^\s*(text/html|application/xhtml\+xml)"), F.lit(False)) | starts


def page_digests(pages: DataFrame, html: Column | None = None) -> DataFrame:
    """Add `digest` to pages(url, body, ...): MD5 of the normalised body for HTML, of the body
    otherwise, null for a body over the limit."""
    data = F.col("body").cast("binary")
    flag = is_html(data) if html is None else html
    marked = pages.withColumns({"_fit": is_eligible(data), "_html": flag})
    viewed = marked.withColumn("_view", F.when(F.col("_fit") & F.col("_html"), B.byte_view(data)))
    normal = B.with_normal_view(viewed, "_view", "url", "_normal")
    digest = F.when(F.col("_fit") & F.col("_html"), F.md5(B.view_bytes(F.col("_normal")))).when(F.col("_fit"), F.md5(data))
    return normal.withColumn("digest", digest).drop("_fit", "_html", "_view", "_normal")


def first_seen(digests: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Earliest URL of each digest, and how often the digest occurs."""
    first = F.min(F.struct("seq", "url")).alias("first")
    grouped = digests.where(F.col("digest").isNotNull()).groupBy(*(scope or []), "digest").agg(first, F.count("*").alias("times"))
    return grouped.select(
        *(scope or []), "digest", F.col("first.url").alias("first_url"), F.col("first.seq").alias("first_seq"), "times"
    )


def mark_dupes(digests: DataFrame, known: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """Add `dupe_of` (null for the page kept) to rows that carry a digest.

    `known` (scope..., digest, first_url) holds digests seen in earlier runs. Rows are joined
    only to digests that occur again; a digest with very many rows is split by AQE.
    """
    keys = [*(scope or []), "digest"]
    firsts = first_seen(digests, scope)
    older = F.lit(None).cast("string").alias("_older")
    if known is not None:
        firsts = firsts.join(known.select(*keys, F.col("first_url").alias("_older")), keys, "left")
        older = F.col("_older")
    again = firsts.where((F.col("times") > 1) | older.isNotNull()).select(*keys, "first_url", "first_seq", older)
    marked = digests.join(lookup_side(again), keys, "left")
    dupe_of = F.coalesce(F.col("_older"), F.when(F.col("seq") > F.col("first_seq"), F.col("first_url")))
    return marked.withColumn("dupe_of", dupe_of).drop("first_url", "first_seq", "_older")


def detect_dupes(
    pages: DataFrame,
    enabled: bool = True,
    html: Column | None = None,
    known: DataFrame | None = None,
    scope: list[str] | None = None,
) -> DataFrame:
    """(scope..., seq, url, digest, dupe_of) of pages(seq, url, body); nothing is a dupe when off.

    Digests are written out once: both sides of the join read them and no body is
    normalised twice.
    """
    columns = [*(scope or []), "seq", "url"]
    if not enabled:
        return pages.select(*columns, F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("dupe_of"))
    digests = written_table(page_digests(pages, html).select(*columns, "digest"), "digests")
    return mark_dupes(digests, known, scope).select(*columns, "digest", "dupe_of")


def links_of_fresh_pages(links: DataFrame, marked: DataFrame, key: str = "src", scope: list[str] | None = None) -> DataFrame:
    """Links of pages that are no duplicates; `marked` has (scope..., seq, dupe_of)."""
    keys = [*(scope or []), key]
    dupes = marked.where(F.col("dupe_of").isNotNull()).withColumnRenamed("seq", key).select(*keys).distinct()
    return links.join(broadcast_if_small(dupes), keys, "left_anti")


def stored_bodies(wanted: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodies kept under md5(url), and the URLs that are not there yet."""
    keyed = broadcast_if_small(wanted.select("url").distinct().withColumn("url_md5", F.md5(F.encode("url", "UTF-8"))))
    found = keyed.join(store.select("url_md5", "body"), "url_md5")
    missing = keyed.join(store.select("url_md5"), "url_md5", "left_anti")
    return found, missing
