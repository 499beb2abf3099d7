"""Screening of responses before their body is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import headers as H

# Reasons, and statuses that are not retried by default.
TOO_LONG, VIDEO, STREAM_VERSION = "content length", "video", "icy version"
PERMANENT_ERRORS = [401, 403, 404, 405, 410]


def screen_reason(limit: Column, video: Column, ignore_case: bool = True) -> Column:
    """First reason to skip a response, null to take it."""
    heads, url = F.col("headers"), F.col("url")
    return (
        F.when(H.too_long(H.content_length(heads, ignore_case), limit), F.lit(TOO_LONG))
        .when(~video & (H.is_video_type(heads, ignore_case) | H.is_video_url(url)), F.lit(VIDEO))
        .when(F.col("version") == H.STREAM_VERSION, F.lit(STREAM_VERSION))
        .otherwise(H.stream_header_reason(heads, ignore_case))
    )


def verdict_response(
    responses: DataFrame, limit: Column | int = -1, video: Column | bool = True, ignore_case: bool = True
) -> DataFrame:
    """Add `reason` and `taken` to responses(url, version, headers, ...)."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    video = video if isinstance(video, Column) else F.lit(video)
    screened = responses.withColumn("reason", screen_reason(limit, video, ignore_case))
    return screened.withColumn("taken", F.col("reason").isNull())


def skipped_urls(verdicts: DataFrame, reason: str) -> DataFrame:
    return verdicts.where(F.col("reason") == reason).select("url")


def is_permanent_error(status: Column, codes: list[int] | None = None) -> Column:
    return status.isin(PERMANENT_ERRORS if codes is None else codes)
