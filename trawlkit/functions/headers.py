"""Expressions over a response head: headers are array<struct<name, value>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions taken for video, prefixes of audio-stream headers.
VIDEO_EXTENSIONS = ["webm", "mp4", "m4v", "mkv", "ts", "3gp", "3g2", "flv", "mov", "wmv", "ogv", "ogm"]
STREAM_FIELD = r"(?i)^(?:icy-|ice-|x-audiocast-)"
STREAM_SERVER = r"(?i)^icecast"
STREAM_VERSION = "ICY"

_LONG_MAX = 9223372036854775807


def _named(name: Column, wanted: str, ignore_case: bool) -> Column:
    return F.lower(name) == wanted.lower() if ignore_case else name == wanted


def first_header(headers: Column, name: str, ignore_case: bool = True) -> Column:
    hits = F.filter(headers, lambda h: _named(h["name"], name, ignore_case))
    return F.try_element_at(hits, F.lit(1))["value"]


def content_length(headers: Column, ignore_case: bool = True) -> Column:
    """Claimed length; -1 when absent or not an integer."""
    text = F.trim(first_header(headers, "Content-Length", ignore_case))
    return (
        F.when(text.rlike(r"^\+?[0-9]{19,}$"), F.coalesce(text.try_cast("bigint"), F.lit(_LONG_MAX)))
        .when(text.rlike(r"^[+-]?[0-9]{1,18}$"), text.try_cast("bigint"))
        .otherwise(F.lit(-1).cast("bigint"))
    )


def too_long(length: Column, limit: Column) -> Column:
    return (limit != -1) & (length > limit)


def is_video_type(headers: Column, ignore_case: bool = True) -> Column:
    value = F.lower(first_header(headers, "Content-Type", ignore_case))
    return F.coalesce(value.startswith("video/"), F.lit(False))


def is_video_url(url: Column) -> Column:
    """Extension of the whole URL, query included."""
    return F.lower(F.substring_index(url, ".", -1)).isin(VIDEO_EXTENSIONS)


def is_stream_field(name: Column) -> Column:
    return name.rlike(STREAM_FIELD)


def is_stream_server(header: Column, ignore_case: bool = True) -> Column:
    return _named(header["name"], "Server", ignore_case) & header["value"].rlike(STREAM_SERVER)


def has_stream_field(headers: Column) -> Column:
    return F.exists(headers, lambda h: is_stream_field(h["name"]))


def has_stream_server(headers: Column, ignore_case: bool = True) -> Column:
    return F.exists(headers, lambda h: is_stream_server(h, ignore_case))


def stream_header_reason(headers: Column, ignore_case: bool = True) -> Column:
    """Label of the first header, in order, that marks an audio stream; null for none."""
    labels = F.transform(
        headers,
        lambda h: F.when(is_stream_field(h["name"]), F.lit("icy field")).when(
            is_stream_server(h, ignore_case), F.lit("icy server")
        ),
    )
    return F.try_element_at(F.filter(labels, lambda x: x.isNotNull()), F.lit(1))
