"""Links out of page bodies, and extra links some sites need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import urls
from trawlkit.functions.markup import decode_entities
from trawlkit.functions.pinned import with_pinned

# Possessive runs: the matcher neither recurses nor goes back, however long a tag is. A tag that
# nothing closes, or whose quote nothing closes, is taken to the end of the text and is no tag, so
# that no search starts again inside it: a text is read once, however many tags stay open.
_INSIDE = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_OPEN = rf"{_INSIDE}(?:[\"'].*+)?+\z"


def _tag(names: str) -> str:
    """Group 1 is the tag, empty for one left open."""
    return rf"(?is)(<(?:{names})\b{_INSIDE}>)|<(?:{names})\b{_OPEN}"


_TAG = _tag("a|area|img|script|link|source|video|audio|iframe|embed")
_BASE = _tag("base")
# A candidate of a srcset: a run without white space, whose commas at the end part it from the next;
# else its descriptors go on to the next comma outside of parentheses.
_CANDIDATE = r"[\s,]*+([^\s,](?:\S*[^\s,])?)(?:,++(?=\s|$)|(?=\s|$)(?:[^,(]++|\([^)]*+\)?+)*+)"
_ATTR = r"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_INLINE_TAGS = ["img", "script", "link", "source", "video", "audio", "embed"]
_MEDIA_TAGS = ["img", "source", "video", "audio", "embed"]


def _attr(tag, name: str):
    pattern = _ATTR.replace("{name}", name)
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _plain(text):
    return decode_entities(F.trim(text))


def extract_links(pages: DataFrame, page: str = "seq", body: str = "body", scope: list[str] | None = None) -> DataFrame:
    """(scope..., page, url, base, ord, link, link_type, inline) for href, src and srcset of page tags.

    base is what the page's links are relative to: its first <base href>, else its own URL. ord
    ascends in the order of the page. Entities are decoded.
    """
    keys = [*(scope or []), page, "url", "base"]
    text = F.col(body).cast("string")
    href = _plain(_attr(F.regexp_extract(text, _BASE, 1), "href"))
    base = F.when(text.rlike("(?i)<base\\b") & (href != ""), urls.resolve_url(F.col("url"), href)).otherwise(F.col("url"))
    based = with_pinned(pages.drop("base").withColumn("_text", text), base=base)
    tags = based.select(*keys, F.posexplode(F.array_remove(F.regexp_extract_all("_text", F.lit(_TAG), 1), "")).alias("_pos", "_tag"))
    name = F.lower(F.regexp_extract("_tag", r"^<([A-Za-z]+)", 1))
    targets = F.flatten(
        F.array(
            F.array(_attr(F.col("_tag"), "(?:href|src)")),
            F.regexp_extract_all(_attr(F.col("_tag"), "srcset"), F.lit(_CANDIDATE), 1),
        )
    )
    named = tags.withColumns({"_name": name, "_links": F.filter(targets, lambda t: F.trim(t) != "")})
    opened = named.select(*keys, "_pos", "_name", F.posexplode("_links").alias("_sub", "_raw"))
    kind = (
        F.when(F.col("_name").isin(_MEDIA_TAGS), F.lit("media"))
        .when(F.col("_name") == "script", F.lit("javascript"))
        .when(F.col("_name") == "link", F.lit("css"))
        .otherwise(F.lit("html"))
    )
    return opened.select(
        *keys,
        (F.shiftleft(F.col("_pos").cast("bigint"), 32) + F.col("_sub")).alias("ord"),
        _plain(F.col("_raw")).alias("link"),
        kind.alias("link_type"),
        F.col("_name").isin(_INLINE_TAGS).alias("inline"),
    )


def resolve_links(links: DataFrame, base: str | None = None, link: str = "link", out: str = "dst_url") -> DataFrame:
    """Add the absolute link; links that are no page address (mailto:, javascript:) are dropped.

    Links are relative to the column base, where there is none to url.
    """
    base = base or ("base" if "base" in links.columns else "url")
    resolved = with_pinned(links, **{out: urls.resolve_url(F.col(base), F.col(link))})
    return resolved.where(F.col(out).rlike("^(?i)(https?|ftp)://"))


def extra_links(pages: DataFrame) -> DataFrame:
    """(url, dst_url, link_type, inline) of variants worth queueing besides the page's own links."""
    url = F.col("url")
    image, share = urls.orig_image_variant(url), urls.share_variant(url)
    variants = F.array(
        F.struct(image.alias("dst_url"), F.lit("media").alias("link_type"), F.lit(True).alias("inline")),
        F.struct(share.alias("dst_url"), F.lit("html").alias("link_type"), F.lit(False).alias("inline")),
    )
    return (
        pages.where(image.isNotNull() | share.isNotNull())
        .select("url", F.explode(variants).alias("extra"))
        .where(F.col("extra.dst_url").isNotNull())
        .select("url", "extra.*")
    )


def rule_links(pages: DataFrame, rules: list[tuple[str, str, str, str, str, bool]]) -> DataFrame:
    """Extra links by own rules: (prefix, must not contain, regex removed, suffix, link type, inline)."""
    url = F.col("url")
    made = []
    for prefix, without, removed, suffix, kind, inline in rules:
        applies = url.startswith(prefix) if not without else url.startswith(prefix) & ~url.contains(without)
        base = F.regexp_replace(url, removed, "") if removed else url
        made.append(
            F.when(
                applies,
                F.struct(
                    F.concat(base, F.lit(suffix)).alias("dst_url"),
                    F.lit(kind).alias("link_type"),
                    F.lit(inline).alias("inline"),
                ),
            )
        )
    if not made:
        raise ValueError("no rules given")
    return pages.select("url", F.explode(F.array_compact(F.array(*made))).alias("extra")).select("url", "extra.*")


def queue_form(links: DataFrame, column: str = "dst_url") -> DataFrame:
    """Links as they enter the queue: session ids dropped, hash-bang states made crawlable."""
    return links.withColumn(column, urls.strip_session(urls.escaped_fragment(F.col(column))))
