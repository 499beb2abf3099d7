"""URL expressions. Every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session parameters dropped from URLs, display-name rules.
SESSION_PARAMS = ["jsessionid", "phpsessid", "sid", "aspsessionid[a-z]*"]
NAME_UNWANTED = r"[^-_a-zA-Z0-9%.,;@+=]"
NAME_LENGTH = 100
TWIMG_PREFIX = "https://pbs.twimg.com/media/"
QUORA_PREFIX = "https://www.quora.com/"

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _clean(url: Column) -> Column:
    return F.translate(url, "\t\r\n", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _PARTS, 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _PARTS, 2)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _PARTS, 3)


def url_query(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _PARTS, 4)


def split_url(url: Column) -> Column:
    return F.struct(
        url_scheme(url).alias("scheme"),
        url_netloc(url).alias("netloc"),
        url_path(url).alias("path"),
        url_query(url).alias("query"),
    )


def url_host(url: Column) -> Column:
    """Lower-case host without user info and port."""
    return F.lower(F.regexp_extract(_clean(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def slash_authority(url: Column) -> Column:
    """Text between http(s):// and the next slash; empty when there is none."""
    return F.regexp_extract(url, r"^https?://([^/]*)/", 1)


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def regex_escape(text: Column) -> Column:
    """Put a backslash before each character with a meaning in a regex."""
    return F.regexp_replace(text, r"[()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0b\x0c]", r"\\$0")


def quote_plus(text: Column) -> Column:
    """Form encoding; only letters, digits and _.-~ stay."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def quote(text: Column) -> Column:
    """Percent encoding that keeps slashes."""
    return F.replace(F.replace(quote_plus(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def unquote(text: Column) -> Column:
    """Percent decoding; bad escapes and plus signs stay as they are."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9a-fA-F]{2})", "%25")
    return F.coalesce(F.try_url_decode(kept), text)


def lower_escapes(text: Column) -> Column:
    """Lower-case the %XX escapes and nothing else."""
    parts = F.split(text, "%", -1)
    lowered = F.transform(
        parts,
        lambda p, i: F.when(
            (i > 0) & p.rlike("^[a-fA-F0-9]{2}"),
            F.concat(F.lower(F.substring(p, 1, 2)), p.substr(F.lit(3), F.length(p))),
        ).otherwise(p),
    )
    return F.array_join(lowered, "%")


def md5_url(url: Column) -> Column:
    return F.md5(F.encode(url, "UTF-8"))


def crawl_name(display_url: Column, day: Column, crawl_id: Column) -> Column:
    """Label of a crawl: cleaned URL, UTC day, first eight characters of the id."""
    bare = F.substring(F.rtrim(F.element_at(F.split(display_url, "://", 2), 2), F.lit("/")), 1, NAME_LENGTH)
    cleaned = F.ltrim(F.regexp_replace(bare, NAME_UNWANTED, "-"), F.lit("-"))
    return F.concat_ws("-", cleaned, F.date_format(day, "yyyy-MM-dd"), F.substring(crawl_id, 1, 8))


def claimed_url(first_seed: Column, list_source: Column) -> Column:
    """URL a crawl goes by: first seed, else the list's own URL, else a file:// path."""
    return F.coalesce(
        first_seed,
        F.when(list_source.rlike("^(ftp|https?)://"), list_source).otherwise(F.concat(F.lit("file://"), list_source)),
    )


def orig_image_variant(url: Column) -> Column:
    """Original-size variant of a twimg media URL; null for other URLs."""
    return F.when(
        url.startswith(TWIMG_PREFIX), F.concat(F.regexp_replace(url, ":[a-z]{1,10}$", ""), F.lit(":orig"))
    )


def share_variant(url: Column) -> Column:
    """Login-free variant of a quora URL without a query; null for other URLs."""
    return F.when(url.startswith(QUORA_PREFIX) & ~url.contains("?"), F.concat(url, F.lit("?share=1")))


def strip_session(url: Column) -> Column:
    """Drop session-id parameters from path and query."""
    names = "|".join(SESSION_PARAMS)
    bare = F.regexp_replace(url, rf"(?i);(?:{names})=[^/?#;&]*", "")
    # Possessive: the matcher loops over the parameters and does not recurse.
    head = F.regexp_replace(bare, rf"(?i)\?(?:(?:{names})=[^&#]*+(?:&|(?=#|$)))++", "?")
    tail = F.regexp_replace(head, rf"(?i)&(?:{names})=[^&#]*", "")
    return F.regexp_replace(tail, r"\?(?=#|$)", "")


def escaped_fragment(url: Column) -> Column:
    """Rewrite a hash-bang URL to its crawlable form."""
    base = F.substring_index(url, "#!", 1)
    state = F.element_at(F.split(url, "#!", 2), 2)
    glue = F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.when(url.contains("#!"), F.concat(base, glue, F.lit("_escaped_fragment_="), quote(state))).otherwise(url)


def _normal_path(path: Column) -> Column:
    """Resolve . and .. segments of an absolute path."""
    segments = F.split(path.substr(F.lit(2), F.length(path)), "/", -1)
    last = F.element_at(segments, -1)
    closed = F.when(last.isin(".", ".."), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        closed,
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute form of a link found on a page, without its fragment."""
    ref = strip_fragment(F.trim(link))
    scheme, netloc, path = url_scheme(base), url_netloc(base), url_path(base)
    root = F.concat(scheme, F.lit("://"), netloc)
    ref_path = F.substring_index(ref, "?", 1)
    ref_query = F.when(ref.contains("?"), F.concat(F.lit("?"), F.element_at(F.split(ref, r"\?", 2), 2))).otherwise(F.lit(""))
    folder = F.concat(F.lit("/"), F.regexp_replace(path, "^/|[^/]*$", ""))
    merged = F.when(ref_path.startswith("/"), ref_path).otherwise(F.concat(folder, ref_path))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref == "", strip_fragment(base))
        .when(ref.startswith("?"), F.concat(root, F.when(path == "", F.lit("/")).otherwise(path), ref))
        .otherwise(F.concat(root, _normal_path(merged), ref_query))
    )
