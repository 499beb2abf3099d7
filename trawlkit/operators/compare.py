"""Comparison of two pages: lengths after normalisation, and lines on one side only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import bodies as B
from trawlkit.functions import urls
from trawlkit.session import lookup_side, written_table

_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_LINE = rf"([^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+)"


def pages_of_pairs(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pages that pairs(left, right) name."""
    named = pairs.select(F.explode(F.array("left", "right")).alias("seq")).distinct()
    return pages.join(lookup_side(named), "seq", "left_semi")


def _side(pages: DataFrame, side: str) -> DataFrame:
    return pages.select(*[F.col(c).alias(f"{c}_{side}") for c in ("seq", "url_md5", "length", "digest")])


def page_compare(pages: DataFrame, pairs: DataFrame, normalize: bool = True) -> DataFrame:
    """For pairs(left, right) of seq in pages(seq, url, body): both URL hashes, both normalised
    lengths, and whether the normalised bodies are the same. Bodies are reduced to a length and
    a digest, written out once, before the joins."""
    data = F.col("body").cast("binary")
    named = pages_of_pairs(pages, pairs)
    ready = B.normalize_body(named, out="_done") if normalize else named.withColumn("_done", data)
    facts = ready.select(
        "seq",
        urls.md5_url(F.col("url")).alias("url_md5"),
        F.octet_length("_done").cast("bigint").alias("length"),
        F.md5("_done").alias("digest"),
    )
    facts = written_table(facts, "facts")
    joined = pairs.join(_side(facts, "left"), F.col("left") == F.col("seq_left")).join(
        _side(facts, "right"), F.col("right") == F.col("seq_right")
    )
    same = (F.col("length_left") == F.col("length_right")) & (F.col("digest_left") == F.col("digest_right"))
    return joined.select("left", "right", "url_md5_left", "url_md5_right", "length_left", "length_right", same.alias("equal"))


def page_lines(text: Column) -> Column:
    """Lines with their ends."""
    return F.regexp_extract_all(text, F.lit(_LINE), 1)


def line_diff(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, line, surplus): how many more times the right page has the line.

    Lines of a page are counted once, then sent to the pairs that need them. Bytes that are no
    UTF-8 become replacement characters.
    """
    text = F.make_valid_utf8(F.col("body").cast("string"))
    lines = pages_of_pairs(pages, pairs).select("seq", F.explode(page_lines(text)).alias("line")).groupBy("seq", "line").agg(F.count("*").alias("n"))
    sides = pairs.select("left", "right", F.col("left").alias("seq"), F.lit(-1).alias("sign")).unionByName(
        pairs.select("left", "right", F.col("right").alias("seq"), F.lit(1).alias("sign"))
    )
    signed = sides.join(lines, "seq")
    surplus = F.sum(F.col("sign") * F.col("n")).alias("surplus")
    return signed.groupBy("left", "right", "line").agg(surplus).where(F.col("surplus") != 0)
