"""Readers of crawl inputs kept as text files, queue tables and key/value logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlkit.functions import urls
from trawlkit.session import broadcast_if_small

USER_SET = "user"
SITEMAP = "/sitemap.xml"


def seed_table(spark: SparkSession, start_urls: list[str], job: str = "job") -> DataFrame:
    """Seeds given as arguments, in order."""
    rows = [(job, i, u) for i, u in enumerate(start_urls)]
    return spark.createDataFrame(rows, "job string, ord bigint, url string")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a newline-delimited list."""
    return spark.read.text(path).where(F.length("value") > 0).select(F.col("value").alias("url"))


def read_pattern_files(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, line_no, pattern) of rule files, one set per file, named after it.

    A file is read whole to number its lines; rule files are short.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn(
        "set_name", F.element_at(F.split(F.col("_metadata.file_path"), "/", -1), -1)
    )
    text = F.btrim(F.col("value"), F.lit("\n"))
    return files.select("set_name", F.posexplode(F.split(text, "\n", -1)).alias("pos", "pattern")).select(
        "set_name", (F.col("pos") + 1).cast("int").alias("line_no"), "pattern"
    )


def read_user_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Rules of one crawl, from its own file."""
    return read_pattern_files(spark, path).withColumn("set_name", F.lit(USER_SET))


def queue_tables(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(queue, url_strings) with the newer column names, from tables of either layout."""
    strings = tables["url_strings"].select("id", "url")
    if "queued_urls" in tables:
        return tables["queued_urls"].select("url_string_id", "status"), strings
    old = tables["urls"]
    return old.select(F.col("url_str_id").alias("url_string_id"), "status"), strings


def sitemap_urls(seeds: DataFrame, responses: DataFrame) -> DataFrame:
    """(job, url) listed in the sitemap.xml at the root of the seeds' sites.

    Broken XML gives the entries that can be read.
    """
    url = F.col("url")
    root = F.concat(urls.url_scheme(url), F.lit("://"), urls.url_netloc(url), F.lit(SITEMAP))
    roots = seeds.select("job", root.alias("url")).distinct()
    # Bodies of other URLs are dropped where they lie, before the join.
    maps = responses.where(url.endswith(SITEMAP))
    found = maps.select("url", F.col("body").cast("string").alias("xml")).join(broadcast_if_small(roots), "url")
    entries = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:[A-Za-z_][\w.-]*:)?loc\s*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</"), 1)
    listed = found.select("job", F.explode(entries).alias("_loc"))
    return listed.select("job", F.replace(F.col("_loc"), F.lit("&amp;"), F.lit("&")).alias("url")).distinct()
