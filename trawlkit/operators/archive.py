"""Layout and index of archive files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import urls
from trawlkit.operators.running import running
from trawlkit.session import lookup_side, written_table

# Fixed value: size near which a file is closed.
FILE_LIMIT = 5368709120


def plan_files(records: DataFrame, keys: list[str], order: str = "seq", size: str = "size", limit: int = FILE_LIMIT) -> DataFrame:
    """Add `file_no`: a record belongs to the file in which its first byte falls."""
    summed = running(records, keys, order, {"_total": ("sum", F.col(size).cast("bigint"))})
    return summed.withColumn("file_no", F.floor((F.col("_total") - F.col(size)) / F.lit(limit)).cast("bigint")).drop("_total")


def place_records(records: DataFrame, order: str = "seq", size: str = "length") -> DataFrame:
    """Add `offset`: bytes of the records before this one in its (job, shard, file_no)."""
    summed = running(records, ["job", "shard", "file_no"], order, {"_total": ("sum", F.col(size).cast("bigint"))})
    return summed.withColumn("offset", F.col("_total") - F.col(size)).drop("_total")


def mark_repeats(records: DataFrame) -> DataFrame:
    """Add is_repeat, refers_url, refers_ts to records(job, shard, seq, url, ts, body).

    A record whose body occurred before in its job refers to the first one, by (seq, shard). Empty and
    null bodies repeat nothing. Only digests meet; bodies are joined with the repeats found, by their keys.
    """
    keys, taken = ["job", "shard", "seq"], ["is_repeat", "refers_url", "refers_ts"]
    body = F.col("body").cast("binary")
    digests = records.where(F.octet_length(body) > 0).select(*keys, "url", "ts", F.sha2(body, 256).alias("_digest"))
    digests = written_table(digests, "digests")
    first = F.min(F.struct("seq", "shard", "url", "ts")).alias("_first")
    firsts = digests.groupBy("job", "_digest").agg(first, F.count("*").alias("_many")).where("_many > 1").drop("_many")
    later = digests.join(lookup_side(firsts), ["job", "_digest"]).where("seq <> _first.seq OR shard <> _first.shard")
    marks = later.select(*keys, F.lit(True).alias("is_repeat"), F.col("_first.url").alias("refers_url"), F.col("_first.ts").alias("refers_ts"))
    marked = records.drop(*taken).join(lookup_side(marks), keys, "left")
    return marked.withColumn("is_repeat", F.coalesce("is_repeat", F.lit(False)))


def url_key(url):
    """Host labels turned round, then the path: the order index readers expect."""
    host = F.array_join(F.reverse(F.split(F.regexp_replace(urls.url_host(url), "^www[0-9]*[.]", ""), "[.]", -1)), ",")
    query = urls.url_query(url)
    tail = F.concat(urls.url_path(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.concat(host, F.lit(")"), F.lower(F.when(tail == "", F.lit("/")).otherwise(tail)))


def archive_index(records: DataFrame, ordered: bool = True) -> DataFrame:
    """(url_key, ts, url, mime, status, digest, length, file) per record, sorted over the whole table; offset too if known."""
    place = [c for c in ("offset",) if c in records.columns]
    index = records.select(url_key(F.col("url")).alias("url_key"), "ts", "url", "mime", "status", "digest", "length", *place, "file")
    return index.orderBy("url_key", "ts", "url") if ordered else index
