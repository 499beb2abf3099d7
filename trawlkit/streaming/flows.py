"""Streaming forms of the operators. State lives in tables written per micro-batch.

Each batch writes to a folder named after its id and overwrites it when replayed, so a restart
from the checkpoint repeats no effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trawlkit.operators import counters, dupes, telemetry
from trawlkit.operators.digest_index import DigestIndex
from trawlkit.operators.responses import verdict_response
from trawlkit.operators.rule_versions import verdict_asof
from trawlkit.operators.url_rules import load_rules, verdict_url
from trawlkit.session import written_table

BATCH = "batch_id"
# Batches of the digest index between two compactions.
COMPACT_EVERY = 50


def table_stream(spark: SparkSession, folder: str, schema: str | T.StructType, glob: str = "*.parquet", **options) -> DataFrame:
    """Stream of the parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return reader.options(**options).parquet(folder)


def named_table_stream(spark: SparkSession, folder: str, name: str, schema: str | T.StructType, **options) -> DataFrame:
    """Stream of a folder's table `name`.parquet, which is one file or a folder of files of any names."""
    # The braces make a pattern of the path: a plain path must not be that of a file.
    return table_stream(spark, f"{folder}/{{{name}.parquet}}", schema, "*", **options)


def _batch_folder(path: str, batch: int) -> str:
    return f"{path}/{BATCH}={batch}"


def _written_before(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """Rows of earlier batches; a batch being replayed does not see its own rows."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, {BATCH} bigint").parquet(path)
    return stored.where(F.col(BATCH) < batch).drop(BATCH)


def run(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = True
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    def each(batch_df: DataFrame, batch: int) -> None:
        batch_df.write.mode("overwrite").parquet(_batch_folder(path, batch))

    return run(stream, each, checkpoint, mode, once)


def stream_counters(results: DataFrame, keys: list[str], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Live counters; each batch writes the crawls that changed."""
    return write_batches(counters.job_counters(results, keys), path, checkpoint, "update", once)


def stream_queue_counters(events: DataFrame, keys: list[str], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Live queued, dequeued and backlog; each batch writes the crawls that changed."""
    return write_batches(counters.event_counts(events, keys), path, checkpoint, "update", once)


def latest_batches(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row of each key in a folder of update batches."""
    return counters.latest_snapshot(spark.read.parquet(path), keys, BATCH).drop(BATCH)


def stream_screening(responses: DataFrame, path: str, checkpoint: str, limit=-1, video=True, once: bool = True) -> StreamingQuery:
    """Screening needs no state."""
    return write_batches(verdict_response(responses, limit, video), path, checkpoint, "append", once)


def stream_verdicts(
    candidates: DataFrame, seeds: DataFrame, patterns: Callable[[], DataFrame], path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """URL verdicts; `patterns` is read again for every batch, so edits hold from the next one."""

    def each(batch_df: DataFrame, batch: int) -> None:
        done = verdict_url(batch_df, seeds, load_rules(patterns()))
        done.write.mode("overwrite").parquet(_batch_folder(path, batch))

    return run(candidates, each, checkpoint, once=once)


def stream_verdicts_asof(
    candidates: DataFrame, seeds: DataFrame, versions: Callable[[], DataFrame], controls: Callable[[], DataFrame], path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """URL verdicts under the sets and rules in force at each URL's time; both logs are read again
    for every batch. A replayed batch gives the same rows, also when the logs have grown since."""

    def each(batch_df: DataFrame, batch: int) -> None:
        done = verdict_asof(batch_df, seeds, versions(), controls())
        done.write.mode("overwrite").parquet(_batch_folder(path, batch))

    return run(candidates, each, checkpoint, once=once)


def stream_dupes(
    pages: DataFrame, store: str, path: str, checkpoint: str, scope: str | None = None, compact_every: int = COMPACT_EVERY, once: bool = True
) -> StreamingQuery:
    """Duplicate marks ([scope], seq, url, digest, _scope, dupe_of) of pages; `store` is a digest index.

    With a scope, such as the crawl, pages are compared only within it (a null one is the empty
    text); without one all are. A
    batch reads only the partitions of the index that may hold its digests. Batches before the one
    at hand are committed and are merged every now and then.
    """
    index = DigestIndex(store)
    scopes = [scope] if scope else []

    def each(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        if batch and batch % compact_every == 0:
            index.compact(spark, batch - 1)
        own = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
        digests = written_table(dupes.page_digests(batch_df).select(*scopes, "seq", "url", "digest", own.alias("_scope")), "digests")
        known = index.known(digests.select(F.col("_scope").alias("scope"), "digest"), batch).withColumnRenamed("scope", "_scope")
        # Kept with its scope, so that what enters the index is read from what was given out.
        dupes.mark_dupes(digests, known, ["_scope"]).write.mode("overwrite").parquet(_batch_folder(path, batch))
        fresh = spark.read.parquet(_batch_folder(path, batch)).where(F.col("dupe_of").isNull())
        index.add(dupes.first_seen(fresh, ["_scope"]).withColumnRenamed("_scope", "scope"), batch)

    return run(pages, each, checkpoint, once=once)


def stream_relay(messages: DataFrame, connections: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Relayed messages; `connections` keeps the mode of each connection."""
    schema = "conn_id string, conn_mode string, hello_seq bigint"

    def each(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        decoded = telemetry.decode_messages(batch_df)
        known = _written_before(spark, connections, schema, batch)
        fresh = telemetry.first_hellos(decoded).join(known, "conn_id", "left_anti")
        fresh.write.mode("overwrite").parquet(_batch_folder(connections, batch))
        written = spark.read.schema(schema).parquet(_batch_folder(connections, batch))
        telemetry.relay(decoded, known.unionByName(written)).write.mode("overwrite").parquet(_batch_folder(path, batch))

    return run(messages, each, checkpoint, once=once)
