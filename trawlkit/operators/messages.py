"""Messages of a crawl's own results and refusals, with the state of the crawl in each.

Results, queue events and refusals of a crawl are merged by seq. Running counters and the settings
last read are carried along the merged order in bounded spans, so one crawl may hold most rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import values as V
from trawlkit.operators.counters import CLASSES, class_of
from trawlkit.operators.running import running
from trawlkit.operators.settings import SETTINGS, settings_asof

# The fields of job data, in their order.
IDENTITY = ["ident", "url", "started_at"]
JOB_FIELDS = [
    *IDENTITY, "max_content_length", "suppress_ignore_reports", "video", "scrape", "concurrency", "bytes_downloaded", "items_queued",
    "items_downloaded", "delay_min", "delay_max", *CLASSES,
]
COUNTERS = ["bytes_downloaded", "items_queued", "items_downloaded", *CLASSES]
# Settings that the screening of a response reads again; a result reads all of them.
READ_BY_SCREENING = ["max_content_length", "video", "scrape"]


def _own(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _merged(results: DataFrame, queue_events: DataFrame, refusals: DataFrame, controls: DataFrame) -> DataFrame:
    """A row per event in one shape: counter increments, and the settings it reads, null if none."""
    names = list(SETTINGS)
    code = V.result_code(F.col("status_code"), _own(results, "ftp_code", "int"))
    done = results.select(
        "job", "seq", "ts", F.lit("download").alias("type"), "url",
        F.when(F.col("error").isNull(), code).otherwise(F.lit(0)).cast("int").alias("response_code"),
        V.result_message(F.col("error"), _own(results, "reason", "string")).alias("response_message"), F.lit(None).cast("string").alias("pattern"),
        F.coalesce(F.col("body_size"), F.lit(0)).cast("long").alias("bytes_downloaded"), class_of(results).alias("_class"), F.lit("result").alias("_reads"),
    )
    stage = F.when(_own(refusals, "stage", "string") == "response", F.lit("screening"))
    refused = refusals.select("job", "seq", "ts", F.lit("ignore").alias("type"), "url", "pattern", stage.alias("_reads"))
    # Refusals of URLs read nothing, so only the others look settings up.
    reading = settings_asof(done.unionByName(refused.where(F.col("_reads").isNotNull()), allowMissingColumns=True), controls, names)
    read = F.col("_reads") == "result"
    held = {
        "_by_result": F.when(read, F.struct(*[n for n in names if n not in READ_BY_SCREENING])),
        "_by_screening": F.when(read | (F.col("_reads") == "screening"), F.struct(*READ_BY_SCREENING)),
    }
    reading = reading.withColumns(held).drop(*names)
    queue = queue_events.where(F.col("event").isin("queued", "dequeued")).groupBy("job", "seq").agg(
        F.count_if(F.col("event") == "queued").alias("items_queued"), F.count_if(F.col("event") == "dequeued").alias("items_downloaded")
    )
    parts = [queue, reading, refused.where(F.col("_reads").isNull())]
    # At one seq the queue moves first, then the result is handled, then refusals follow.
    turn = F.when(F.col("type").isNull(), 0).when(F.col("type") == "download", 1).otherwise(2)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.withColumn("_place", F.col("seq").cast("long") * 3 + turn)


def make_messages(results: DataFrame, queue_events: DataFrame, refusals: DataFrame, controls: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job, seq, type, url, response_code, response_message, pattern, job_data, payload).

    results(job, seq, ts, url, status_code, error, body_size[, ftp_code, reason]) give a download
    message each, refusals(job, seq, ts, url, pattern[, stage]) an ignore message unless reports are
    suppressed, queue_events(job, seq, event) only count. jobs(job, ident, url, started_at) names the
    crawls; a crawl missing there has nulls. job_data holds the counters up to and with the message,
    and each setting as it was last read: a result reads all settings in force at its time, the
    screening of a response (a refusal of stage `response`) some of them, the refusal of a URL none.
    What was never read has its default. seq is unique within results and within refusals of a crawl;
    of several rows at one seq queue events come first, refusals last. An error's code is 0, whatever
    the response said. Rows without job or seq give no message.
    """
    names = list(SETTINGS)
    merged = _merged(results, queue_events, refusals, controls).where(F.col("job").isNotNull() & F.col("seq").isNotNull())
    values: dict[str, tuple[str, Column]] = {c: ("sum", F.coalesce(F.col(f"_d_{c}"), F.lit(0).cast("long"))) for c in COUNTERS[:3]}
    values |= {c: ("sum", F.coalesce((F.col("_class") == c).cast("long"), F.lit(0).cast("long"))) for c in CLASSES}
    values |= {f"_held{c}": ("last", F.col(c)) for c in ("_by_result", "_by_screening")}
    renamed = merged.withColumnsRenamed({c: f"_d_{c}" for c in COUNTERS[:3]})
    carried = running(renamed, ["job"], "_place", values).where(F.col("type").isNotNull())
    source = {n: "_held_by_screening" if n in READ_BY_SCREENING else "_held_by_result" for n in names}
    state = carried.withColumns({n: F.coalesce(F.col(f"{source[n]}.{n}"), F.lit(SETTINGS[n].default)) for n in names})
    told = state.where((F.col("type") == "download") | ~F.col("suppress_ignore_reports"))
    named = told.join(jobs.select("job", *[F.col(c).alias(f"_job_{c}") for c in IDENTITY]), "job", "left")
    data = F.struct(*[(F.col(f"_job_{c}") if c in IDENTITY else F.col(c)).alias(c) for c in JOB_FIELDS]).alias("job_data")
    shaped = named.select("job", "seq", "type", "url", "response_code", "response_message", "pattern", data)
    return shaped.withColumn("payload", message_json())


def message_json() -> Column:
    """The message as it is sent, with every field of its type, be it null."""
    sent = {"download": ["type", "job_data", "url", "response_code", "response_message"], "ignore": ["type", "job_data", "url", "pattern"]}
    made = [F.when(F.col("type") == kind, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})) for kind, fields in sent.items()]
    return F.coalesce(*made)
