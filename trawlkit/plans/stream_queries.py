"""Queries that run a stream over a table's files to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlkit.plans import page_queries, result_queries, url_queries
from trawlkit.plans.registry import query
from trawlkit.session import scratch_path
from trawlkit.streaming import flows

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
_PAGES = "page_id bigint, url string, html string"


def _stream(t, name: str, schema: str):
    return flows.named_table_stream(t.spark, t.folder, name, schema)


def _finish(running) -> None:
    running.awaitTermination()


def _paths(t, name: str) -> tuple[str, str]:
    return scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-offsets")


def _fetch_stream(t):
    kind = F.col("event_type")
    status = F.when(kind == "view", 200).when(kind == "click", 302).when(kind == "purchase", 206).when(kind == "signup", 404)
    return _stream(t, "events", _EVENTS).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("job"), F.col("user_id") % 8).alias("job"),
        status.alias("status_code"),
        F.when(kind == "error", F.lit("timeout")).alias("error"),
        F.floor(F.col("value") * 100).alias("body_size"),
    )


@query(
    "st_counters",
    f"SELECT job, CAST(sum(coalesce(body_size, 0)) AS BIGINT) AS bytes_downloaded, {result_queries._class_sql('job')} FROM {{fetches}} GROUP BY job",
)
def st_counters(t):
    path, offsets = _paths(t, "counters")
    _finish(flows.stream_counters(_fetch_stream(t), ["job"], path, offsets))
    return flows.latest_batches(t.spark, path, ["job"])


@query(
    "st_queue_counters",
    """SELECT job, count(*) FILTER (WHERE event = 'queued') AS items_queued, count(*) FILTER (WHERE event = 'dequeued') AS items_downloaded,
         count(*) FILTER (WHERE event = 'queued') - count(*) FILTER (WHERE event = 'dequeued') AS backlog FROM {queue_events} GROUP BY job""",
)
def st_queue_counters(t):
    path, offsets = _paths(t, "queue-counters")
    kind = F.col("event_type")
    event = F.when(kind.isin("view", "click", "signup"), "queued").when(kind == "purchase", "dequeued").otherwise("other")
    events = _stream(t, "events", _EVENTS).select(F.concat(F.lit("job"), F.col("user_id") % 8).alias("job"), event.alias("event"))
    _finish(flows.stream_queue_counters(events, ["job"], path, offsets))
    return flows.latest_batches(t.spark, path, ["job"])


@query("st_ignores", url_queries._verdict_sql())
def st_ignores(t):
    path, offsets = _paths(t, "verdicts")
    job = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)
    candidates = _stream(t, "pages", _PAGES).select(
        job.alias("job"), F.col("page_id").alias("seq"), "url", (~F.col("url").endswith("#top")).alias("verdict")
    )
    _finish(flows.stream_verdicts(candidates, t["seeds"], lambda: t["patterns"], path, offsets))
    return t.spark.read.parquet(path).select("job", "seq", "url", "reason", "accepted", "pattern")


@query("st_rule_versions", url_queries._VERDICT_ASOF)
def st_rule_versions(t):
    path, offsets = _paths(t, "verdicts-asof")
    job = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)
    candidates = _stream(t, "pages", _PAGES).select(
        job.alias("job"), F.col("page_id").alias("seq"), "url", (~F.col("url").endswith("#top")).alias("verdict")
    )
    timed = candidates.join(t["events"].select(F.col("event_id").alias("seq"), "ts"), "seq")
    _finish(flows.stream_verdicts_asof(timed, t["seeds"], lambda: t["rule_versions"], lambda: t["igset_log"], path, offsets))
    return t.spark.read.parquet(path).select("job", "seq", "url", "reason", "accepted", "pattern")


def _page_stream(t):
    return _stream(t, "pages", _PAGES).select(F.col("page_id").alias("seq"), "url", F.col("html").alias("body"))


_PAGE_DIGESTS = page_queries._normal_sql("(SELECT page_id AS seq, url, html AS body FROM {pages}) AS h")
_MARKED = page_queries._marked_sql(f"SELECT seq, url, md5(normal) AS digest FROM ({_PAGE_DIGESTS}) AS n")


def _stream_dupes(t, scope=None):
    path, offsets = _paths(t, "dupes")
    pages = _page_stream(t).withColumn("job", F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)) if scope else _page_stream(t)
    _finish(flows.stream_dupes(pages, scratch_path(t.spark, "digests"), path, offsets, scope))
    return t.spark.read.parquet(path).select(*([scope] if scope else []), "seq", "url", "digest", "dupe_of")


@query(
    "st_dupes",
    f"""SELECT regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS job, seq, url, digest,
          CASE WHEN digest IS NOT NULL AND row_number() OVER w > 1 THEN first_value(url) OVER w END AS dupe_of
        FROM (SELECT seq, url, md5(normal) AS digest FROM ({_PAGE_DIGESTS}) AS n) AS d
        WINDOW w AS (PARTITION BY regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1), digest ORDER BY seq, url)""",
)
def st_dupes(t):
    """Pages are compared within their crawl."""
    return _stream_dupes(t, "job")


@query("dupe_stream", _MARKED.replace("SELECT d.seq, d.url,", "SELECT d.seq,", 1))
def dupe_stream(t):
    return _stream_dupes(t).drop("url")


@query("st_screen", f"SELECT seq, url, {result_queries._REASON.replace(result_queries._LONG, 'false')} AS reason FROM (SELECT event_id AS seq, concat('http://h.example/', props) AS url, event_type AS content_type, CASE WHEN event_type = 'error' THEN 'ICY' ELSE 'HTTP/1.1' END AS version, CASE WHEN event_type = 'view' THEN 'icecast' ELSE 'x' END AS server, CASE WHEN event_type = 'click' THEN 'ICY-name' ELSE 'X-y' END AS extra_name FROM {{events}}) AS h".replace("{{events}}", "{events}"))
def st_screen(t):
    kind = F.col("event_type")
    head = [
        ("X-y", F.lit("1")),
        ("Content-Type", kind),
        ("Server", F.when(kind == "view", F.lit("icecast")).otherwise(F.lit("x"))),
    ]
    listed = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in head])
    named = F.transform(
        listed,
        lambda h: F.struct(
            F.when((h["name"] == "X-y") & (kind == "click"), F.lit("ICY-name")).otherwise(h["name"]).alias("name"), h["value"].alias("value")
        ),
    )
    responses = _stream(t, "events", _EVENTS).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("http://h.example/"), "props").alias("url"),
        F.when(kind == "error", F.lit("ICY")).otherwise(F.lit("HTTP/1.1")).alias("version"),
        named.alias("headers"),
    )
    path, offsets = _paths(t, "screened")
    _finish(flows.stream_screening(responses, path, offsets, video=False))
    return t.spark.read.parquet(path).select("seq", "url", "reason")


@query("st_relay", f"SELECT conn_id, seq, {result_queries._JSON} AS relayed FROM ({result_queries._RELAYED}) AS r")
def st_relay(t):
    source, (path, offsets) = scratch_path(t.spark, "incoming"), _paths(t, "relayed")
    t["telemetry"].write.parquet(source)
    messages = flows.table_stream(t.spark, source, "conn_id string, seq bigint, payload string")
    _finish(flows.stream_relay(messages, scratch_path(t.spark, "connections"), path, offsets))
    return t.spark.read.parquet(path).select("conn_id", "seq", "relayed")
