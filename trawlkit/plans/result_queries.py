"""Queries over responses and results: screening, counters, settings over time, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlkit.functions import headers as H
from trawlkit.functions import values as V
from trawlkit.operators import counters as C
from trawlkit.operators import messages as M
from trawlkit.operators import responses as R
from trawlkit.operators import settings as S
from trawlkit.operators import telemetry as T
from trawlkit.plans.registry import add, query
from trawlkit.session import scratch_path

# Screening.

LIMIT = 70000


def responses(t):
    """Response heads with an ordered header list; a length of `none` stands for no header."""
    heads = t["heads"]
    length = F.when(F.col("content_length") != "none", F.struct(F.lit("Content-Length").alias("name"), F.col("content_length").alias("value")))
    rest = [("content-type", F.col("content_type")), ("Server", F.col("server"))]
    listed = [F.struct(F.col("extra_name").alias("name"), F.lit("1").alias("value")), length]
    listed += [F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in rest]
    return heads.select("seq", "ts", "job", "url", "version", F.array_compact(F.array(*listed)).alias("headers"))


_LONG = f"(CASE WHEN content_length = 'none' THEN -1 ELSE CAST(content_length AS BIGINT) END) > {LIMIT}"
_VIDEO_TYPE = "starts_with(lower(content_type), 'video/')"
_VIDEO_EXT = "lower(regexp_extract(url, '[.]([^.]*)$', 1)) IN ('webm','mp4','m4v','mkv','ts','3gp','3g2','flv','mov','wmv','ogv','ogm')"
_FIELD = "regexp_matches(extra_name, '(?i)^(icy-|ice-|x-audiocast-)')"
_SERVER = "regexp_matches(server, '(?i)^icecast')"
_REASON = f"""CASE WHEN {_LONG} THEN 'content length' WHEN {_VIDEO_TYPE} OR {_VIDEO_EXT} THEN 'video' WHEN version = 'ICY' THEN 'icy version'
    WHEN {_FIELD} THEN 'icy field' WHEN {_SERVER} THEN 'icy server' END"""


def _flag(name, expression, sql):
    def make(t):
        return responses(t).select("seq", expression(t).alias("flag"))

    add(name, make, f"SELECT seq, {sql} AS flag FROM {{heads}}")


_flag("pred_too_long", lambda t: H.too_long(H.content_length(F.col("headers")), F.lit(LIMIT)), _LONG)
_flag("pred_video_type", lambda t: H.is_video_type(F.col("headers")), _VIDEO_TYPE)
_flag("pred_video_ext", lambda t: H.is_video_url(F.col("url")), _VIDEO_EXT)
_flag("pred_video_skip", lambda t: H.is_video_type(F.col("headers")) | H.is_video_url(F.col("url")), f"{_VIDEO_TYPE} OR {_VIDEO_EXT}")
_flag("pred_icy_version", lambda t: F.col("version") == H.STREAM_VERSION, "version = 'ICY'")
_flag("pred_icy_field", lambda t: H.has_stream_field(F.col("headers")), _FIELD)
_flag("pred_icy_server", lambda t: H.has_stream_server(F.col("headers")), _SERVER)


@query("src_responses", "SELECT seq, url, version, CASE WHEN content_length = 'none' THEN 3 ELSE 4 END AS headers FROM {heads}")
def src_responses(t):
    return responses(t).select("seq", "url", "version", F.size("headers").alias("headers"))


@query("limit_first_header", "SELECT seq, server, content_type FROM {heads}")
def limit_first_header(t):
    heads = F.col("headers")
    return responses(t).select("seq", H.first_header(heads, "server").alias("server"), H.first_header(heads, "Content-Type").alias("content_type"))


@query("verdict_response", f"SELECT seq, url, {_REASON} AS reason, {_REASON} IS NULL AS taken FROM {{heads}}")
def verdict_response(t):
    return R.verdict_response(responses(t), LIMIT, False).select("seq", "url", "reason", "taken")


@query("sink_skipped", f"SELECT reason, url FROM (SELECT url, {_REASON} AS reason FROM {{heads}}) AS h WHERE reason IN ('video', 'content length')")
def sink_skipped(t):
    path = scratch_path(t.spark, "skipped")
    R.verdict_response(responses(t), LIMIT, False).where(F.col("reason").isin(R.VIDEO, R.TOO_LONG)).select(
        "reason", "url"
    ).write.mode("overwrite").partitionBy("reason").text(path)
    return t.spark.read.text(path).select("reason", F.col("value").alias("url"))


@query("pred_permanent_error", "SELECT seq, coalesce(status_code IN (401, 403, 404, 405, 410), false) AS permanent FROM {fetches}")
def pred_permanent_error(t):
    return t["fetches"].select("seq", F.coalesce(R.is_permanent_error(F.col("status_code")), F.lit(False)).alias("permanent"))


# Result fields and counters.


@query("fx_status_code", "SELECT seq, coalesce(CASE WHEN body_size % 2 = 0 THEN 226 END, status_code, 0) AS code FROM {fetches}")
def fx_status_code(t):
    ftp = F.when(F.col("body_size") % 2 == 0, F.lit(226))
    return t["fetches"].select("seq", V.result_code(F.col("status_code"), ftp).alias("code"))


@query("fx_status_message", "SELECT seq, coalesce(error, CASE WHEN status_code = 404 THEN 'Not Found' END, '') AS message FROM {fetches}")
def fx_status_message(t):
    reason = F.when(F.col("status_code") == 404, F.lit("Not Found"))
    return t["fetches"].select("seq", V.result_message(F.col("error"), reason).alias("message"))


def _class_sql(keys: str, over: str = "") -> str:
    parts = [
        f"count(*) FILTER (WHERE error IS NULL AND status_code BETWEEN {n}00 AND {n}99){over} AS r{n}xx" for n in range(1, 6)
    ]
    unknown = f"count(*) FILTER (WHERE error IS NOT NULL OR status_code IS NULL OR status_code NOT BETWEEN 100 AND 599){over} AS runk"
    return ", ".join([*parts, unknown])


@query("agg_status_class", f"SELECT job, {_class_sql('job')} FROM {{fetches}} GROUP BY job")
def agg_status_class(t):
    return C.class_counts(t["fetches"], ["job"])


@query("agg_bytes", "SELECT job, CAST(sum(coalesce(body_size, 0)) AS BIGINT) AS bytes_downloaded FROM {fetches} GROUP BY job")
def agg_bytes(t):
    return C.bytes_downloaded(t["fetches"], ["job"])


def _events_sql(columns: str) -> str:
    return f"""SELECT job, {columns} FROM (SELECT job, count(*) FILTER (WHERE event = 'queued') AS items_queued,
        count(*) FILTER (WHERE event = 'dequeued') AS items_downloaded FROM {{queue_events}} GROUP BY job) AS g"""


for _name, _column, _expr in [
    ("agg_queued", "items_queued", "items_queued"),
    ("agg_dequeued", "items_downloaded", "items_downloaded"),
    ("agg_backlog", "backlog", "items_queued - items_downloaded AS backlog"),
]:
    add(_name, lambda t, c=_column: C.event_counts(t["queue_events"], ["job"]).select("job", c), _events_sql(_expr))


@query("agg_job_latest", "SELECT job, max(seq) AS seq, arg_max(body_size, seq) AS body_size, arg_max(page_id, seq) AS page_id FROM {fetches} GROUP BY job")
def agg_job_latest(t):
    return C.latest_snapshot(t["fetches"].select("job", "seq", "body_size", "page_id"), ["job"])


_STATE = """CASE WHEN last_ok THEN 'done' WHEN last_bad OR tries >= 3 THEN 'error' ELSE 'todo' END"""


@query(
    "agg_attempts",
    f"""SELECT job, page_id, tries, {_STATE} AS status FROM (SELECT job, page_id, count(*) AS tries,
          arg_max(error IS NULL AND status_code < 400, seq) AS last_ok, arg_max(coalesce(status_code IN (401,403,404,405,410), false), seq) AS last_bad
        FROM {{fetches}} GROUP BY job, page_id) AS g""",
)
def agg_attempts(t):
    ok = F.col("error").isNull() & (F.col("status_code") < 400)
    permanent = F.coalesce(R.is_permanent_error(F.col("status_code")), F.lit(False))
    return C.attempts(t["fetches"], ["job", "page_id"], permanent, ok)


_OVER = " OVER (PARTITION BY job ORDER BY seq)"


@query("win_running_job", f"SELECT job, seq, CAST(sum(coalesce(body_size, 0)){_OVER} AS BIGINT) AS bytes_downloaded, {_class_sql('job', _OVER)} FROM {{fetches}}")
def win_running_job(t):
    return C.running_counters(t["fetches"], ["job"]).select("job", "seq", "bytes_downloaded", *C.CLASSES)


# Settings over time. A good value of each, as DuckDB reads it; null where the text is refused.

_WHOLE = "TRY_CAST(trim({}) AS BIGINT)"
_LOW, _HIGH = (_WHOLE.format(f"CASE WHEN contains(value, '-') THEN split_part(value, '-', {i}) ELSE value END") for i in (1, 2))
_FLAG = "CASE value WHEN 'on' THEN true WHEN 'off' THEN false END"
_GOOD = {
    "max_content_length": _WHOLE.format("value"),
    "suppress_ignore_reports": _FLAG,
    "video": _FLAG,
    "scrape": _FLAG,
    "concurrency": f"CASE WHEN {_WHOLE.format('value')} IS NOT NULL THEN greatest(1, {_WHOLE.format('value')}) END",
    "delay_min": f"CASE WHEN {_HIGH} IS NOT NULL THEN {_LOW} END",
    "delay_max": f"CASE WHEN {_LOW} IS NOT NULL THEN {_HIGH} END",
}
NAMES = list(S.SETTINGS)


def _default(name: str) -> str:
    return str(S.SETTINGS[name].default).lower()


def _good_lines(name: str, controls: str = "{controls}") -> str:
    return f"SELECT job, effective_ts, seq, {_GOOD[name]} AS value FROM {controls} WHERE name = '{S.SETTINGS[name].control}' AND {_GOOD[name]} IS NOT NULL"


def _asof_sql(events: str, names: list[str] = NAMES, columns: str = "e.job, e.seq", controls: str = "{controls}") -> str:
    joins = " ".join(
        f"ASOF LEFT JOIN (SELECT job, effective_ts, arg_max(value, seq) AS value FROM ({_good_lines(n, controls)}) GROUP BY job, effective_ts) AS c{i} "
        f"ON e.job = c{i}.job AND e.ts >= c{i}.effective_ts"
        for i, n in enumerate(names)
    )
    values = ", ".join(f"coalesce(c{i}.value, {_default(n)}) AS {n}" for i, n in enumerate(names))
    return f"SELECT {columns}, {values} FROM {events} AS e {joins}"


@query("join_control_asof", _asof_sql("{fetches}"))
def join_control_asof(t):
    return S.settings_asof(t["fetches"].select("job", "seq", "ts"), t["controls"], NAMES).select("job", "seq", *NAMES)


def _current_sql() -> str:
    last = " ".join(f"LEFT JOIN (SELECT job, arg_max(value, {{{{'t': effective_ts, 's': seq}}}}) AS value FROM ({_good_lines(n)}) GROUP BY job) AS c{i} ON j.job = c{i}.job" for i, n in enumerate(NAMES))
    values = ", ".join(f"coalesce(c{i}.value, {_default(n)}) AS {n}" for i, n in enumerate(NAMES))
    return f"SELECT j.job, {values} FROM (SELECT DISTINCT job FROM {{controls}}) AS j {last}"


@query("src_controls", _current_sql())
def src_controls(t):
    return S.current_settings(t["controls"], NAMES)


@query("fx_parse_delay", f"SELECT job, seq, {_GOOD['delay_min']} AS delay_min, {_GOOD['delay_max']} AS delay_max FROM {{controls}} WHERE name = 'delay'")
def fx_parse_delay(t):
    delays = t["controls"].where(F.col("name") == "delay")
    return delays.select("job", "seq", V.parse_delay(F.col("value")).alias("d")).select("job", "seq", "d.*")


@query("fx_parse_concurrency", "SELECT event_id, greatest(1, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) - 50) AS concurrency FROM {events}")
def fx_parse_concurrency(t):
    text = (F.regexp_extract("props", "([0-9]+)", 1).cast("int") - 50).cast("string")
    return t["events"].select("event_id", V.parse_concurrency(F.concat(text, F.lit("\n"))).alias("concurrency"))


@query(
    "fx_parse_igsets",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'view' THEN 2 ELSE 3 END AS sets,
       CASE WHEN event_type <> 'error' THEN event_type END AS first_set FROM {events}""",
)
def fx_parse_igsets(t):
    kind = F.col("event_type")
    text = F.when(kind == "error", F.lit(", \r\n")).when(kind == "view", F.concat(F.lit(" "), kind, F.lit(",b,\n"))).otherwise(F.concat(kind, F.lit(",b, c")))
    sets = V.parse_igsets(text)
    return t["events"].select("event_id", F.size(sets).alias("sets"), F.try_element_at(sets, F.lit(1)).alias("first_set"))


@query(
    "win_control_changed",
    """SELECT job, name, seq, coalesce(value IS DISTINCT FROM prev OR rn = 1, true) AS changed FROM (SELECT job, name, seq, value,
         lag(value) OVER w AS prev, row_number() OVER w AS rn FROM {controls} WINDOW w AS (PARTITION BY job, name ORDER BY seq)) AS x""",
)
def win_control_changed(t):
    return S.changed_controls(t["controls"], order="seq").select("job", "name", "seq", "changed")


@query(
    "win_scrape_sticky",
    """SELECT f.job, f.seq, coalesce(f.ts >= o.off_at, false) AS scrape_off FROM {fetches} AS f LEFT JOIN
       (SELECT job, min(effective_ts) AS off_at FROM {controls} WHERE name = 'scrape' AND value = 'off' GROUP BY job) AS o ON f.job = o.job""",
)
def win_scrape_sticky(t):
    return S.scrape_gate(t["fetches"], t["controls"]).select("job", "seq", "scrape_off")


@query(
    "win_stop_gate",
    """SELECT job, seq FROM (SELECT f.job, f.seq, sum(CASE WHEN f.ts >= o.stop_at THEN 1 ELSE 0 END) OVER (PARTITION BY f.job ORDER BY f.seq) AS past
       FROM {fetches} AS f LEFT JOIN (SELECT job, min(effective_ts) AS stop_at FROM {controls} WHERE name = 'stop' AND value = 'on' GROUP BY job) AS o
         ON f.job = o.job) AS x WHERE past = 0 OR (past = 1 AND seq IN (SELECT min(f.seq) FROM {fetches} AS f JOIN
         (SELECT job, min(effective_ts) AS stop_at FROM {controls} WHERE name = 'stop' AND value = 'on' GROUP BY job) AS o ON f.job = o.job AND f.ts >= o.stop_at GROUP BY f.job))""",
)
def win_stop_gate(t):
    return S.stop_gate(t["fetches"], t["controls"]).select("job", "seq")


# Telemetry.

_MSG = """SELECT conn_id, seq, json_extract_string(payload, '$.type') AS type, json_extract_string(payload, '$.mode') AS mode,
    json_extract_string(payload, '$.url') AS url, json_extract_string(payload, '$.job_data.ident') AS ident,
    CAST(json_extract_string(payload, '$.response_code') AS INTEGER) AS response_code,
    json_extract_string(payload, '$.response_message') AS response_message FROM {telemetry}"""
_HELLO = f"SELECT conn_id, arg_min(mode, seq) AS conn_mode, min(seq) AS hello_seq FROM ({_MSG}) AS m WHERE type = 'hello' AND mode IN ('dashboard', 'grabber') GROUP BY conn_id"
_AFTER = f"SELECT m.*, h.conn_mode FROM ({_MSG}) AS m JOIN ({_HELLO}) AS h ON m.conn_id = h.conn_id AND m.seq > h.hello_seq"
_RELAYED = f"SELECT * FROM ({_AFTER}) AS a WHERE conn_mode = 'grabber' AND type = 'download'"
_JSON = """concat('{{"type":"download","job_data":{{"ident":"', ident, '","note":null,"extra":{{"z":[1,2,null],"a":"x"}}}},"url":"', url, '","response_code":', CAST(response_code AS VARCHAR),
    ',"wget_code":', coalesce('"' || response_message || '"', 'null'), '}}')"""


@query("src_telemetry", _MSG)
def src_telemetry(t):
    decoded = T.decode_messages(t["telemetry"])
    return decoded.select("conn_id", "seq", "type", "mode", "url", F.col("job_data.ident").alias("ident"), "response_code", "response_message")


@query("pred_message_type", f"SELECT conn_id, seq, type FROM ({_MSG}) AS m WHERE type IN ('download', 'stdout', 'stderr', 'ignore')")
def pred_message_type(t):
    return T.known_types(T.decode_messages(t["telemetry"])).select("conn_id", "seq", "type")


@query("win_hello_mode", f"SELECT conn_id, seq, type, conn_mode FROM ({_AFTER}) AS a")
def win_hello_mode(t):
    return T.after_hello(T.decode_messages(t["telemetry"])).select("conn_id", "seq", "type", "conn_mode")


@query("fx_rename_wgetcode", f"SELECT conn_id, seq, response_message AS wget_code FROM ({_RELAYED}) AS r")
def fx_rename_wgetcode(t):
    sent = T.relay(T.decode_messages(t["telemetry"]))
    return sent.select("conn_id", "seq", F.get_json_object("relayed", "$.wget_code").alias("wget_code"))


@query("sink_message_json", f"SELECT conn_id, seq, {_JSON} AS relayed FROM ({_RELAYED}) AS r")
def sink_message_json(t):
    path = scratch_path(t.spark, "messages")
    T.relay(T.decode_messages(t["telemetry"])).select("conn_id", "seq", "relayed").write.json(path)
    return t.spark.read.schema("conn_id string, seq bigint, relayed string").json(path)


@query(
    "join_broadcast_fanout",
    f"""SELECT r.conn_id, r.seq, h.conn_id AS subscriber FROM ({_RELAYED}) AS r JOIN ({_HELLO}) AS h ON h.conn_mode = 'dashboard'""",
)
def join_broadcast_fanout(t):
    decoded = T.decode_messages(t["telemetry"])
    dashboards = T.first_hellos(decoded).where(F.col("conn_mode") == "dashboard")
    return T.fan_out(T.relay(decoded), dashboards).select("conn_id", "seq", "subscriber")


# Messages of a crawl's own results and refusals.


def _messages_sql() -> str:
    """Every event in one order; settings are read by results and, some of them, by screening."""
    counters = [*C.CLASSES]
    kinds = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in counters)
    nothing = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in counters)
    own = ", ".join([f"CASE WHEN error IS NULL AND status_code BETWEEN {n}00 AND {n}99 THEN 1 ELSE 0 END AS r{n}xx" for n in range(1, 6)])
    own += ", CASE WHEN error IS NOT NULL OR status_code IS NULL OR status_code NOT BETWEEN 100 AND 599 THEN 1 ELSE 0 END AS runk"
    results = f"""SELECT job, seq * 2 AS seq, ts, 'download' AS type, url, CASE WHEN error IS NULL THEN coalesce(status_code, 0) ELSE 0 END AS response_code,
        coalesce(error, '') AS response_message, CAST(NULL AS VARCHAR) AS pattern, body_size AS b, 0 AS q, 0 AS d, {kinds}, 'result' AS reads FROM (SELECT *, {own} FROM {{result_urls}}) AS r"""
    queue = f"""SELECT job, seq * 2, NULL, NULL, NULL, NULL, NULL, NULL, 0, CASE WHEN event = 'queued' THEN 1 ELSE 0 END, CASE WHEN event = 'dequeued' THEN 1 ELSE 0 END, {nothing}, 'none' FROM {{queue_events}}"""
    refused = f"SELECT job, seq, ts, 'ignore', url, NULL, NULL, pattern, 0, 0, 0, {nothing}, stage FROM {{refusals}}"
    merged = f"SELECT *, seq * 3 + CASE WHEN type IS NULL THEN 0 WHEN type = 'download' THEN 1 ELSE 2 END AS place FROM ({results} UNION ALL {queue} UNION ALL {refused}) AS u"
    asof = _asof_sql(f"(SELECT * FROM ({merged}) AS m WHERE type IS NOT NULL)", columns="e.job, e.place, e.type")
    line = " OVER (PARTITION BY job ORDER BY place)"
    sums = ", ".join(f"CAST(sum({c}){line} AS BIGINT) AS {name}" for c, name in [("b", "bytes_downloaded"), ("q", "items_queued"), ("d", "items_downloaded"), *[(c, f"n_{c}") for c in counters]])
    held = ", ".join(f"coalesce(last_value(CASE WHEN {'reads IN (' + chr(39) + 'result' + chr(39) + ', ' + chr(39) + 'response' + chr(39) + ')' if n in M.READ_BY_SCREENING else 'reads = ' + chr(39) + 'result' + chr(39)} THEN {n} END IGNORE NULLS){line}, {_default(n)}) AS s_{n}" for n in NAMES)
    rows = f"SELECT m.*, {', '.join('a.' + n for n in NAMES)} FROM ({merged}) AS m LEFT JOIN ({asof}) AS a ON m.job = a.job AND m.place = a.place AND m.type = a.type"
    fields = ", ".join([*[f"s_{n} AS {n}" for n in NAMES], "bytes_downloaded", "items_queued", "items_downloaded", *[f"n_{c} AS {c}" for c in counters]])
    return f"""SELECT s.job, s.seq, s.type, s.url AS message_url, s.response_code, s.response_message, s.pattern, c.ident, c.url AS start_url, c.started_at, {fields}
        FROM (SELECT *, {sums}, {held} FROM ({rows}) AS x) AS s JOIN {{crawls}} AS c ON s.job = c.job WHERE s.type = 'download' OR (s.type = 'ignore' AND NOT s_suppress_ignore_reports)"""


@query("make_messages", _messages_sql())
def make_messages(t):
    """What a reader of the messages finds in them; results of the fixture stand at even seqs, refusals at odd ones."""
    results, queue = (t[n].withColumn("seq", F.col("seq") * 2) for n in ("result_urls", "queue_events"))
    made = M.make_messages(results, queue, t["refusals"], t["controls"], t["crawls"])
    read = T.decode_messages(made.select("job", "seq", "payload"))
    data = [F.col(f"job_data.{c}").alias({"url": "start_url"}.get(c, c)) for c in M.JOB_FIELDS]
    return read.select("job", "seq", "type", F.col("url").alias("message_url"), "response_code", "response_message", "pattern", *data)
