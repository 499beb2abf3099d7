"""Relay of crawl messages (conn_id, seq, payload) to dashboards."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.functions.pinned import with_pinned
from trawlkit.session import broadcast_if_small, lookup_side

# Subscribers that one row of the fan-out holds as an array.
AUDIENCE = 1000

# Connection modes, relayed message types, fields of job data and messages.
MODES = ["dashboard", "grabber"]
RELAYED = ["download", "stdout", "stderr", "ignore"]
JOB_DATA = (
    "struct<ident: string, url: string, started_at: double, max_content_length: bigint, "
    "suppress_ignore_reports: boolean, video: boolean, scrape: boolean, concurrency: int, "
    "bytes_downloaded: bigint, items_queued: bigint, items_downloaded: bigint, delay_min: bigint, "
    "delay_max: bigint, r1xx: bigint, r2xx: bigint, r3xx: bigint, r4xx: bigint, r5xx: bigint, runk: bigint>"
)
MESSAGE = (
    f"type string, mode string, user_agent string, url string, job_data {JOB_DATA}, response_code int, "
    "response_message string, message string, pattern string"
)
RENAMED = {"response_message": "wget_code"}
_REQUIRED = {
    "download": ["job_data", "url", "response_code", "response_message"],
    "stdout": ["job_data", "message"],
    "stderr": ["job_data", "message"],
    "ignore": ["job_data", "url", "pattern"],
}


def decode_messages(messages: DataFrame) -> DataFrame:
    """Add the fields of the JSON payload. `malformed` marks payloads without a usable type,
    `complete` those with every field their type must have, be it null."""
    text = F.col("payload").cast("string")
    parsed = F.from_json(text, MESSAGE, {"mode": "PERMISSIVE"})
    # Unnesting keeps later filters above the parser, which then runs once per message.
    decoded = messages.select(*messages.columns, F.json_object_keys(text).alias("_keys"), F.inline_outer(F.array(parsed)))
    whole = [(F.col("type") == kind) & F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(F.col("_keys"), n)) for kind, names in _REQUIRED.items()]
    complete = F.coalesce(reduce(or_, whole), F.lit(False))
    return decoded.withColumns({"malformed": F.col("type").isNull(), "complete": complete}).drop("_keys")


def first_hellos(decoded: DataFrame) -> DataFrame:
    """(conn_id, conn_mode, hello_seq): the first hello with a known mode decides."""
    # A test of the text keeps all but hellos from being parsed for this; any letter may be escaped.
    likely = F.col("payload").cast("string").rlike(r"hello|\\u") if "payload" in decoded.columns else F.lit(True)
    hello = likely & (F.col("type") == "hello") & F.col("mode").isin(MODES)
    first = F.min(F.struct("seq", "mode")).alias("first")
    return (
        decoded.where(hello)
        .groupBy("conn_id")
        .agg(first)
        .select("conn_id", F.col("first.mode").alias("conn_mode"), F.col("first.seq").alias("hello_seq"))
    )


def after_hello(decoded: DataFrame, hellos: DataFrame | None = None) -> DataFrame:
    """Messages sent after their connection's hello, with its mode."""
    hellos = lookup_side(first_hellos(decoded)) if hellos is None else broadcast_if_small(hellos)
    return decoded.join(hellos, "conn_id").where(F.col("seq") > F.col("hello_seq"))


def known_types(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("type").isin(RELAYED))


# Marks put before the content of strings and numbers, so that a parser leaves them as they are.
_STRING, _NUMBER = "\x01n\x01s", "\x01n"
_CONTENT = r'(?:[^"\\]++|\\.)*+'
_RAW_FIELDS = sorted({name for names in _REQUIRED.values() for name in names})
_RAW = T.StructType([T.StructField(f"{_STRING}{name}", T.StringType()) for name in _RAW_FIELDS])


def _marked(text: Column) -> Column:
    """The JSON text with every string marked, keys too, and every number a marked string."""
    strings = F.regexp_replace(text, f'"({_CONTENT})"', r'"\\u0001s$1"')
    # Strings are stepped over as one piece, so numbers in them stay as they are.
    return F.regexp_replace(strings, rf'"({_CONTENT})"|(-?[0-9][0-9.eE+\-]*+)', r'"\\u0001n$1$2"')


def _as_sent(value: Column) -> Column:
    """JSON text of a field parsed from a marked text."""
    listed = F.to_json(F.array(F.substring(value, F.lit(5), F.length(value))))
    string = F.substring(listed, F.lit(2), F.length(listed) - 2)
    nested = F.regexp_replace(F.regexp_replace(value, r'"\\u0001n\\u0001s', '"'), r'"\\u0001n([^"]*+)"', "$1")
    kinds = F.when(value.startswith(_STRING), string).when(value.startswith(_NUMBER), F.substring(value, F.lit(3), F.length(value)))
    return F.coalesce(kinds.when(value.startswith("{") | value.startswith("["), nested).otherwise(value), F.lit("null"))


def relay_json() -> Column:
    """The message as dashboards get it, of fields as JSON text; the response text goes by another name."""

    def message(kind: str) -> Column:
        parts = [F.lit(f'{{"type":"{kind}"')]
        for name in _REQUIRED[kind]:
            parts += [F.lit(f',"{RENAMED.get(name, name)}":'), F.col(f"_sent_{name}")]
        return F.concat(*parts, F.lit("}"))

    return F.coalesce(*[F.when(F.col("type") == kind, message(kind)) for kind in RELAYED])


def relay(decoded: DataFrame, hellos: DataFrame | None = None) -> DataFrame:
    """(conn_id, seq, type, relayed) of complete messages sent by grabbers after their hello.

    Values pass through unchanged: numbers with all their digits, job data with all its fields in
    their order, nulls, values of other types. Of a key given twice at the top the last one counts.
    """
    sent = known_types(after_hello(decoded, hellos)).where((F.col("conn_mode") == "grabber") & F.col("complete"))
    # Parsed once per message, whatever its kind.
    read = with_pinned(sent.select("conn_id", "seq", "type", "payload"), _raw=F.from_json(_marked(F.col("payload").cast("string")), _RAW))
    read = with_pinned(read, **{f"_sent_{name}": _as_sent(F.col("_raw").getField(f"{_STRING}{name}")) for name in _RAW_FIELDS})
    return read.select("conn_id", "seq", "type", relay_json().alias("relayed"))


def fan_out(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """A row per message and connected dashboard: the product is what is asked for.

    Subscribers are kept in arrays of about AUDIENCE, messages meet each array by its number.
    For audiences too large to copy to, publish the messages once and let readers share them.
    """
    distinct = subscribers.select("conn_id").distinct()
    arrays = max(1, -(-distinct.count() // AUDIENCE))
    spot = F.pmod(F.xxhash64("conn_id"), F.lit(arrays)).cast("int").alias("_array")
    audience = distinct.groupBy(spot).agg(F.collect_list("conn_id").alias("_audience"))
    sent = messages.withColumn("_array", F.explode(F.sequence(F.lit(0), F.lit(arrays - 1))))
    return sent.join(audience, "_array").withColumn("subscriber", F.explode("_audience")).drop("_array", "_audience")
