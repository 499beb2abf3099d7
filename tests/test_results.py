"""Screening, counters, running values and settings against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from trawlkit.functions import headers as H
from trawlkit.functions import values as V
from trawlkit.operators import asof as A
from trawlkit.operators import counters as C
from trawlkit.operators import queue as Q
from trawlkit.operators import responses as R
from trawlkit.operators import settings as S
from trawlkit.operators.running import running
from trawlkit.sources import tables

HEAD = "seq int, url string, version string, headers array<struct<name:string,value:string>>"
SCREENED = [
    ("http://h/x", "HTTP/1.1", [("Content-Length", "100")], None),
    ("http://h/x", "HTTP/1.1", [("Content-Length", "101")], "content length"),
    ("http://h/x", "HTTP/1.1", [("content-length", "101"), ("Content-Length", "1")], "content length"),
    ("http://h/x", "HTTP/1.1", [("Content-Length", "many")], None),
    ("http://h/x", "HTTP/1.1", [("Content-Length", "10.5e9")], None),
    ("http://h/x", "HTTP/1.1", [("Content-Length", "99999999999999999999999")], "content length"),
    ("http://h/x", "HTTP/1.1", [], None),
    ("http://h/x.mp4?y", "HTTP/1.1", [], None),
    ("http://h/x?y.MP4", "HTTP/1.1", [], "video"),
    ("http://h/x", "HTTP/1.1", [("Content-Type", "Video/x")], "video"),
    ("http://h/x", "HTTP/1.1", [("Content-Type", "text/html"), ("Content-Type", "video/x")], None),
    ("http://h/x", "ICY", [("ice-x", "1")], "icy version"),
    ("http://h/x", "HTTP/1.1", [("Ice-x", "1"), ("Server", "Icecast")], "icy field"),
    ("http://h/x", "HTTP/1.1", [("Server", "IceCast 2"), ("icy-x", "1")], "icy server"),
    ("http://h/x", "HTTP/1.1", [("x-icy-foo", "1"), ("Server", "not icecast")], None),
    ("http://h/x", "HTTP/1.1", [("X-AudioCast-name", "1")], "icy field"),
]


def screened(spark, *args, **options):
    table = spark.createDataFrame([(i, u, v, h) for i, (u, v, h, _) in enumerate(SCREENED)], HEAD)
    return [r.reason for r in R.verdict_response(table, *args, **options).orderBy("seq").collect()]


def test_screening_in_order(spark):
    assert screened(spark, 100, False) == [want for *_, want in SCREENED]


def test_screening_switched_off(spark):
    assert screened(spark) == [None if want in ("content length", "video") else want for *_, want in SCREENED]


def test_limit_zero_counts(spark):
    assert screened(spark, 0, True)[0] == "content length"


def test_exact_header_names(spark):
    got = screened(spark, 100, False, ignore_case=False)
    assert got[2] is None and got[1] == "content length"


@pytest.mark.parametrize(
    "text, want",
    [("5", (5, 5)), (" 5-70\n", (5, 70)), ("x", (None, None)), ("5-x", (None, None)), ("-5", (None, None)), ("1-2-3", (None, None))],
)
def test_delay(spark, text, want):
    row = spark.range(1).select(V.parse_delay(F.lit(text)).alias("d")).select("d.*").first()
    assert tuple(row) == want


def test_values(spark):
    rows = [("3", 3), ("0", 1), ("-2", 1), ("x", None)]
    got = spark.createDataFrame(rows, "v string, w int").select(V.parse_concurrency(F.col("v")).alias("c"), "w").collect()
    assert all(r.c == r.w for r in got)
    sets = spark.createDataFrame([("",), ("\t,a, b,\n",), ("global,x",)], "v string").select(V.parse_igsets(F.col("v")).alias("s"))
    assert [r.s for r in sets.collect()] == [[], ["a", " b"], ["global", "x"]]
    assert [r.s for r in sets.select(V.with_global_set(F.col("s")).alias("s")).collect()] == [["global"], ["global", "a", " b"], ["global", "x"]]


def test_status_classes(spark):
    rows = [(200, None), (599, None), (99, None), (600, None), (0, None), (None, None), (404, "timeout"), (302, None)]
    table = spark.createDataFrame([("j", s, e) for s, e in rows], "job string, status_code int, error string")
    row = C.class_counts(table, ["job"]).first().asDict()
    assert row == {"job": "j", "r1xx": 0, "r2xx": 1, "r3xx": 1, "r4xx": 0, "r5xx": 1, "runk": 5}


def test_ftp_codes_win(spark):
    table = spark.createDataFrame([("j", 200, 550, None, 1), ("j", 200, None, None, 2)], "job string, status_code int, ftp_code int, error string, body_size int")
    row = C.job_counters(table, ["job"]).first()
    assert (row.r2xx, row.r5xx, row.bytes_downloaded) == (1, 1, 3)


def test_attempts(spark):
    rows = [("a", 1, 500), ("a", 2, 200), ("b", 1, 404), ("c", 1, 500), ("d", 1, 500), ("d", 2, 500), ("d", 3, 500)]
    table = spark.createDataFrame(rows, "url string, seq int, status int")
    done = C.attempts(table, ["url"], R.is_permanent_error(F.col("status")), F.col("status") == 200)
    assert {r.url: (r.tries, r.status) for r in done.collect()} == {"a": (2, "done"), "b": (1, "error"), "c": (1, "todo"), "d": (3, "error")}


@pytest.mark.parametrize("spread", [1, 2**19, 2**33, 2**45])
def test_running_equals_loop(spark, spread):
    """Order values close together and far apart; one group holds most rows."""
    rnd = random.Random(spread)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("ab"), i * spread - 40 * spread, rnd.randint(-5, 9)) for i in range(400)]
    table = spark.createDataFrame(rows, "job string, seq bigint, v int")
    values = {"total": ("sum", F.col("v")), "most": ("max", F.col("v"))}
    for inclusive in (True, False):
        got = {(r.job, r.seq): (r.total, r.most) for r in running(table, ["job"], "seq", values, inclusive).collect()}
        seen: dict[str, list[int]] = {}
        for job, seq, v in rows:
            past = seen.setdefault(job, [])
            counted = past + [v] if inclusive else past
            assert got[job, seq] == ((sum(counted), max(counted)) if counted else (None, None))
            past.append(v)


CONTROLS = [
    ("a", "delay", "1", "2024-01-01 00:00:00"),
    ("a", "delay", "2", "2024-01-01 00:00:10"),
    ("a", "delay", "9", "2024-01-01 00:00:10"),
    ("a", "scrape", "off", "2024-01-01 00:00:20"),
    ("a", "scrape", "on", "2024-01-01 00:00:30"),
    ("a", "stop", "on", "2024-01-01 00:00:40"),
    ("b", "delay", "7", "2024-01-01 00:00:25"),
]


def controls(spark):
    return spark.createDataFrame(CONTROLS, "job string, name string, value string, ts string").select(
        "job", "name", "value", F.col("ts").cast("timestamp").alias("effective_ts")
    )


def events(spark):
    rows = [(job, i * 10 + k, f"2024-01-01 00:00:{i:02d}") for i in range(0, 60, 5) for k, job in enumerate("abc")]
    return spark.createDataFrame(rows, "job string, seq int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def read_plainly(name, text):
    """What a setting makes of a text in plain Python; raises where it refuses."""
    if S.SETTINGS[name].read is V.parse_flag:
        return {"on": True, "off": False}[text.strip()]
    if name == "concurrency":
        return max(1, int(text))
    if name.startswith("delay"):
        parts = [int(x) for x in text.split("-", 1)] if "-" in text else [int(text)] * 2
        return parts[name == "delay_max"]
    return int(text)


def in_force(log, job, name, at):
    """The last good value by time and log order."""
    value = S.SETTINGS[name].default
    for j, control, text, when, _ in sorted(log, key=lambda r: (r[3], r[4])):
        if j == job and control == S.SETTINGS[name].control and when <= at:
            try:
                value = read_plainly(name, text)
            except (ValueError, KeyError, AttributeError, TypeError):
                pass
    return value


LOG = "job string, name string, value string, at long, seq long"
TEXTS = ["9", "10", "soon", "", " 7 \n", "1_000", "-5", "+3", "3-8", "4-", "-", "on", "off", "maybe", "0", None, "99999999999999999999"]


def random_log(rng, lines, spread):
    controls = [*{x.control for x in S.SETTINGS.values()}, "stop", "other"]
    return [(rng.choice(["hot", "hot", "hot", "b"]), rng.choice(controls), rng.choice(TEXTS), rng.randrange(lines) * spread, i) for i in range(lines)]


def log_frame(spark, log):
    return spark.createDataFrame(log, LOG).withColumn("effective_ts", F.timestamp_micros("at")).drop("at")


@pytest.mark.parametrize("spread", [1, 1000, 10**9])
def test_settings_asof_keep_the_last_good_value(spark, monkeypatch, spread):
    monkeypatch.setattr(A, "CHANGES_IN_BUCKET", 4)
    rng = random.Random(spread)
    log = random_log(rng, 200, spread)
    # Texts beyond a long are refused here, plain Python takes them.
    log = [r for r in log if r[2] is None or len(r[2]) < 19]
    rows = [(rng.choice(["hot", "b", "none", None]), i, rng.choice([rng.randrange(-20, 220) * spread, None])) for i in range(150)]
    events = spark.createDataFrame(rows, "job string, seq long, at long").withColumn("ts", F.timestamp_micros("at")).withColumns({"scrape": F.lit("own"), "_from": F.lit(1)})
    done = S.settings_asof(events, log_frame(spark, log), list(S.SETTINGS)).collect()
    assert len(done) == len(rows)
    for r in done:
        for name in S.SETTINGS:
            expected = S.SETTINGS[name].default if r.at is None or r.job is None else in_force(log, r.job, name, r.at)
            assert getattr(r, name) == expected, (r, name)


def test_settings_refuse_numbers_beyond_a_long(spark):
    log = log_frame(spark, [("a", "max_content_length", "5", 0, 0), ("a", "max_content_length", "99999999999999999999", 1, 1)])
    assert S.current_settings(log, ["max_content_length"]).first().max_content_length == 5


def test_settings_of_an_empty_log(spark):
    events = spark.createDataFrame([("a", 1, 5)], "job string, seq long, at long").withColumn("ts", F.timestamp_micros("at"))
    row = S.settings_asof(events, log_frame(spark, []), list(S.SETTINGS)).first()
    assert [getattr(row, n) for n in S.SETTINGS] == [s.default for s in S.SETTINGS.values()]
    assert S.settings_asof(events.limit(0), log_frame(spark, [("a", "delay", "1", 0, 0)]), ["delay_min"]).count() == 0


def test_current_settings(spark):
    log = random_log(random.Random(8), 300, 10)
    log = [r for r in log if r[2] is None or len(r[2]) < 19]
    for r in S.current_settings(log_frame(spark, log), list(S.SETTINGS)).collect():
        assert {n: getattr(r, n) for n in S.SETTINGS} == {n: in_force(log, r.job, n, 10**18) for n in S.SETTINGS}


def test_a_log_without_order_is_ordered_by_text(spark):
    log = log_frame(spark, [("a", "delay", "9", 0, 0), ("a", "delay", "10", 0, 1)])
    assert S.current_settings(log, ["delay_min"]).first().delay_min == 10
    assert S.current_settings(log.drop("seq"), ["delay_min"]).first().delay_min == 9


def test_dense_logs_get_narrow_buckets(spark):
    dense = spark.range(1000).select(F.lit("a").alias("job"), F.col("id").alias("_at"))
    assert A.bucket_bits(dense, ["job"]) == 6
    assert A.bucket_bits(dense.withColumn("_at", F.shiftleft("_at", 30)), ["job"]) == 36
    assert A.bucket_bits(dense.limit(0), ["job"]) == 36


def test_scrape_and_stop(spark):
    gated = {(r.job, r.seq): r.scrape_off for r in S.scrape_gate(events(spark), controls(spark)).collect()}
    assert all(off is (key[0] == "a" and key[1] // 10 >= 20) for key, off in gated.items())
    kept = {(r.job, r.seq) for r in S.stop_gate(events(spark), controls(spark)).collect()}
    assert max(seq for job, seq in kept if job == "a") == 400
    assert max(seq for job, seq in kept if job == "b") == 551


def test_changed_controls(spark):
    rows = [("j", "x", v, i) for i, v in enumerate(["1", "1", "2", "2", "1"])]
    table = spark.createDataFrame(rows, "job string, name string, value string, seq bigint")
    done = S.changed_controls(table, order="seq").orderBy("seq").collect()
    assert [r.changed for r in done] == [True, False, True, False, True]


def test_queue_layouts(spark):
    strings = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "id int, url string")
    new = spark.createDataFrame([(2, "todo"), (1, "done"), (3, "todo")], "url_string_id int, status string")
    old = new.withColumnRenamed("url_string_id", "url_str_id")
    for given in ({"queued_urls": new}, {"urls": old}):
        found = tables.queue_tables({**given, "url_strings": strings})
        assert [r.url for r in Q.dump_queue(*found, "todo", ordered=True).collect()] == ["u2", "u3"]
    with pytest.raises(ValueError):
        Q.with_status(new, "unknown")


def test_first_header(spark):
    table = spark.createDataFrame([([("A", "1"), ("b", "2"), ("B", "3")],)], "h array<struct<name:string,value:string>>")
    row = table.select(H.first_header(F.col("h"), "B"), H.first_header(F.col("h"), "B", False), H.first_header(F.col("h"), "C")).first()
    assert tuple(row) == ("2", "3", None)
