"""Rule sets and their versions as of each URL, against a plain walk over the logs."""

import random
import re
from datetime import datetime, timedelta

from trawlkit.functions.rules import PLACEHOLDER
from trawlkit.operators.rule_versions import sets_asof, verdict_asof
from trawlkit.streaming import flows

START = datetime(2024, 1, 1)
CANDIDATE = "job string, seq bigint, url string, verdict boolean, ts timestamp"
LOG = "job string, name string, value string, effective_ts timestamp, seq bigint"
VERSION = "set_name string, line_no int, pattern string, effective_ts timestamp"
SEEDS = [("a", "http://one.example/"), ("b", "http://two.example/"), ("b", "http://three.example/")]


def at(minute):
    return None if minute is None else START + timedelta(minutes=minute)


VERSIONS = [
    ("global", 1, "zip$", None), ("global", 2, "[?&[]s=", None), ("global", 1, "zip$", at(50)), ("global", 2, "/p/", at(50)),
    ("site", 1, "to=" + PLACEHOLDER, None), ("site", 1, "^https?://" + PLACEHOLDER + "/q", at(30)), ("site", 2, "zip$", at(30)),
    ("site-more", 1, "to=", None), ("own:b", 1, "/b$", None), ("own:b", 1, "# nothing", at(70)), ("late", 1, ".", at(40)), ("bad", 1, "(", None),
]
IGSETS = ["global,site", "site-more,site", "", " ", "late", "site", "global", "unknown,site", None]


def logs(rnd, n=40):
    return [(rnd.choice("ab"), rnd.choice(["igsets", "igsets", "delay"]), rnd.choice(IGSETS), at(rnd.choice([None, *range(0, 100, 7)])), i) for i in range(n)]


def candidates(rnd, n=300):
    urls = ["http://one.example/q", "http://two.example/q", "http://x/?to=one.example", "http://x/?to=three.example", "http://x/a.zip", "http://x/[s=", "http://x/p/b", "http://x/b", "data:1", "http://one.example/"]
    return [(rnd.choice(["a", "b", "b", None]), i, rnd.choice(urls), rnd.random() < 0.9, at(rnd.choice([None, *range(-5, 120)]))) for i in range(n)]


def expected(row, log):
    job, seq, url, verdict, ts = row
    changes = [c for c in log if c[0] == job and c[1] == "igsets" and c[2] is not None and c[3] is not None and ts and c[3] <= ts]
    sets = ["global"]
    if changes:
        text = max(changes, key=lambda c: (c[3], c[4]))[2].strip("\r\n\t ,")
        sets = text.split(",") if text else []
    if job is not None:
        sets.append("own:" + job)
    if url.startswith("data:"):
        return ("data uri", None)
    if (job, url) in SEEDS:
        return ("seed", None)
    for name in sorted(set(sets)):
        times = {v[3] for v in VERSIONS if v[0] == name and (v[3] is None or (ts and v[3] <= ts))}
        if not times:
            continue
        chosen = max(times, key=lambda t: t or datetime.min)
        for _, _, pattern, since in sorted((v for v in VERSIONS if v[0] == name and v[3] == chosen), key=lambda v: v[1]):
            filled = [pattern] if PLACEHOLDER not in pattern else sorted(pattern.replace(PLACEHOLDER, re.escape(s.split("/")[2])) for j, s in SEEDS if j == job)
            for one in filled:
                if one != "(" and not one.startswith("#") and re.search(one, url):
                    return ("ignored", one)
    return ("passed", None)


def tables(spark, rows, log):
    seeds = spark.createDataFrame(SEEDS, "job string, url string")
    return spark.createDataFrame(rows, CANDIDATE), seeds, spark.createDataFrame(VERSIONS, VERSION), spark.createDataFrame(log, LOG)


def test_verdicts_equal_walk(spark):
    rnd = random.Random(5)
    rows, log = candidates(rnd), logs(rnd)
    done = {r.seq: (r.reason, r.pattern) for r in verdict_asof(*tables(spark, rows, log)).collect()}
    assert done == {row[1]: expected(row, log) for row in rows}
    assert {reason for reason, _ in done.values()} == {"data uri", "seed", "ignored", "passed"}


def test_no_logs_no_versions(spark):
    rows = candidates(random.Random(6), 20)
    table, seeds, versions, log = tables(spark, rows, [])
    assert {r.active_sets[0] for r in sets_asof(table, log).collect()} == {"global"}
    assert verdict_asof(table, seeds, versions.limit(0), log).where("reason = 'ignored'").count() == 0
    assert verdict_asof(table.limit(0), seeds, versions, log).count() == 0


def test_sets_change_between_batches_and_replay_is_equal(spark, tmp_path):
    rnd = random.Random(7)
    rows, log = candidates(rnd, 120), logs(rnd)
    rows = [(j, s, u, v, at(s)) for j, s, u, v, _ in rows]
    whole = [c for c in log if c[3] is not None]
    first, second = [r for r in rows if r[1] < 60], [r for r in rows if r[1] >= 60]
    folder, known = str(tmp_path / "in"), []

    def run(out, offsets, batches):
        for batch, seen in batches:
            if batch:
                spark.createDataFrame(batch, CANDIDATE).coalesce(1).write.mode("append").parquet(folder)
            known[:] = seen
            _, seeds, versions, _ = tables(spark, rows[:1], whole)
            stream = spark.readStream.schema(CANDIDATE).parquet(folder)
            flows.stream_verdicts_asof(stream, seeds, lambda: versions, lambda: spark.createDataFrame(known, LOG), str(tmp_path / out), str(tmp_path / offsets)).awaitTermination()
        return sorted(spark.read.parquet(str(tmp_path / out)).select("seq", "reason", "pattern").collect(), key=lambda r: r.seq)

    early = [c for c in whole if c[3] < at(60)]
    live = run("live", "live-offsets", [(first, early), (second, whole)])
    replay = run("replay", "replay-offsets", [([], whole)])
    assert live == replay
    assert [(r.reason, r.pattern) for r in live] == [expected(row, whole) for row in sorted(rows, key=lambda r: r[1])]
