"""Messages of a crawl against a plain walk over its events."""

import json
import random

from pyspark.sql import functions as F
from test_results import in_force, log_frame, random_log

from trawlkit.operators import messages as M
from trawlkit.operators import settings as S
from trawlkit.operators import telemetry as T
from trawlkit.operators.counters import CLASSES

RESULTS = "job string, seq long, at long, url string, status_code int, ftp_code int, error string, reason string, body_size long"
REFUSALS = "job string, seq long, at long, url string, pattern string, stage string"


def plain_messages(results, queue, refusals, log, jobs):
    out = []
    for job in {r[0] for r in [*results, *queue, *refusals]} - {None}:
        data = dict(zip(M.IDENTITY, jobs.get(job, (None,) * 3), strict=True))
        data |= {n: s.default for n, s in S.SETTINGS.items()} | dict.fromkeys(["bytes_downloaded", "items_queued", "items_downloaded", *CLASSES], 0)
        events = [(r[1], 0, r) for r in queue if r[0] == job] + [(r[1], 1, r) for r in results if r[0] == job] + [(r[1], 2, r) for r in refusals if r[0] == job]
        for seq, turn, r in sorted((e for e in events if e[0] is not None), key=lambda e: e[:2]):
            if turn == 0:
                if r[2] in ("queued", "dequeued"):
                    data["items_queued" if r[2] == "queued" else "items_downloaded"] += 1
                continue
            reads = list(S.SETTINGS) if turn == 1 else M.READ_BY_SCREENING if r[5] == "response" else []
            for n in reads:
                data[n] = in_force(log, job, n, r[2])
            if turn == 1:
                _, _, _, url, status, ftp, error, reason, size = r
                code = 0 if error is not None else ftp if ftp is not None else status or 0
                data["bytes_downloaded"] += size or 0
                found = ftp if ftp is not None else status or 0
                data[f"r{found // 100}xx" if error is None and 100 <= found <= 599 else "runk"] += 1
                out.append((job, seq, {"type": "download", "job_data": dict(data), "url": url, "response_code": code, "response_message": error or reason or ""}))
            elif not data["suppress_ignore_reports"]:
                out.append((job, seq, {"type": "ignore", "job_data": dict(data), "url": r[3], "pattern": r[4]}))
    return out


def made(spark, results, queue, refusals, log, jobs):
    timed = [spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("at")) for rows, schema in ((results, RESULTS), (refusals, REFUSALS))]
    named = spark.createDataFrame([(j, *v) for j, v in jobs.items()], "job string, ident string, url string, started_at double")
    return M.make_messages(timed[0], spark.createDataFrame(queue, "job string, seq long, event string"), timed[1], log_frame(spark, log), named)


def crawl(seed, n=120):
    rng = random.Random(seed)
    seqs = rng.sample(range(10 * n), 2 * n)
    # Far apart, so that crawls stand in several spans.
    place = lambda k: seqs[k] << 17
    job = lambda: rng.choice(["hot", "hot", "b", None])
    results = [(job(), place(k), place(k) >> 10, f"http://x/{k}", rng.choice([200, 404, 99, None, 600]), rng.choice([None, None, 226]), rng.choice([None, None, "reset"]), rng.choice([None, "OK"]), rng.choice([None, 5, 0])) for k in range(n)]
    refusals = [(job(), place(n + k), place(n + k) >> 10, f"http://y/{k}", rng.choice(["^a", None]), rng.choice(["url", "response", None])) for k in range(n)]
    queue = [(job(), place(rng.randrange(2 * n)), rng.choice(["queued", "dequeued", "other", None])) for _ in range(n)]
    log = [(j, c, v, at << 8, i) for j, c, v, at, i in random_log(rng, 4 * n, 100) if v is None or len(v) < 19]
    # Reports are switched on and off all along.
    log += [("hot", "igoff", rng.choice(["on", "off", "?"]), (10 * n << 7) * k // 40, 10**6 + k) for k in range(40)]
    return results, queue, refusals, log, {"hot": ("i1", "http://s/", 1.5)}


def test_messages_equal_a_plain_walk(spark):
    given = crawl(3)
    found = {(r.job, r.seq, r.type): (json.loads(r.payload), r) for r in made(spark, *given).collect()}
    expected = {(j, s, m["type"]): m for j, s, m in plain_messages(*given)}
    assert {k: v[0] for k, v in found.items()} == expected
    assert len({k[2] for k in expected}) == 2
    some, row = next(v for v in found.values() if v[0]["type"] == "download")
    assert list(some["job_data"]) == M.JOB_FIELDS and row.job_data.asDict() == some["job_data"]


def test_messages_can_be_relayed(spark):
    sent = made(spark, *crawl(4)).where("job IS NOT NULL").select(F.col("job").alias("conn_id"), "seq", "payload")
    hellos = spark.createDataFrame([(j, -1, json.dumps({"type": "hello", "mode": "grabber"})) for j in ("hot", "b")], sent.schema)
    relayed = T.relay(T.decode_messages(hellos.union(sent))).collect()
    assert len(relayed) == sent.count() > 0
    assert all(json.loads(r.relayed)["job_data"]["runk"] >= 0 for r in relayed)


def test_messages_of_nothing(spark):
    assert made(spark, [], [], [], [], {"a": ("i", "u", 0.0)}).count() == 0
    only_queue = made(spark, [], [("a", 1, "queued")], [], [], {"a": ("i", "u", 0.0)})
    assert only_queue.count() == 0
