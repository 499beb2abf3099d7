"""A crawl round with its queue: refused, duplicate, unanswered and queued URLs, levels, requisites, scope."""

import pytest
from pyspark.sql import functions as F

from trawlkit.operators.url_rules import load_rules
from trawlkit.plans.crawl_round import queue_round

PLACE = "job string, url string, status string, level int, depth int, kind string, root string, note string"
ROOT = "http://a.ex/d/"
LINKS = '<a href="/d/new#x"></a><a href="/d/new"></a><a href="/up"></a><a href="http://b.ex/z"></a><a href="/d/known"></a><a href="/d/bad1"></a><img src="http://c.ex/i.png">'


def queued(url, status="todo", level=0, depth=0, kind="page", root=ROOT, job="j"):
    return (job, url, status, level, depth, kind, root, "own")


@pytest.fixture(scope="module")
def inputs(spark):
    html = F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html").alias("value"))
    head, too_long = F.array(html), F.array(html, F.struct(F.lit("Content-Length").alias("name"), F.lit("999").alias("value")))
    answers = [
        ("j", 0, ROOT, LINKS, False),
        ("j", 1, "http://a.ex/d/copy", LINKS + "<!-- 1700000000 -->", False),
        ("j", 2, "http://a.ex/d/bad0", '<a href="/d/from-bad"></a>', False),
        ("j", 3, "http://a.ex/d/long", '<a href="/d/from-long"></a>', True),
        ("j", 4, "http://a.ex/d/deep", '<a href="/d/deeper"></a><img src="/p.png">', False),
        ("j", 5, "http://b.ex/leaf", '<a href="http://b.ex/on"></a><script src="s.js"></script>', False),
        ("j", 6, "http://a.ex/stray", '<a href="/d/from-stray"></a>', False),
        ("k", 0, "http://a.ex/d/", '<a href="/d/known"></a>', False),
        ("j", 7, "http://a.ex/d/frame", '<img src="/late.png">', False),
        ("j", 8, "http://a.ex/d/null", None, False),
    ]
    responses = spark.createDataFrame(answers, "job string, seq bigint, url string, body string, long boolean")
    responses = responses.withColumn("headers", F.when(F.col("long"), too_long).otherwise(head))
    responses = responses.select("job", "seq", "url", F.lit("HTTP/1.1").alias("version"), "headers", F.col("body").cast("binary").alias("body"))
    queue = spark.createDataFrame(
        [
            queued(ROOT),
            queued("http://a.ex/d/copy", level=1),
            queued("http://a.ex/d/bad0", level=1),
            queued("http://a.ex/d/long", level=1),
            queued("http://a.ex/d/deep", level=2),
            queued("http://a.ex/d/known", level=1),
            queued("http://a.ex/d/failed", status="error", level=1),
            queued("http://b.ex/leaf", level=1, kind="leaf"),
            queued("http://a.ex/d/frame", level=1, depth=5, kind="requisite"),
            queued("http://a.ex/d/null", level=1),
            queued("http://a.ex/d/", job="k"),
        ],
        PLACE,
    )
    seeds = spark.createDataFrame([("j", ROOT), ("k", "http://a.ex/d/")], "job string, url string")
    rules = load_rules(spark.createDataFrame([("global", 1, "bad[0-9]")], "set_name string, line_no int, pattern string"))
    return responses, queue, seeds, rules


def rows(frame):
    return {(r.job, r.url): (r.status, r.level, r.depth, r.kind, r.root) for r in frame.collect()}


def test_next_queue(inputs):
    responses, queue, seeds, rules = inputs
    done = queue_round(responses, queue, seeds, rules, limit=100, max_level=2)
    found = rows(done.queue)
    assert done.queue.count() == len(found)
    status = {u: found["j", f"http://a.ex/d/{u}"][0] for u in ("", "copy", "bad0", "long", "deep", "known", "failed", "null")}
    assert status == {"": "done", "copy": "done", "bad0": "skipped", "long": "skipped", "deep": "done", "known": "todo", "failed": "error", "null": "done"}
    new = {u: v for (j, u), v in found.items() if j == "j" and (j, u) not in rows(queue)}
    assert new == {
        "http://a.ex/d/new": ("todo", 1, 0, "page", ROOT),
        "http://a.ex/d/bad1": ("skipped", 1, 0, "page", ROOT),
        "http://b.ex/z": ("todo", 1, 0, "leaf", ROOT),
        "http://c.ex/i.png": ("todo", 0, 1, "requisite", ROOT),
        "http://a.ex/p.png": ("todo", 2, 1, "requisite", ROOT),
        "http://b.ex/s.js": ("todo", 1, 1, "requisite", ROOT),
    }
    # Queues of two crawls are apart.
    assert found["k", "http://a.ex/d/known"] == ("todo", 1, 0, "page", "http://a.ex/d/")
    assert {r.seq for r in done.marked.where("job = 'j' AND dupe_of IS NOT NULL").collect()} == {1}


def test_limits_are_parameters(inputs):
    responses, queue, seeds, rules = inputs
    found = rows(queue_round(responses, queue, seeds, rules, max_level=3, requisites_level=6, offsite=False, no_parent=False).queue)
    assert ("j", "http://a.ex/d/deeper") in found and ("j", "http://a.ex/up") in found and ("j", "http://a.ex/d/from-long") in found
    assert ("j", "http://b.ex/z") not in found and found["j", "http://a.ex/late.png"] == ("todo", 1, 6, "requisite", ROOT)


def test_empty_tables(inputs):
    responses, queue, seeds, rules = inputs
    assert rows(queue_round(responses.limit(0), queue, seeds, rules).queue) == rows(queue)
    assert queue_round(responses, queue.limit(0), seeds, rules).queue.count() == 0


def test_bodies_are_not_shuffled_for_the_rules(inputs):
    responses, queue, seeds, rules = inputs
    plan = queue_round(responses, queue, seeds, rules).screened.select("job", "seq", "taken")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
