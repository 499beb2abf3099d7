import random
import re

import pytest
from pyspark.sql import functions as F

from trawlkit.functions.rules import PLACEHOLDER, anchored_hosts, must_contain, must_hold_word
from trawlkit.operators import url_rules as U

RULES = [
    ("global", 1, r"^https?://(www\.)?share\.example/submit\?"),
    ("global", 2, r"/js/js/.+/js/"),
    ("global", 3, r"^https?://{any_start_netloc}/.+[?&]replyto(com)?=\d+"),
    ("global", 4, "# no rule"),
    ("global", 5, ""),
    ("global", 6, r"^https?://stream\d?\.example(:\d+)?/"),
    ("site", 1, r"redirect=https?://{any_start_netloc}/"),
    ("site", 2, r"^https?://(old|www)\.host-a\.example:8080/x/.+\.rss$"),
    ("user", 1, " leading"),
    ("user", 2, r"(?i)upper"),
    ("user", 3, r"\?C=[NMSD];O=[AD]$"),
]
SEEDS = [("a", "https://host-a.example:8080/x/"), ("a", "https://b.example/"), ("b", "http://only-b.example/p?q")]


def rule_table(spark, rows):
    return spark.createDataFrame(rows, "set_name string, line_no int, pattern string")


def seed_table(spark):
    return spark.createDataFrame(SEEDS, "job string, url string")


def random_urls(n):
    rnd = random.Random(7)
    hosts = ["share.example", "www.share.example", "host-a.example:8080", "www.host-a.example:8080", "b.example", "only-b.example", "stream1.example:99", "stream.example", "xb.example"]
    parts = ["js", "x", "submit", "a.rss", "UPPER", " leading", "upper", "b"]
    tails = ["", "?replytocom=12", "?z=1&replyto=7", "?C=N;O=D", "?redirect=https://b.example/", "?redirect=https://b.example.evil/", "?redirect=http://host-a.example:8080/y"]
    made = []
    for _ in range(n):
        path = "/".join(rnd.choice(parts) for _ in range(rnd.randint(0, 5)))
        made.append(f"{rnd.choice(['http', 'https', 'ftp'])}://{rnd.choice(hosts)}/{path}{rnd.choice(tails)}")
    return made


def expected(job, url, verdict, rows):
    if url.startswith("data:"):
        return ("data uri", False, None)
    if (job, url) in SEEDS:
        return ("seed", verdict, None)
    netlocs = sorted({re.match(r"[a-z]+://([^/?#]*)", u).group(1) for j, u in SEEDS if j == job})
    for _, _, pattern in sorted(rows):
        if not pattern or pattern.startswith("#"):
            continue
        filled = [pattern.replace(PLACEHOLDER, re.escape(n)) for n in netlocs] if PLACEHOLDER in pattern else [pattern]
        hits = sorted(f for f in filled if re.search(f, url))
        if hits:
            return ("ignored", False, hits[0])
    return ("passed", verdict, None)


def test_verdicts_equal_one_by_one_search(spark):
    rows = [("a" if i % 3 else "b", i, u, i % 5 > 0) for i, u in enumerate(random_urls(1500))]
    rows += [("a", 9001, SEEDS[0][1], False), ("a", 9002, SEEDS[0][1], True), ("b", 9003, SEEDS[0][1], True)]
    rows += [("a", 9004, "data:text/html,upper", True), ("b", 9005, "data", True), ("a", 9006, "DATA:x", True)]
    table = spark.createDataFrame(rows, "job string, seq int, url string, verdict boolean")
    done = U.verdict_url(table, seed_table(spark), U.load_rules(rule_table(spark, RULES)))
    got = {r.seq: (r.reason, r.accepted, r.pattern) for r in done.collect()}
    assert len(got) == len(rows)
    reasons = set()
    for job, seq, url, verdict in rows:
        want = expected(job, url, verdict, RULES)
        reasons.add(want[0])
        assert got[seq] == want, url
    assert reasons == {"data uri", "seed", "ignored", "passed"}


def test_no_rules_ignore_nothing(spark):
    table = spark.createDataFrame([("a", "http://x.example/", True)], "job string, url string, verdict boolean")
    row = U.verdict_url(table, seed_table(spark), U.RuleSet([])).first()
    assert (row.reason, row.accepted, row.pattern) == ("passed", True, None)


def test_bad_rules_are_set_aside(spark):
    rows = [("s", 1, r"^https?://.*\meetup\.com/"), ("s", 2, "("), ("s", 3, "ok"), ("s", 4, "ok")]
    rules = U.load_rules(rule_table(spark, rows))
    assert [r.pattern for r in rules.rules] == ["ok"]
    assert [r.line_no for r in rules.invalid] == [1, 2]
    flags = {r.line_no: r.valid for r in U.rule_validity(spark, rule_table(spark, rows)).collect()}
    assert flags == {1: False, 2: False, 3: True, 4: True}


def test_empty_seeds_compatibility(spark):
    rows = [("s", 1, r"^https?://{any_start_netloc}/no"), ("s", 2, "x$")]
    table = spark.createDataFrame(
        [("a", "http:///no", True), ("a", "https://b.example/no", True), ("a", SEEDS[0][1] + "x", True)],
        "job string, url string, verdict boolean",
    )
    rules = U.load_rules(rule_table(spark, rows))
    got = {r.url: r.reason for r in U.verdict_url(table, seed_table(spark), rules, compat_empty_seeds=True).collect()}
    assert got == {"http:///no": "ignored", "https://b.example/no": "passed", SEEDS[0][1] + "x": "ignored"}


def test_rules_of_inactive_sets_do_not_count(spark):
    rows = [("one", 1, "aaa"), ("two", 1, "bbb")]
    table = spark.createDataFrame(
        [("a", "http://h/aaa", True, ["two"]), ("a", "http://h/aaabbb", True, ["two"]), ("a", "http://h/aaabbb", True, ["one", "two"])],
        "job string, url string, verdict boolean, sets array<string>",
    )
    done = U.verdict_url(table, seed_table(spark), U.load_rules(rule_table(spark, rows)), active_sets="sets")
    assert sorted((r.url, len(r.sets), r.pattern) for r in done.collect()) == [
        ("http://h/aaa", 1, None),
        ("http://h/aaabbb", 1, "bbb"),
        ("http://h/aaabbb", 2, "aaa"),
    ]


def test_gates_never_refuse_a_match():
    rnd = random.Random(3)
    pieces = ["a", "b", "/", r"\.", "(ab|c)", "(x)?", "[ab]", "a+", "(ab){2}", ".*", "w/", r"\d", "(a|)", "cd"]
    alphabet = "abcdwx./1"
    for _ in range(4000):
        pattern = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6)))
        url = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 14)))
        if re.search(pattern, url):
            text, word = must_contain(pattern), must_hold_word(pattern)
            assert text is None or text in url, (pattern, url)
            assert word is None or word in re.findall("[A-Za-z0-9]+", url), (pattern, url)


@pytest.mark.parametrize(
    "pattern, hosts",
    [
        (r"^https?://(www\.)?digg\.example/submit", ["digg.example", "www.digg.example"]),
        (r"^http://[ab]\.c/", ["a.c", "b.c"]),
        (r"^https?://a\.b(:\d+)?/", None),
        (r"^https?://a\.b", None),
        (r"https?://a\.b/", None),
        (r"^https?://a/|x", None),
        (r"(?i)^https?://a/", None),
        (r"^https?://(a/b|c)/", None),
    ],
)
def test_anchored_hosts(pattern, hosts):
    assert anchored_hosts(pattern) == hosts


def test_result_does_not_depend_on_partitions(spark):
    rows = [("a", i, u, True) for i, u in enumerate(random_urls(300))]
    table = spark.createDataFrame(rows, "job string, seq int, url string, verdict boolean")
    rules = U.load_rules(rule_table(spark, RULES))
    one = U.verdict_url(table.coalesce(1), seed_table(spark), rules).orderBy("seq").collect()
    many = U.verdict_url(table.repartition(13), seed_table(spark), rules).orderBy("seq").collect()
    assert [r.asDict() for r in one] == [r.asDict() for r in many]


def test_seed_join_beyond_the_broadcast_size(spark, monkeypatch):
    monkeypatch.setattr(U, "broadcast_if_small", lambda df, rows=0: df)
    rows = [("a", i, u, True) for i, u in enumerate(random_urls(200))]
    table = spark.createDataFrame(rows, "job string, seq int, url string, verdict boolean")
    done = U.verdict_url(table, seed_table(spark), U.load_rules(rule_table(spark, RULES)))
    got = {r.seq: (r.reason, r.accepted, r.pattern) for r in done.collect()}
    assert all(got[seq] == expected(job, url, verdict, RULES) for job, seq, url, verdict in rows)
    assert done.where(F.col("reason") == "ignored").count() > 0
