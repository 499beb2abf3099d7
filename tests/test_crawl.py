"""Duplicates, comparison, links, frontier, telemetry, sources, archive and streams."""

import gzip
import hashlib
import json
import random
import time
from collections import Counter
from urllib.parse import quote, quote_plus, unquote, urldefrag, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from trawlkit import session
from trawlkit.functions import urls
from trawlkit.operators import archive, compare, dupes, frontier, links
from trawlkit.operators import telemetry as T
from trawlkit.sources import tables, warc
from trawlkit.streaming import flows


def pages_table(spark, bodies):
    rows = [(i, f"http://h/{i}", bytearray(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "seq bigint, url string, body binary")


def test_dupes_equal_loop_however_partitioned(spark):
    rnd = random.Random(1)
    bodies = [b"" if rnd.random() < 0.4 else rnd.choice([b"one", b"two", b"<html><!-- %d -->z" % i]) for i in range(200)]
    first: dict[str, int] = {}
    want = {}
    for i, b in enumerate(bodies):
        key = "html" if b.startswith(b"<html") else hashlib.md5(b).hexdigest()
        want[i] = None if key not in first else f"http://h/{first[key]}"
        first.setdefault(key, i)
    table = pages_table(spark, bodies)
    for shape in (table.coalesce(1), table.repartition(9)):
        assert {r.seq: r.dupe_of for r in dupes.detect_dupes(shape).collect()} == want


def test_dupes_known_before_and_switched_off(spark):
    table = pages_table(spark, [b"a", b"b", b"b"])
    known = spark.createDataFrame([(hashlib.md5(b"a").hexdigest(), "http://old/")], "digest string, first_url string")
    got = {r.seq: r.dupe_of for r in dupes.detect_dupes(table, known=known).collect()}
    assert got == {0: "http://old/", 1: None, 2: "http://h/1"}
    assert dupes.detect_dupes(table, enabled=False).where("dupe_of IS NOT NULL").count() == 0


def test_links_of_dupes_are_dropped(spark):
    marked = spark.createDataFrame([(1, None), (2, "u")], "seq int, dupe_of string")
    found = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "src int, link string")
    assert sorted(r.link for r in dupes.links_of_fresh_pages(found, marked).collect()) == ["a", "c"]


def test_page_compare_and_lines(spark):
    table = pages_table(spark, ["x\ny\ny\r\nz é".encode(), "y\nx\ny\r\n".encode(), b"bad \xff\n"])
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 0)], "left int, right int")
    got = {(r.left, r.right, r.line): r.surplus for r in compare.line_diff(table, pairs).collect()}
    assert got == {(0, 1, "z é"): -1, (1, 2, "y\n"): -1, (1, 2, "x\n"): -1, (1, 2, "y\r\n"): -1, (1, 2, "bad �\n"): 1}
    rows = {(r.left, r.right): r for r in compare.page_compare(table, pairs).collect()}
    assert rows[0, 0].equal and not rows[0, 1].equal
    assert rows[0, 1].url_md5_left == hashlib.md5(b"http://h/0").hexdigest() and rows[0, 1].length_left == 11


BASES = ["http://a.ex/b/c/d?q#f", "https://a.ex", "http://a.ex:80/x/"]
REFS = ["g", "./g", "g/", "/g", "//h.ex/g", "?y", "g?y/../x", "", "#s", "g#s", ".", "./", "..", "../", "../g", "../../g", "../../../../g", "./g/.", "g/./h", "g/../h", "https://z.ex/", "mailto:x", "é/ü"]


def test_resolve_equals_standard(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    got = spark.createDataFrame(rows, "base string, ref string").select("base", "ref", urls.resolve_url(F.col("base"), F.col("ref")).alias("got")).collect()
    for r in got:
        want = urldefrag(urljoin(r.base, r.ref))[0]
        assert r.got == want or (want.endswith("a.ex") and r.got == want) or r.got.replace("a.ex/?", "a.ex?") == want, (r.base, r.ref, r.got, want)


def test_url_expressions_equal_standard(spark):
    texts = ["a b/c", "é?~*'()", "%41%zz%E9+x", "a%2Fb%", "100%", "ab", "%c3%A9"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.quote_plus(F.col("t")).alias("qp"), urls.quote(F.col("t")).alias("q"), urls.unquote(F.col("t")).alias("u")).collect()
    for r in got:
        assert (r.qp, r.q, r.u) == (quote_plus(r.t), quote(r.t), unquote(r.t))
    for url in ["HTTP://U:p@H.ex:80/p;x?q=1?2#f#g", "//h/p", "/p?q", "x:y", "http://h[1]|/", "a\tb\n?c", ""]:
        row = spark.range(1).select(urls.split_url(F.lit(url)).alias("u")).select("u.*").first()
        parts = urlsplit(url) if "[" not in url else None
        if parts:
            assert (row.scheme, row.netloc, row.path, row.query) == (parts.scheme, parts.netloc, parts.path, parts.query), url


def test_url_variants(spark):
    def one(column):
        return spark.range(1).select(column.alias("c")).first().c

    assert one(urls.orig_image_variant(F.lit("https://pbs.twimg.com/media/x.jpg:large"))) == "https://pbs.twimg.com/media/x.jpg:orig"
    assert one(urls.orig_image_variant(F.lit("http://pbs.twimg.com/media/x.jpg"))) is None
    assert one(urls.share_variant(F.lit("https://www.quora.com/a"))) == "https://www.quora.com/a?share=1"
    assert one(urls.share_variant(F.lit("https://www.quora.com/a?b"))) is None
    assert one(urls.strip_session(F.lit("http://h/a;jsessionid=1?sid=2&x=3&PHPSESSID=4#f"))) == "http://h/a?x=3#f"
    assert one(urls.strip_session(F.lit("http://h/a?inside=1"))) == "http://h/a?inside=1"
    assert one(urls.escaped_fragment(F.lit("http://h/a?x#!k=v"))) == "http://h/a?x&_escaped_fragment_=k%3Dv"
    assert one(urls.lower_escapes(F.lit("A%2FB%zZ%%C3"))) == "A%2fB%zZ%%c3"
    assert one(urls.crawl_name(F.lit("http://h.ex/a b/"), F.lit("2024-01-02").cast("date"), F.lit("0123456789"))) == "h.ex-a-b-2024-01-02-01234567"


def test_extract_links(spark):
    html = (
        '<a class=x HREF="/p?a=1&amp;b=2">q</a><A href=\'r\'><img src=i.png srcset="j.png 1x, k.png 2x">'
        '<script src="s.js"></script><link rel=stylesheet href=c.css><a name="n">z</a><p href="no"><a data-href="no2">'
    )
    table = spark.createDataFrame([(1, "http://h/", html)], "seq int, url string, body string")
    got = links.extract_links(table).orderBy("ord").collect()
    assert [(r.link, r.link_type, r.inline) for r in got] == [
        ("/p?a=1&b=2", "html", False), ("r", "html", False), ("i.png", "media", True), ("j.png", "media", True),
        ("k.png", "media", True), ("s.js", "javascript", True), ("c.css", "css", True),
    ]
    assert [r.dst_url for r in links.resolve_links(links.extract_links(table)).orderBy("ord").collect()][:2] == ["http://h/p?a=1&b=2", "http://h/r"]


def extracted(spark, *pages):
    table = spark.createDataFrame([(i, "http://h/d/p", b) for i, b in enumerate(pages)], "seq int, url string, body string")
    return [(r.seq, r.link) for r in links.extract_links(table).orderBy("seq", "ord").collect()]


def test_long_tags_neither_crash_nor_hide_links(spark):
    for n in (10**5, 10**7):
        long = "x" * n
        pages = [f'<a {long} href="/p">', f'<a title="{long}" href="/q">', f'<a {"y=1 " * (n // 4)}href=/r>', f'<a "{long}', f"<img srcset='{long} 1x, b 2x'>"]
        assert extracted(spark, *pages) == [(0, "/p"), (1, "/q"), (2, "/r"), (4, long), (4, "b")]


@pytest.mark.parametrize(
    ("srcset", "found"),
    [("a.png 1x,b.png 2x", ["a.png", "b.png"]), ("a.png, b.png", ["a.png", "b.png"]), ("a,b 1x", ["a,b"]), (" , a 1x , , b", ["a", "b"]), ("a 1x(,),b,, c 10w", ["a", "b", "c"]), ("data:x,y 1x, z", ["data:x,y", "z"]), (",", [])],
)
def test_srcset_candidates(spark, srcset, found):
    assert [link for _, link in extracted(spark, f'<img srcset="{srcset}">')] == found


def test_entities_are_decoded_once(spark):
    html = '<a href="/a?x=1&#38;y&#x3d;2&amp;amp;&lt;&nope;&#0;&#55296;&#128512;">'
    assert extracted(spark, html) == [(0, "/a?x=1&y=2&amp;<&nope;\ufffd\ufffd\U0001f600")]


def test_base_decides_what_links_are_relative_to(spark):
    html = '<base target=x><base href="/other/"><a href="r"><a href="http://z/">'
    table = spark.createDataFrame([(1, "http://h/d/p", html.replace("<base target=x>", "")), (2, "http://h/d/p", '<a href="r">')], "seq int, url string, body string")
    got = links.resolve_links(links.extract_links(table)).orderBy("seq", "ord").collect()
    assert [r.dst_url for r in got] == ["http://h/other/r", "http://z/", "http://h/d/r"]


def test_extra_links(spark):
    table = spark.createDataFrame([("https://www.quora.com/a",), ("https://pbs.twimg.com/media/a",), ("http://x/",)], "url string")
    assert {(r.dst_url, r.inline) for r in links.extra_links(table).collect()} == {("https://www.quora.com/a?share=1", False), ("https://pbs.twimg.com/media/a:orig", True)}
    own = [("http://x/", "?", "/$", "/all", "html", False)]
    assert [r.dst_url for r in links.rule_links(table, own).collect()] == ["http://x/all"]


def reach(seeds, edges, max_level, requisites, offsite, no_parent):
    """First-come breadth-first walk, round by round."""
    hosts = {urlsplit(u).hostname for u in seeds}
    found = {u: (0, 0, 0, u) for u in seeds}
    newest = dict(found)
    while newest:
        best = {}
        for url, (kind, level, depth, root) in newest.items():
            for dst, inline in edges.get(url, []):
                local = urlsplit(dst).hostname in hosts
                if inline:
                    step = (2, level, depth + 1, root) if depth + 1 <= requisites else None
                else:
                    same = urlsplit(dst)[:2] == urlsplit(root)[:2]
                    under = not no_parent or not same or dst.startswith(root[: root.rindex("/") + 1])
                    allowed = kind == 0 and (max_level is None or level + 1 <= max_level) and (under if local else offsite)
                    step = (0 if local else 1, level + 1, 0, root) if allowed else None
                if step and dst not in found and (dst not in best or step < best[dst]):
                    best[dst] = step
        found.update(best)
        newest = best
    return {u: (level, depth, frontier.KINDS[kind]) for u, (kind, level, depth, _) in found.items()}


@pytest.mark.parametrize(
    "seed, max_level, requisites, offsite, no_parent, per_key",
    [(1, None, 5, True, True, 10**6), (2, 2, 1, True, True, 10**6), (3, None, 2, False, False, 7), (4, 0, 3, True, True, 7)],
)
def test_frontier_equals_walk(spark, seed, max_level, requisites, offsite, no_parent, per_key):
    rnd = random.Random(seed)
    nodes = [f"http://h{h}.ex/{d}/{i}" for h in range(3) for d in "ab" for i in range(9)]
    edges = {n: [(rnd.choice(nodes), rnd.random() < 0.3) for _ in range(30 if k == 0 else 2)] for k, n in enumerate(nodes)}
    seeds = [nodes[0], nodes[20]]
    rows = [("j", s, d, inline) for s, outs in edges.items() for d, inline in outs]
    table = spark.createDataFrame(rows, "job string, src string, dst string, inline boolean")
    start = spark.createDataFrame([("j", s) for s in seeds], "job string, url string")
    done = frontier.expand_frontier(start, table, max_level, requisites, offsite, no_parent, links_per_key=per_key)
    got = [(r.url, (r.level, r.depth, r.kind)) for r in done.collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == reach(seeds, edges, max_level, requisites, offsite, no_parent)


def messages_table(spark, rows):
    return spark.createDataFrame([(c, i, p if isinstance(p, str) else json.dumps(p)) for i, (c, p) in enumerate(rows)], "conn_id string, seq bigint, payload string")


MESSAGES = [
    ("g", {"type": "download", "job_data": {}, "url": "early", "response_code": 1, "response_message": ""}),
    ("g", {"type": "hello", "mode": "unknown"}),
    ("g", {"type": "hello", "mode": "grabber", "url": "u"}),
    ("g", {"type": "hello", "mode": "dashboard"}),
    ("g", {"type": "download", "job_data": {"ident": "j", "r2xx": 3}, "url": "u", "response_code": 200, "response_message": "OK"}),
    ("g", {"type": "stdout", "job_data": {"ident": "j"}, "message": "m"}),
    ("g", {"type": "ignore", "job_data": {"ident": "j"}, "url": "u", "pattern": "p"}),
    ("g", {"type": "download", "job_data": {"ident": "j", "new": [1, None, {"b": 1.5, "a": None}], "ok": True}, "url": "u", "response_code": "0", "response_message": None}),
    ("g", {"type": "other", "job_data": {}}),
    ("g", {"type": "ignore", "job_data": {"ident": "j"}, "url": "no pattern"}),
    ("g", "{broken"),
    ("d", {"type": "hello", "mode": "dashboard"}),
    ("d", {"type": "stdout", "job_data": {}, "message": "from a dashboard"}),
]
RELAYED = [
    {"type": "download", "job_data": {"ident": "j", "r2xx": 3}, "url": "u", "response_code": 200, "wget_code": "OK"},
    {"type": "stdout", "job_data": {"ident": "j"}, "message": "m"},
    {"type": "ignore", "job_data": {"ident": "j"}, "url": "u", "pattern": "p"},
    {"type": "download", "job_data": {"ident": "j", "new": [1, None, {"b": 1.5, "a": None}], "ok": True}, "url": "u", "response_code": "0", "wget_code": None},
]


def test_relay(spark):
    decoded = T.decode_messages(messages_table(spark, MESSAGES))
    assert [r.seq for r in decoded.where("malformed").collect()] == [10]
    assert [json.loads(r.relayed) for r in T.relay(decoded).orderBy("seq").collect()] == RELAYED
    copies = T.fan_out(T.relay(decoded), spark.createDataFrame([("d",), ("e",)], "conn_id string"))
    assert Counter(r.subscriber for r in copies.collect()) == {"d": 4, "e": 4}
    many = spark.range(2500).select(F.concat(F.lit("c"), "id").alias("conn_id"))
    assert T.fan_out(T.relay(decoded), many).count() == 10_000


def test_relay_stream_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(0, len(MESSAGES), 4):
        part = messages_table(spark, MESSAGES).where(F.col("seq").between(k, k + 3))
        part.coalesce(1).write.mode("append").parquet(source)
        stream = flows.table_stream(spark, source, "conn_id string, seq bigint, payload string")
        flows.stream_relay(stream, str(tmp_path / "conn"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [json.loads(r.relayed) for r in out.orderBy("seq").collect()] == RELAYED


def test_dupe_stream_restarts_and_equals_batch(spark, tmp_path):
    bodies = [b"a", b"b", b"a", b"c", b"b", b"a", b"d", b"d"]
    table = pages_table(spark, bodies)
    want = {r.seq: r.dupe_of for r in dupes.detect_dupes(table).collect()}
    for k in range(0, 8, 3):
        table.where(F.col("seq").between(k, k + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = flows.table_stream(spark, str(tmp_path / "in"), "seq bigint, url string, body binary")
        flows.stream_dupes(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.seq: r.dupe_of for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want


def test_counter_stream_over_several_batches(spark, tmp_path):
    for k in range(3):
        rows = [("j", 200, None, 5), ("j", None, "x", None), (f"k{k}", 404, None, 1)]
        spark.createDataFrame(rows, "job string, status_code int, error string, body_size bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = flows.table_stream(spark, str(tmp_path / "in"), "job string, status_code int, error string, body_size bigint")
        flows.stream_counters(stream, ["job"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.job: (r.bytes_downloaded, r.r2xx, r.r4xx, r.runk) for r in flows.latest_batches(spark, str(tmp_path / "out"), ["job"]).collect()}
    assert got == {"j": (15, 3, 0, 3), "k0": (1, 0, 1, 0), "k1": (1, 0, 1, 0), "k2": (1, 0, 1, 0)}


def test_verdict_stream_sees_edited_rules(spark, tmp_path):
    schema, rules = "job string, seq bigint, url string, verdict boolean", []
    seeds = spark.createDataFrame([("j", "http://s/")], "job string, url string")
    for k in range(2):
        rules.append(("s", k, f"rule{k}"))
        spark.createDataFrame([("j", k, "http://h/rule1", True)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = flows.table_stream(spark, str(tmp_path / "in"), schema)
        table = lambda: spark.createDataFrame(rules, "set_name string, line_no int, pattern string")
        flows.stream_verdicts(stream, seeds, table, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r.seq: r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: "passed", 1: "ignored"}


def test_pattern_and_list_files(spark, tmp_path):
    (tmp_path / "sets").mkdir()
    (tmp_path / "sets" / "one").write_text("\n# c\n a\n\nb\n\n")
    (tmp_path / "sets" / "two").write_text("z")
    got = tables.read_pattern_files(spark, str(tmp_path / "sets")).orderBy("set_name", "line_no").collect()
    assert [tuple(r) for r in got] == [("one", 1, "# c"), ("one", 2, " a"), ("one", 3, ""), ("one", 4, "b"), ("two", 1, "z")]
    (tmp_path / "list").write_text("http://a/\n\nhttp://b/")
    assert sorted(r.url for r in tables.read_url_list(spark, str(tmp_path / "list")).collect()) == ["http://a/", "http://b/"]
    assert [r.ord for r in tables.seed_table(spark, ["x", "y"]).orderBy("ord").collect()] == [0, 1]


def test_sitemaps(spark):
    xml = '<?xml version="1.0"?><s:urlset xmlns:s="q"><s:url><s:loc> http://h/a?x=1&amp;y </s:loc></s:url><url><loc><![CDATA[http://h/b]]></loc></url>'
    seeds = spark.createDataFrame([("j", "http://h/deep/x?y")], "job string, url string")
    found = spark.createDataFrame([("http://h/sitemap.xml", bytearray(xml.encode())), ("http://h/deep/sitemap.xml", bytearray(b"<loc>no</loc>"))], "url string, body binary")
    assert sorted(r.url for r in tables.sitemap_urls(seeds, found).collect()) == ["http://h/a?x=1&y", "http://h/b"]


def test_archive_files_hold_every_record_in_order(spark, tmp_path):
    rows = [("j", 0, i, f"http://h/{i}", bytearray(bytes([i]) * 40), 40) for i in range(20)]
    records = spark.createDataFrame(rows, "job string, shard int, seq bigint, url string, body binary, size int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    planned = archive.plan_files(records, ["job", "shard"], limit=100)
    files = {r.seq: r.file_no for r in planned.collect()}
    assert files == {i: i * 40 // 100 for i in range(20)}
    warc.write_archive(planned, f"file://{tmp_path}/open", f"file://{tmp_path}/done", "soft/1")
    names = sorted(p.name for p in (tmp_path / "done").iterdir() if p.name.endswith(".gz"))
    assert names == [warc.file_name("j", 0, n) for n in sorted(set(files.values()))]
    seen = []
    for name in names:
        data = gzip.decompress((tmp_path / "done" / name).read_bytes())
        assert data.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo") and b"software: soft/1" in data
        seen += [int(part.split(b"\r\n")[0]) for part in data.split(b"WARC-Target-URI: http://h/")[1:]]
    assert seen == list(range(20))


def test_index_key(spark):
    row = spark.range(1).select(archive.url_key(F.lit("https://www2.Sub.Ex.org:8080/A?b#c"))).first()
    assert row[0] == "org,ex,sub)/a?b"


def test_checkpoint_folder_of_the_session_is_used(spark):
    assert session.checkpoint_dir(spark)
    assert session.small_enough(spark.range(5), 5) and not session.small_enough(spark.range(6), 5)


def test_strip_session_of_very_long_urls(spark):
    table = spark.createDataFrame([("http://h/?" + "sid=1&" * 200_000 + "x=1",), ("http://h/?sid=" + "a" * 1_000_000 + "#f",), ("http://h/?" + "sid=&" * 200_000,)], "url string")
    assert [r[0] for r in table.select(urls.strip_session(F.col("url"))).collect()] == ["http://h/?x=1", "http://h/#f", "http://h/"]


def test_relay_leaves_values_as_they_were(spark):
    data = r'{"z":1.10, "a":[1e3, -0.0, 12345678901234567890123456789012345678901234.5], "q":"say \"1.50\" \\ \u00e9", "n":{"b":null,"b":2.0}, "t":true}'
    payload = '{"type":"download","job_data":' + data + r',"url":"http:\/\/x\/1.10","url":"http:\/\/y?\"2.50\"","response_code":1E2,"response_message":{"x":007e0}}'
    odd = r'{"type":"stdout","job_data":[],"message":"{\"not\":1.0}"}'
    rows = [("c", 0, '{"type":"\\u0068ello","mode":"grabber"}'), ("c", 1, payload.replace("007e0", "7e0")), ("c", 2, odd), ("c", 3, '{"type":"stderr","job_data":null,"message":1.00}'), ("c", 4, '{"type":"stderr","job_data":null'), ("c", 5, None)]
    done = T.relay(T.decode_messages(spark.createDataFrame(rows, "conn_id string, seq bigint, payload string"))).orderBy("seq").collect()
    assert [r.seq for r in done] == [1, 2, 3]
    assert done[0].relayed == (
        '{"type":"download","job_data":{"z":1.10,"a":[1e3,-0.0,12345678901234567890123456789012345678901234.5],"q":"say \\"1.50\\" \\\\ é","n":{"b":null,"b":2.0},"t":true},'
        '"url":"http://y?\\"2.50\\"","response_code":1E2,"wget_code":{"x":7e0}}'
    )
    assert done[1].relayed == r'{"type":"stdout","job_data":[],"message":"{\"not\":1.0}"}'
    assert done[2].relayed == '{"type":"stderr","job_data":null,"message":1.00}'


def test_open_tags_are_read_once(spark):
    closed = '<a href="/x">'
    bodies = [closed + "<a " * 1_000_000, closed + "<a href='" * 500_001, closed + '<a "' * 500_001, "<base " * 300_000 + closed, closed + "<img src='>" + closed, closed + "<a href=/y", closed + "<img alt='a > b' src=/z>"]
    began = time.time()
    found = links.extract_links(pages_table(spark, [b.encode() for b in bodies])).orderBy("seq", "ord").collect()
    assert time.time() - began < 30
    by_page = {k: [r.link for r in found if r.seq == k] for k in range(len(bodies))}
    assert by_page == {0: ["/x"], 1: ["/x"], 2: ["/x"], 3: ["/x"], 4: ["/x"], 5: ["/x"], 6: ["/x", "/z"]}
