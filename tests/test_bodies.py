import hashlib

import pytest
from pyspark.sql import functions as F

from trawlkit.functions import bodies as B
from trawlkit.operators import dupes

URL = "http://h.example/p"
HEX = "0123456789"

# step: (body before, body after the whole chain); the URL plays no part.
CASES = {
    "nb_comments": [(b"a<!-- x\ny -->b", b"ab"), (b"a<!---->b", b"a<!---->b"), (b"<!--" + b"x" * 4001 + b"-->", b"<!--" + b"x" * 4001 + b"-->")],
    "nb_tokens": [(b'"theme_token":"aB-_.z" petok":1.5', b'"theme '), (b'_token": "x"', b'_token": "x"')],
    "nb_hexruns": [(b"x" + b"a" * 10 + b"y", b"xy"), (b"x" + b"a" * 9 + b"y", b"x" + b"a" * 9 + b"y"), (b"x" + b"a" * 256 + b"y", b"xy"), (b"x" + b"b" * 257 + b"y", b"xby")],
    "nb_idnum": [(b'<b id="tab_1-1_340">', b"<b >"), (b'<b \xe9id="t_1">', b"<b \xe9>"), (b'<b myid="t_1">', b'<b myid="t_1">'), (b'<b id="t1">', b'<b id="t1">')],
    "nb_mailto": [(b'<a href="mailto:u@h.ex">&#97;&#98;&#99;</a>!', b"!"), (b'<a href="mailto:u@h.ex">&#97;&#98;</a>', b'<a href="mailto:u@h.ex">&#97;&#98;</a>')],
    "nb_fblike": [(b'<div class="fb-like" data-href="q">z</div></div>', b"</div>"), (b'<div class="fb-like" data-href="q">\n</div>', b' data-href="q">\n</div>')],
    "nb_twshare": [(b'<a href="http://twitter.com/share?x" class="twitter-share-button" q>T</a>!', b"!"), (b'<a href="http://twitter.com/sharx" class="twitter-share-button">', b'<a href="http://twitter.com/sharx" class="twitter-share-button">')],
    "nb_canonical": [(b'<link rel="shortlink" href="/q" />!', b"!"), (b'<meta property="og:url" content="q" />!', b"!"), (b'<link rel="icon" href="/q" />', b'<link rel="icon" href="/q" />')],
    "nb_hreflang": [(b'<link href="/q" rel="alternate" hreflang="fr" />!', b"!"), (b'<link href="/q" rel="next" />', b'<link href="/q" rel="next" />')],
    "nb_hidden": [(b'<input type="hidden" name="q" value="z"/>!', b"!"), (b'<input type="hidden">', b'<input type="hidden">'), (b'<input type="hidden"' + b"v" * 16384 + b">", b""), (b'<input type="hidden"' + b"v" * 16385 + b">", b'<input type="hidden"' + b"v" * 16385 + b">")],
    "nb_flashvars": [(b'<param name="flashvars" value="servannee=2024&amp;servmois=1&amp;servjour=12&amp;servheure=3&amp;servminute=4&amp;servseconde=59" />!', b"!"), (b'<param name="flashvars" value="servannee=24" />', b'<param name="flashvars" value="servannee=24" />')],
    "nb_viewing": [(b"(12 Viewing)!", b"!"), (b"(Viewing)", b"(Viewing)")],
    "nb_active": [(b"Currently Active Users</a>: 5 (2 members and 3 guests)!", b"!"), (b"Currently Active Users: 5", b"Currently Active Users: 5")],
    "nb_cachebust": [(b"x.css?v=12&cb=3;q.js?pos=Az9=!", b"x.css;q.js!"), (b"x.css?w=1", b"x.css?w=1")],
    "nb_numvals": [(b'"k":"-12" "j":3 splinks-4 var hash = z55', b'"k" "j  '), (b'"k": 12', b'"k": 12')],
    "nb_newrelic": [(b"window.NREUM||(NREUM={});NREUM.info={q:1}!", b"!"), (b"window.NREUM||(NREUM={});NREUM.info={}", b"window.NREUM||(NREUM={});NREUM.info={}")],
    "nb_dr_settings": [(b"Drupal jQuery.extend(Drupal.settings, {q});!", b"Drupal !"), (b"jQuery.extend(drupal.settings, {q});", b"jQuery.extend(drupal.settings, {q});")],
    "nb_dr_domid": [(b"Drupal view-dom-id-9f!", b"Drupal !"), (b"Drupal view-dom-id-9fz", b"Drupal view-dom-id-9fz"), (b"view-dom-id-9f", b"view-dom-id-9f")],
    "nb_dr_views": [(b'Drupal <div class="views-field views-field-a-b">q\rz\x85\nnext', b"Drupal \nnext")],
    "nb_dr_crumb": [(b'Drupal <div class="breadcrumb">q    </div>z', b"Drupal z"), (b'Drupal <div class="breadcrumb">\n    </div>', b"Drupal >\n    </div>")],
    "nb_dr_css": [(b"Drupal /css_Ab-_345678.css!", b"Drupal !"), (b"Drupal /css_short.css", b"Drupal /css_short.css")],
    "nb_dr_style": [(b'Drupal <style type="text/css" media="all">@import url(q);</style>!', b"Drupal !")],
    "nb_bodyclass": [(b'<body id="q" class="z" class="y" data-src="w" k>', b" k>"), (b'<div class="z">', b">"), (b"<div klass>", b"<div klass>")],
}

def normalized(spark, rows):
    table = spark.createDataFrame([(i, u, bytearray(b)) for i, (u, b) in enumerate(rows)], "seq int, url string, body binary")
    return [bytes(r.normal_body) for r in B.normalize_body(table).orderBy("seq").collect()]


def test_each_step(spark):
    flat = [(step, before, after) for step, pairs in CASES.items() for before, after in pairs]
    got = normalized(spark, [(URL, before) for _, before, _ in flat])
    for (step, before, after), result in zip(flat, got):
        assert result == after, (step, before)


def test_every_fragment_has_cases():
    assert {*B.FRAGMENTS, *B.DRUPAL_FRAGMENTS, *B.LAST_FRAGMENTS} <= set(CASES)


def test_marks_never_refuse_a_match(spark):
    """The chain with marks equals the chain without."""
    bodies = [before for pairs in CASES.values() for before, _ in pairs]
    table = spark.createDataFrame([(URL, bytearray(b)) for b in bodies], "url string, body binary")
    view = B.byte_view(F.col("body"))
    plain = B.strip_fragments(B.strip_comments(view), B.FRAGMENTS)
    plain = F.when(view.contains("Drupal"), B.strip_fragments(plain, B.DRUPAL_FRAGMENTS)).otherwise(plain)
    plain = B.view_bytes(B.strip_fragments(plain, B.LAST_FRAGMENTS))
    assert B.normalize_body(table).where(F.col("normal_body") != plain).count() == 0


def test_own_path_forms(spark):
    url = "http://h.example/Dir one/page/?q=1&amp"
    path = "Dir one/page"
    forms = [path, path.replace("/", "\\/"), "Dir+one%2Fpage", "Dir+one%2fpage", "Dir onepage", "Dir one_page", '"Dir one\\u002Fpage"', "?q=1&amp", "%3Fq%3D1%26amp"]
    body = "|".join(forms).encode()
    assert normalized(spark, [(url, body)]) == [b"|" * 8]


def test_short_path_and_query_stay(spark):
    assert normalized(spark, [("http://h.example/abcd?q=", b"abcd ?q=")]) == [b"abcd ?q="]


def test_escaped_and_foreign_paths(spark):
    rows = [
        ("http://h.example/a%20b%C3%A9/", "<a%20b%C3%A9> <a+b%C3%A9> <a+b%c3%a9> <a%2520b%25C3%25A9>".encode()),
        ("http://h.example/café/x", "café/x caf%C3%A9%2Fx caf\xe9/x".encode() + b" caf\xe9/x"),
    ]
    assert normalized(spark, rows) == [b"<> <> <> <>", b"  caf\xc3\xa9/x".replace(b"caf\xc3\xa9/x", b"") + b" caf\xe9/x"]


def test_subpath(spark):
    sub = "long/" * 11
    url = f"http://h.example/one/two/{sub}"
    body = f"{sub[:-1]}!".encode()
    assert normalized(spark, [(url, body)]) == [b"!"]


def test_drupal_mark_is_looked_for_before_the_path_goes(spark):
    url = "http://h.example/Drupal/"
    assert normalized(spark, [(url, b"Drupal view-dom-id-1f")]) == [b" "]


def test_first_thousand_comments_go(spark):
    assert normalized(spark, [(URL, b"<!--q-->" * 1001)]) == [b"<!--q-->"]


def test_bytes_survive(spark):
    body = bytes(range(256)) * 2 + b"\xff\xfe\x85\r\n"
    got = normalized(spark, [(URL, body)])[0]
    # Only the digit-and-letter runs of the table itself could be removed; none is ten long.
    assert got == body.replace(HEX.encode(), b"")


@pytest.mark.parametrize("size, known", [(dupes.BODY_LIMIT - 1, True), (dupes.BODY_LIMIT, False)])
def test_body_limit(spark, size, known):
    table = spark.range(1).select(F.lit(1).alias("seq"), F.lit(URL).alias("url"), F.repeat(F.lit("z"), size).cast("binary").alias("body"))
    assert (dupes.page_digests(table).first().digest is not None) is known


def test_digest_of_html_and_of_other_bodies(spark):
    rows = [(1, URL, bytearray(b"<html><!-- 1 -->x")), (2, URL, bytearray(b"<html>x")), (3, URL, bytearray(b"plain <!-- 1 -->x")), (4, URL, bytearray(b""))]
    table = spark.createDataFrame(rows, "seq int, url string, body binary")
    got = {r.seq: r.digest for r in dupes.page_digests(table).collect()}
    md5 = lambda b: hashlib.md5(b).hexdigest()
    assert got == {1: md5(b"<html>x"), 2: md5(b"<html>x"), 3: md5(b"plain <!-- 1 -->x"), 4: md5(b"")}


def test_digest_by_content_type(spark):
    heads = [[("content-type", "Text/HTML; charset=x")], [("Content-Type", "image/png")], []]
    rows = [(i, URL, bytearray(b"q<!--1-->"), h) for i, h in enumerate(heads)]
    table = spark.createDataFrame(rows, "seq int, url string, body binary, headers array<struct<name:string,value:string>>")
    html = dupes.is_html(F.col("body"), F.col("headers"))
    got = [r.digest for r in dupes.page_digests(table, html).orderBy("seq").collect()]
    assert got == [hashlib.md5(b).hexdigest() for b in (b"q", b"q<!--1-->", b"q<!--1-->")]
