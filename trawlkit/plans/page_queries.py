"""Queries over page bodies: normalisation, duplicates, comparison, links, frontier, archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawlkit.functions import bodies as B
from trawlkit.functions import urls
from trawlkit.operators import archive as A
from trawlkit.operators import compare, dupes, frontier, links, page_diff
from trawlkit.operators import settings as S
from trawlkit.plans.registry import add, query
from trawlkit.session import lookup_side, scratch_path

_N = "CAST(page_id AS STRING)"

# Per step: what is put into each page, and the step as a RE2 pattern.
_SNIPPETS = {
    "nb_comments": (f"concat('<!-- gen ', {_N}, ' -->')", r"(?s)<!--.+?-->"),
    "nb_tokens": (f"""concat('"theme_token":"', {_N}, '-Z_." petok:"-', {_N}, '" applicationTime":', {_N})""", r'(petok|_token|applicationTime)"?:("[-_A-Za-z0-9.]+"|[0-9.]+)'),
    "nb_hexruns": ("concat('ab', CAST(1700000000 + page_id AS STRING), ' 12345678')", r"[A-Fa-f0-9.]{10,256}"),
    "nb_idnum": (f"""concat('<b id="tab_0_', {_N}, '" myid="x_1" name="a-', {_N}, '">')""", r'\b(id|name|class)="[^"]{0,100}[-_][0-9]+"'),
    "nb_mailto": (f"""concat('<a href="mailto:u', {_N}, '@h.example">&#97;&#98;&#x63;</a>')""", r'<a href="mailto:[^"@]{1,100}@[^"]{2,100}">(&#[0-9a-fA-Fx]{2,4};){3,100}</a>'),
    "nb_fblike": (f"""concat('<div class="fb-like" data-href="', {_N}, '">x</div>y</div>')""", r'<div class="fb-like" data-href=".*?</div>'),
    "nb_twshare": (f"""concat('<a href="https://twitter.com/share?u=', {_N}, '" class="twitter-share-button a">T</a></a>')""", r'<a href="https?://twitter.com/share[^"]*" class="twitter-share-button.*?</a>'),
    "nb_canonical": (f"""concat('<link rel="canonical" href="/', {_N}, '" /><meta property="og:url" content="', {_N}, '" />')""", r'<(link rel="(canonical|shortlink|alternate)".+?href=|meta property="og:url" content=)"[^"]+" />'),
    "nb_hreflang": (f"""concat('<link href="/', {_N}, '" rel="alternate" hreflang="fr" />')""", r'<link href="[^"]+" rel="alternate" hreflang="[^"]+" />'),
    "nb_hidden": (f"""concat('<input type="hidden" name="t" value="', {_N}, '"/>')""", r'<input type="hidden"[^>]+?>'),
    "nb_flashvars": ("'<param name=\"flashvars\" value=\"servannee=2024&amp;servmois=1&amp;servjour=12&amp;servheure=3&amp;servminute=4&amp;servseconde=59\" />'", r'<param name="flashvars" value="servannee=[0-9]{4}&amp;servmois=[0-9]{1,2}&amp;servjour=[0-9]{1,2}&amp;servheure=[0-9]{1,2}&amp;servminute=[0-9]{1,2}&amp;servseconde=[0-9]{1,2}" />'),
    "nb_viewing": (f"concat('(', {_N}, ' Viewing) ( Viewing)')", r"\([0-9]+ Viewing\)"),
    "nb_active": (f"concat('Currently Active Users</a>: ', {_N}, ' (1 members and ', {_N}, ' guests)')", r"Currently Active Users</a>: [0-9]+ \([0-9]+ members and [0-9]+ guests\)"),
    "nb_cachebust": (f"concat('a.css?v=', {_N}, '&cb=', {_N}, '&pos=a', {_N}, '=;&w=1')", r"[&?]((v|cb)=[0-9]+|pos=[A-Za-z0-9=]+)"),
    "nb_numvals": (f"""concat('splinks-', {_N}, ' "k":"-', {_N}, '" "j":', {_N})""", r'(splinks-|var hash = .|":"?)-?[0-9]+'),
    "nb_newrelic": (f"concat('window.NREUM||(NREUM={{{{}}}});NREUM.info={{{{a:', {_N}, '}}}};')", r"window\.NREUM\|\|\(NREUM=\{\}\);NREUM\.info=\{.+?\}"),
    "nb_dr_settings": (f"concat('Drupal jQuery.extend(Drupal.settings, {{{{p:', {_N}, '}}}});')", r"jQuery\.extend\(Drupal.settings, ?\{.+?\}\);"),
    "nb_dr_domid": (f"concat('Drupal view-dom-id-', {_N}, 'ab view-dom-id-1x')", r"\bview-dom-id-[0-9a-f]+\b"),
    "nb_dr_views": (f"""concat('Drupal <div class="views-field views-field-a-b">', {_N})""", r'<div class="views-field views-field-[-a-z]+">.*'),
    "nb_dr_crumb": (f"""concat('Drupal <div class="breadcrumb">', {_N}, '    </div>    </div>')""", r'<div class="breadcrumb">.+?    </div>'),
    "nb_dr_css": (f"concat('Drupal /css_abcdefgh_', {_N}, '.css /css_a.css')", r"/css_[-_A-Za-z0-9]{10,100}\.css"),
    "nb_dr_style": (f"""concat('Drupal <style type="text/css" media="all">@import url(', {_N}, ');</style>')""", r'<style type="text/css" media="all">@import url\(.+?\);</style>'),
    "nb_bodyclass": (f"""concat('<body id="b" class="p', {_N}, '" class="q" data-src="z">')""", r'<(body|div)( id="[^"]+")? class="[^"]+"( class="[^"]+")?( data-src="[^"]{1,1000}")?'),
}


def _braced(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}").replace("'", "''")


def _step(name: str):
    if name == "nb_comments":
        return B.strip_comments
    groups = {**B.FRAGMENTS, **B.DRUPAL_FRAGMENTS, **B.LAST_FRAGMENTS}
    only = {name: groups[name]}
    if name in B.DRUPAL_FRAGMENTS:
        return lambda view: F.when(view.contains(B.DRUPAL_MARK), B.strip_fragments(view, only)).otherwise(view)
    return lambda view: B.strip_fragments(view, only)


def _digest_of(view):
    return F.md5(B.view_bytes(view))


def _register_step(name: str, snippet: str, pattern: str) -> None:
    bodies = f"SELECT page_id, concat(html, {snippet}) AS body FROM {{pages}}"

    def make(t):
        viewed = t.sql(bodies).withColumn("view", B.byte_view(F.col("body").cast("binary")))
        return viewed.select("page_id", _digest_of(_step(name)(F.col("view"))).alias("digest"))

    add(name, make, f"SELECT page_id, md5(regexp_replace(body, '{_braced(pattern)}', '', 'g')) AS digest FROM ({bodies}) AS b")


for _name, (_snippet, _pattern) in _SNIPPETS.items():
    _register_step(_name, _snippet, _pattern)


# The page's own address in its body. DuckDB forms of the needles, for paths of plain letters.
_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1), '/+$', '')"
_BACK = "chr(92)"
_NEEDLES = {
    "nb_path_raw": "path",
    "nb_path_bs": f"replace(path, '/', concat({_BACK}, '/'))",
    "nb_path_qp": "replace(replace(path, '/', '%2F'), ' ', '+')",
    "nb_path_qp_lower": "replace(replace(path, '/', '%2f'), ' ', '+')",
    "nb_path_noslash": "CASE WHEN length(replace(path, '/', '')) >= 5 THEN replace(path, '/', '') ELSE '' END",
    "nb_path_under": "replace(path, '/', '_')",
    "nb_path_json": f"concat(chr(34), replace(path, '/', concat({_BACK}, 'u002F')), chr(34))",
}
_ALL_FORMS = f"""concat(' ', path, '; ', replace(path, '/', concat({_BACK}, '/')), '; ', replace(path, '/', '%2F'), '; ', replace(path, '/', '%2f'), '; ',
    replace(path, '/', ''), '; ', replace(path, '/', '_'), '; ', chr(34), replace(path, '/', concat({_BACK}, 'u002F')), chr(34))"""
_PATH_BODIES = f"SELECT page_id, url, path, concat(html, {_ALL_FORMS}) AS body FROM (SELECT page_id, url, html, {_PATH} AS path FROM {{pages}}) AS p"


def _stripped(forms: list[str], text: str = "body", guard: str = "length(path) >= 5") -> str:
    for form in forms:
        text = f"replace({text}, CASE WHEN {guard} THEN {form} ELSE 'no such text' END, '')"
    return text


def _nonempty(form: str) -> str:
    return f"(CASE WHEN {form} = '' THEN 'no such text' ELSE {form} END)"


def _register_needles(name: str, forms: list[str]) -> None:
    def make(t):
        pages = t.sql(_PATH_BODIES).withColumns(
            {"view": B.byte_view(F.col("body").cast("binary")), "own": B.long_enough(B.body_path(F.col("url")), B.MIN_PATH)}
        )
        needles = B.path_needles(F.col("own"))
        chosen = {k: needles[k] for k in needles if k in forms}
        return pages.select("page_id", _digest_of(B.strip_needles(F.col("view"), chosen)).alias("digest"))

    sql = _stripped([_nonempty(_NEEDLES[f]) for f in forms])
    add(name, make, f"SELECT page_id, md5({sql}) AS digest FROM ({_PATH_BODIES}) AS b")


for _name in _NEEDLES:
    _register_needles(_name, [_name])
_register_needles("nb_path", list(_NEEDLES))

_CODED = "SELECT page_id, concat('http://h.example/', 'a%20', path, '/') AS url, concat(html, ' a+', replace(path, '/', '%2F'), '; a+', replace(path, '/', '%2f'), '; a%2520') AS body, path FROM (SELECT page_id, html, {0} AS path FROM {pages}) AS p".replace("{0}", _PATH)


@query("nb_path_unq", f"""SELECT page_id, md5(replace(replace(body, concat('a+', replace(path, '/', '%2F')), ''), concat('a+', replace(path, '/', '%2f')), '')) AS digest FROM ({_CODED}) AS b""")
def nb_path_unq(t):
    pages = t.sql(_CODED).withColumns({"view": B.byte_view(F.col("body").cast("binary")), "own": B.long_enough(B.body_path(F.col("url")), B.MIN_PATH)})
    needles = B.path_needles(F.col("own"))
    chosen = {k: v for k, v in needles.items() if k.startswith("nb_path_unq")}
    return pages.select("page_id", _digest_of(B.strip_needles(F.col("view"), chosen)).alias("digest"))


_DEEP = "SELECT page_id, concat('http://h.example/x/y/', repeat('long-', 10), path) AS url, concat(html, ' ', repeat('long-', 10), path, '; ', repeat('long-', 10), replace(path, '/', '_')) AS body, concat(repeat('long-', 10), path) AS sub FROM (SELECT page_id, html, {0} AS path FROM {pages}) AS p".replace("{0}", _PATH)


@query("nb_subpath", f"SELECT page_id, md5(replace(replace(body, sub, ''), replace(sub, '/', '_'), '')) AS digest FROM ({_DEEP}) AS b")
def nb_subpath(t):
    pages = t.sql(_DEEP).withColumns({"view": B.byte_view(F.col("body").cast("binary")), "own": B.long_enough(B.body_subpath(B.body_path(F.col("url"))), B.MIN_SUBPATH)})
    return pages.select("page_id", _digest_of(B.strip_needles(F.col("view"), B.path_needles(F.col("own")))).alias("digest"))


_QUERY = "regexp_extract(url, '[?]([^#]*)', 1)"
_QUOTED = "replace(replace(replace(q, '=', '%3D'), '&', '%26'), '?', '%3F')"
_QUERY_BODIES = f"SELECT page_id, url, q, concat(html, '?', q, ' %3F', {_QUOTED}) AS body FROM (SELECT page_id, url, html, {_QUERY} AS q FROM {{pages}}) AS p"


@query("nb_query", f"SELECT page_id, md5(CASE WHEN length(q) >= 3 THEN replace(replace(body, concat('?', q), ''), concat('%3F', {_QUOTED}), '') ELSE body END) AS digest FROM ({_QUERY_BODIES}) AS b")
def nb_query(t):
    viewed = t.sql(_QUERY_BODIES).withColumn("view", B.byte_view(F.col("body").cast("binary")))
    return viewed.select("page_id", _digest_of(B.strip_needles(F.col("view"), B.query_needles(F.col("url")))).alias("digest"))


@query("limit_comment_strip", "SELECT page_id, md5(html) AS digest FROM {pages}")
def limit_comment_strip(t):
    """Bodies of 1,000 short comments and the page's own: the comments past the thousandth stay."""
    body = F.concat(F.repeat(F.lit("<!--x-->"), 1000), F.col("html"))
    viewed = t["pages"].select("page_id", B.byte_view(body.cast("binary")).alias("view"))
    return viewed.select("page_id", _digest_of(B.strip_comments(F.col("view"))).alias("digest"))


# Whole normalisation and duplicates. DuckDB repeats the steps that can touch these pages.


def _normal_sql(source: str) -> str:
    text = _stripped([_nonempty(f) for f in _NEEDLES.values()])
    text = f"CASE WHEN length(q) >= 3 THEN replace(replace({text}, concat('?', q), ''), concat('%3F', {_QUOTED}), '') ELSE {text} END"
    for name in ["nb_comments", *B.FRAGMENTS, *B.LAST_FRAGMENTS]:
        text = f"regexp_replace({text}, '{_braced(_SNIPPETS[name][1])}', '', 'g')"
    return f"SELECT seq, url, {text} AS normal FROM (SELECT seq, url, body, {_PATH} AS path, {_QUERY} AS q FROM {source}) AS s"


_NEAR = _normal_sql("{bodies_near}")


@query("normalize_body", f"SELECT seq, url, md5(normal) AS digest, CAST(strlen(normal) AS BIGINT) AS bytes FROM ({_NEAR}) AS n")
def normalize_body(t):
    done = B.normalize_body(t["bodies_near"])
    return done.select("seq", "url", F.md5("normal_body").alias("digest"), F.octet_length("normal_body").cast("bigint").alias("bytes"))


@query("pred_dupe_eligible", "SELECT seq, strlen(body) < 31457280 AS eligible FROM {bodies}")
def pred_dupe_eligible(t):
    return t["bodies"].select("seq", dupes.is_eligible(F.col("body")).alias("eligible"))


@query("dupe_digest", f"SELECT seq, md5(normal) AS digest FROM ({_NEAR}) AS n UNION ALL SELECT seq + 5000000, md5(body) FROM {{bodies}}")
def dupe_digest(t):
    plain = t["bodies"].withColumn("seq", F.col("seq") + 5000000)
    return dupes.page_digests(t["bodies_near"].unionByName(plain)).select("seq", "digest")


_FIRST = "SELECT digest, arg_min(url, seq) AS first_url, min(seq) AS first_seq FROM ({}) AS d GROUP BY digest"
_PLAIN_DIGESTS = "SELECT seq, url, md5(body) AS digest FROM {bodies}"
_NEAR_DIGESTS = f"SELECT seq, url, md5(normal) AS digest FROM ({_NEAR}) AS n"


def _marked_sql(digests: str) -> str:
    return f"""SELECT d.seq, d.url, d.digest, CASE WHEN d.seq > f.first_seq THEN f.first_url END AS dupe_of
      FROM ({digests}) AS d JOIN ({_FIRST.format(digests)}) AS f ON d.digest = f.digest"""


def _plain_digests(t):
    return t["bodies"].select("seq", "url", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("agg_first_seen", _FIRST.format(_PLAIN_DIGESTS))
def agg_first_seen(t):
    return dupes.first_seen(_plain_digests(t)).drop("times")


@query("join_digest_lookup", f"SELECT d.seq, f.first_url FROM ({_PLAIN_DIGESTS}) AS d JOIN ({_FIRST.format(_PLAIN_DIGESTS)}) AS f ON d.digest = f.digest")
def join_digest_lookup(t):
    digests = _plain_digests(t)
    return digests.join(lookup_side(dupes.first_seen(digests)), "digest").select("seq", "first_url")


@query("win_dupe_of", _marked_sql(_PLAIN_DIGESTS))
def win_dupe_of(t):
    return dupes.mark_dupes(_plain_digests(t)).select("seq", "url", "digest", "dupe_of")


@query("dupe_detect", _marked_sql(_NEAR_DIGESTS))
def dupe_detect(t):
    return dupes.detect_dupes(t["bodies_near"])


@query("dupe_switch", "SELECT seq, url, CAST(NULL AS VARCHAR) AS digest, CAST(NULL AS VARCHAR) AS dupe_of FROM {bodies_near}")
def dupe_switch(t):
    return dupes.detect_dupes(t["bodies_near"], enabled=False)


@query("join_body_cache", "SELECT md5(url) AS url_md5, url, 'found' AS state FROM {bodies} WHERE length(body) > 300 UNION ALL SELECT md5(url), url, 'missing' FROM {bodies} WHERE length(body) <= 300")
def join_body_cache(t):
    bodies = t["bodies"]
    store = bodies.where(F.length("body") > 300).select(F.md5("url").alias("url_md5"), "body")
    found, missing = dupes.stored_bodies(bodies, store)
    return found.select("url_md5", "url", F.lit("found").alias("state")).unionByName(missing.select("url_md5", "url", F.lit("missing").alias("state")))


# Comparison of neighbours.


def _pairs(t):
    return t["pairs"].select(F.col("left_seq").alias("left"), F.col("right_seq").alias("right"))


@query(
    "page_compare",
    f"""SELECT p.page_id AS left, p.page_id + 1 AS right, md5(a.url) AS url_md5_left, md5(b.url) AS url_md5_right, CAST(strlen(a.normal) AS BIGINT) AS length_left,
        CAST(strlen(b.normal) AS BIGINT) AS length_right, a.normal = b.normal AS equal
        FROM {{pages}} AS p JOIN ({_NEAR}) AS a ON a.seq = p.page_id JOIN ({_NEAR}) AS b ON b.seq = p.page_id + 1""".replace("AS left,", 'AS "left",').replace("AS right,", 'AS "right",'),
)
def page_compare(t):
    pairs = t["pages"].select(F.col("page_id").alias("left"), (F.col("page_id") + 1).alias("right"))
    return compare.page_compare(t["bodies_near"], pairs)


_LINES = "SELECT seq, line, count(*) AS n FROM (SELECT seq, unnest(regexp_extract_all(body, '([^\\n]*\\n|[^\\n]+)', 1)) AS line FROM {bodies}) AS l GROUP BY ALL"


@query(
    "page_line_diff",
    f"""SELECT "left", "right", line, CAST(sum(s) AS BIGINT) AS surplus FROM (
          SELECT left_seq AS "left", right_seq AS "right", line, -n AS s FROM {{pairs}} JOIN ({_LINES}) AS a ON a.seq = left_seq
          UNION ALL SELECT left_seq, right_seq, line, n FROM {{pairs}} JOIN ({_LINES}) AS b ON b.seq = right_seq) AS u GROUP BY ALL HAVING sum(s) <> 0""",
)
def page_line_diff(t):
    return compare.line_diff(t["bodies"], _pairs(t))


# Every document, its lines numbered, against an edition of it: of ten lines the fourth is gone and the eighth changed.
_NUMBERED = """SELECT doc_id, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n FROM {documents} WHERE text IS NOT NULL"""


@query(
    "page_diff",
    f"""WITH l AS (SELECT doc_id, n, unnest(lines) AS line, unnest(range(n)) AS i FROM ({_NUMBERED}) AS d),
          s AS (SELECT doc_id, n, i, concat(i, ' ', line) AS line, i - (i + 6) // 10 AS j FROM l),
          c AS (SELECT doc_id, i, i % 10 = 7 AS changed, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS hunk FROM s WHERE i % 10 IN (3, 7)),
          r AS (SELECT c.doc_id, hunk, CASE WHEN s.i < c.i THEN 0 WHEN s.i = c.i THEN 1 WHEN changed THEN 3 ELSE 2 END AS pos,
                  CASE WHEN s.i = c.i THEN '-' ELSE ' ' END AS tag, s.i + 1 AS left_no, CASE WHEN s.i <> c.i THEN s.j + 1 END AS right_no, line
                FROM c JOIN s ON s.doc_id = c.doc_id AND s.i BETWEEN c.i - 1 AND c.i + 1
                UNION ALL SELECT c.doc_id, hunk, 2, '+', NULL, s.j + 1, concat(line, '!') FROM c JOIN s ON s.doc_id = c.doc_id AND s.i = c.i WHERE changed)
        SELECT doc_id * 2 AS "left", doc_id * 2 + 1 AS "right", CAST(hunk AS INTEGER) AS hunk, CAST(pos AS INTEGER) AS pos, tag,
          CAST(left_no AS INTEGER) AS left_no, CAST(right_no AS INTEGER) AS right_no, concat(line, chr(10)) AS line FROM r""",
)
def ordered_page_diff(t):
    numbered = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(i.cast("string"), F.lit(" "), line, F.lit("\n")))
    kept = F.filter(F.col("lines"), lambda line, i: i % 10 != 3)
    # Places after the filter are no longer those of the lines, so lines are changed by the number they begin with.
    changed = F.transform(kept, lambda line: F.when(line.rlike(r"^[0-9]*7 "), F.concat(F.rtrim(line, F.lit("\n")), F.lit("!\n"))).otherwise(line))
    docs = t["documents"].where(F.col("text").isNotNull()).select("doc_id", numbered.alias("lines"))
    left = docs.select((F.col("doc_id") * 2).alias("seq"), F.array_join("lines", "").alias("body"))
    right = docs.select((F.col("doc_id") * 2 + 1).alias("seq"), F.array_join(changed, "").alias("body"))
    pairs = docs.select((F.col("doc_id") * 2).alias("left"), (F.col("doc_id") * 2 + 1).alias("right"))
    return page_diff.page_diff(left.unionByName(right), pairs, context=1)


# Links.


def _pages(t):
    return t["pages"].select(F.col("page_id").alias("seq"), "url", F.col("html").alias("body"))


_HREFS = "SELECT page_id AS seq, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM {pages}"


@query("links_extract", f"SELECT seq, link, 'html' AS link_type, false AS inline, count(*) AS n FROM ({_HREFS}) AS h GROUP BY ALL")
def links_extract(t):
    return links.extract_links(_pages(t)).groupBy("seq", "link", "link_type", "inline").agg(F.count("*").alias("n"))


_RESOLVED = f"SELECT seq, concat(regexp_extract(url, '^([a-z]+://[^/]*)', 1), link) AS dst_url FROM ({_HREFS}) AS h"


@query("links_resolve", _RESOLVED)
def links_resolve(t):
    return links.resolve_links(links.extract_links(_pages(t))).select("seq", "dst_url")


@query("set_union_links", f"{_RESOLVED} UNION ALL SELECT page_id, concat('https://pbs.twimg.com/media/', CAST(page_id AS VARCHAR), ':orig') FROM {{pages}}")
def set_union_links(t):
    own = links.resolve_links(links.extract_links(_pages(t))).select("seq", "dst_url")
    media = t["pages"].select(F.col("page_id").alias("seq"), F.concat(F.lit(urls.TWIMG_PREFIX), F.col("page_id"), F.lit(":small")).alias("url"))
    extra = links.extra_links(media).join(media, "url").select("seq", "dst_url")
    return own.unionByName(extra)


@query(
    "join_outlinks_of_dupes",
    f"""SELECT h.seq, h.link FROM (SELECT seq, unnest(regexp_extract_all(body, 'href="([^"]*)"', 1)) AS link FROM {{bodies_near}}) AS h
        JOIN ({_marked_sql(_NEAR_DIGESTS)}) AS m ON h.seq = m.seq WHERE m.dupe_of IS NULL""",
)
def join_outlinks_of_dupes(t):
    pages = t["bodies_near"]
    found = links.extract_links(pages)
    return dupes.links_of_fresh_pages(found, dupes.detect_dupes(pages), "seq").select("seq", "link")


@query(
    "links_scrape_gate",
    """SELECT f.seq, f.page_id, len(regexp_extract_all(p.html, 'href="([^"]*)"', 1)) AS links FROM {fetches} AS f JOIN {pages} AS p ON f.page_id = p.page_id
       LEFT JOIN (SELECT job, min(effective_ts) AS off_at FROM {controls} WHERE name = 'scrape' AND value = 'off' GROUP BY job) AS o ON f.job = o.job
       WHERE (o.off_at IS NULL OR f.ts < o.off_at) AND len(regexp_extract_all(p.html, 'href="([^"]*)"', 1)) > 0""",
)
def links_scrape_gate(t):
    open_ = S.scrape_gate(t["fetches"], t["controls"]).where(~F.col("scrape_off")).select("seq", "page_id")
    per_page = links.extract_links(_pages(t)).groupBy(F.col("seq").alias("page_id")).agg(F.count("*").alias("links"))
    return open_.join(per_page, "page_id").select("seq", "page_id", "links")


# Frontier. The link table is a tree, so a recursive statement reaches each URL once.


def _reach_sql(seeds: str, scope: str, page_step: str = "true", inline_step: str = "r.depth + 1 <= 5") -> str:
    return f"""WITH RECURSIVE start AS (SELECT DISTINCT job, url FROM {seeds}),
      hosts AS (SELECT DISTINCT job, regexp_extract(url, '^http://([^/]*)', 1) AS host FROM start),
      edges AS (SELECT l.job, l.src, l.dst, l.inline, h.host IS NOT NULL AS local FROM {{crawl_links}} AS l LEFT JOIN hosts AS h
        ON l.job = h.job AND regexp_extract(l.dst, '^http://([^/]*)', 1) = h.host WHERE NOT EXISTS (SELECT 1 FROM start AS s WHERE s.url = l.dst)),
      r(url, level, depth, kind, root) AS (SELECT url, 0, 0, 'page', url FROM start UNION ALL
        SELECT e.dst, CASE WHEN e.inline THEN r.level ELSE r.level + 1 END, CASE WHEN e.inline THEN r.depth + 1 ELSE 0 END,
          CASE WHEN e.inline THEN 'requisite' WHEN e.local THEN 'page' ELSE 'leaf' END, r.root
        FROM r JOIN edges AS e ON e.src = r.url
        WHERE CASE WHEN e.inline THEN {inline_step} ELSE r.kind = 'page' AND ({page_step}) AND ({scope}) END)
      SELECT url, level, depth, kind FROM r"""


_REACH = ["url", "level", "depth", "kind"]
_UNDER = "regexp_extract(e.dst, '^(http://[^/]*)', 1) <> regexp_extract(r.root, '^(http://[^/]*)', 1) OR starts_with(e.dst, regexp_extract(r.root, '^(.*/)', 1))"


@query("frontier_expand", _reach_sql("{source_seeds}", "true"))
def frontier_expand(t):
    return frontier.expand_frontier(t["source_seeds"], t["crawl_links"], no_parent=False).select(*_REACH)


@query("frontier_level", _reach_sql("{source_seeds}", "true", page_step="r.level + 1 <= 2"))
def frontier_level(t):
    return frontier.expand_frontier(t["source_seeds"], t["crawl_links"], max_level=2, no_parent=False).select(*_REACH)


@query("frontier_requisites", _reach_sql("{source_seeds}", "true", page_step="false", inline_step="r.depth + 1 <= 2"))
def frontier_requisites(t):
    return frontier.expand_frontier(t["source_seeds"], t["crawl_links"], max_level=0, requisites_level=2, no_parent=False).select(*_REACH)


@query("frontier_offsite", _reach_sql("{root_seed}", "e.local"))
def frontier_offsite(t):
    return frontier.expand_frontier(t["root_seed"], t["crawl_links"], offsite=False, no_parent=False).select(*_REACH)


@query("frontier_noparent", _reach_sql("{source_seeds}", f"NOT e.local OR {_UNDER}"))
def frontier_noparent(t):
    return frontier.expand_frontier(t["source_seeds"], t["crawl_links"]).select(*_REACH)


_SCOPED = """SELECT s.url AS root, l.dst, l.inline OR (split_part(l.dst, '/', 3) = split_part(s.url, '/', 3) AND starts_with(l.dst, regexp_extract(s.url, '^(.*/)', 1))) AS allowed
    FROM {source_seeds} AS s JOIN {crawl_links} AS l ON split_part(s.url, '/', 3) = split_part(l.src, '/', 3)"""


@query("pred_scope", _SCOPED)
def pred_scope(t):
    seeds = t["source_seeds"].select(F.col("url").alias("root"), urls.url_netloc(F.col("url")).alias("host"))
    found = t["crawl_links"].withColumn("host", urls.url_netloc(F.col("src"))).join(seeds, "host")
    local = urls.url_netloc(F.col("dst")) == F.col("host")
    return found.select("root", "dst", frontier.in_scope(F.col("dst"), F.col("root"), local, F.col("inline"), True, False).alias("allowed"))


@query("frontier_filter", "SELECT DISTINCT dst AS url FROM {crawl_links} WHERE NOT contains(dst, '/es/') AND NOT regexp_matches(dst, '^https?://src1[0-9]?[.]')")
def frontier_filter(t):
    from trawlkit.operators import url_rules as U

    rules = U.RuleSet([U.Rule("user", 1, "/es/"), U.Rule("user", 2, "^https?://src1[0-9]?[.]")])
    candidates = t["crawl_links"].select("job", F.col("dst").alias("url")).distinct().withColumn("verdict", F.lit(True))
    kept = U.verdict_url(candidates, t["root_seed"], rules).where("accepted")
    return kept.select("url")


@query("join_frontier_new", "SELECT DISTINCT dst AS url FROM {crawl_links} AS l WHERE NOT EXISTS (SELECT 1 FROM {crawl_links} AS s WHERE s.src = l.dst)")
def join_frontier_new(t):
    found = t["crawl_links"]
    candidates, queued = found.select("job", F.col("dst").alias("url")), found.select("job", F.col("src").alias("url")).distinct()
    return frontier.new_urls(candidates, queued).select("url")


# Archive.

_SIZED = "SELECT job, seq, page_id, ts, body_size AS size FROM {fetches}"
_FILES = f"SELECT job, seq, CAST(floor((sum(size) OVER (PARTITION BY job ORDER BY seq) - size) / 1000000.0) AS BIGINT) AS file_no FROM ({_SIZED}) AS s"


def _planned(t):
    return A.plan_files(t.sql(_SIZED), ["job"], limit=1_000_000)


@query("sink_warc_plan", _FILES)
def sink_warc_plan(t):
    return _planned(t).select("job", "seq", "file_no")


@query("win_file_roll", f"SELECT job, file_no, count(*) AS records FROM ({_FILES}) AS f GROUP BY ALL")
def win_file_roll(t):
    return _planned(t).groupBy("job", "file_no").agg(F.count("*").alias("records"))


@query(
    "sink_cdx",
    r"""SELECT concat(array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www[0-9]*[.]', ''), '.')), ','), ')',
          regexp_extract(url, '^[a-z]+://[^/]*([^#]*)', 1)) AS url_key, url, md5(html) AS digest, strlen(html) AS length FROM {pages} ORDER BY url_key, url""",
)
def sink_cdx(t):
    records = t["pages"].select(
        "url",
        F.lit("20240101000000").alias("ts"),
        F.lit("text/html").alias("mime"),
        F.lit(200).alias("status"),
        F.md5("html").alias("digest"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.concat(F.lit("crawl-"), F.col("page_id") % 4).alias("file"),
    )
    path = scratch_path(t.spark, "index")
    A.archive_index(records).write.parquet(path)
    return t.spark.read.parquet(path).select("url_key", "url", "digest", "length")


@query(
    "sink_archive_write",
    """SELECT concat(job, '-00000-', lpad(CAST(file_no AS VARCHAR), 5, '0'), '.warc.gz') AS file FROM (SELECT DISTINCT job,
         CAST(floor((sum(size) OVER (PARTITION BY job ORDER BY page_id) - size) / 200000.0) AS BIGINT) AS file_no
       FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS job, strlen(html) AS size FROM {pages}) AS p) AS f""",
)
def sink_archive_write(t):
    from trawlkit.sources import warc

    path = scratch_path(t.spark, "warc")
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    records = t["pages"].select(
        F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("job"),
        F.lit(0).alias("shard"),
        F.col("page_id").alias("seq"),
        "url",
        F.lit(None).cast("timestamp").alias("ts"),
        F.col("html").cast("binary").alias("body"),
        F.octet_length("html").alias("size"),
    )
    warc.write_archive(A.plan_files(records, ["job", "shard"], limit=200_000), uri, software="trawlkit/1")
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"))


# Every page twice: the second copy of a body in a job is written as a reference to the first. Records are
# read back through the index, by file, offset and length.
_ARCHIVED = """SELECT page_id + c.copy * 1000000 AS seq, url, html, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS job, page_id % 3 AS kind_of
  FROM {pages}, (SELECT 0 AS copy UNION ALL SELECT 1) AS c"""


@query(
    "archive_records",
    f"""SELECT concat(job, '-00000-', lpad(CAST(file_no AS VARCHAR), 5, '0'), '.warc.gz') AS file, url, mime,
          CASE WHEN nth > 1 THEN 'revisit' WHEN kind_of = 0 THEN 'resource' ELSE 'response' END AS kind,
          CASE WHEN kind_of > 0 THEN concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), chr(13), chr(10)) END AS head,
          CASE WHEN nth = 1 THEN md5(html) END AS body_md5
        FROM (SELECT *, CASE WHEN kind_of = 0 THEN 'text/plain' END AS mime, row_number() OVER (PARTITION BY job, html ORDER BY seq) AS nth,
                CAST(floor((sum(strlen(html)) OVER (PARTITION BY job ORDER BY seq) - strlen(html)) / 200000.0) AS BIGINT) AS file_no FROM ({_ARCHIVED}) AS p) AS a""",
)
def archive_records(t):
    from trawlkit.sources import warc

    path = scratch_path(t.spark, "warc")
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    header = F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html").alias("value")))
    head = warc.http_head(F.lit("HTTP/1.1"), F.lit(200), F.lit("OK"), header)
    records = t.sql(_ARCHIVED).select(
        "job",
        F.lit(0).alias("shard"),
        "seq",
        "url",
        F.lit(None).cast("timestamp").alias("ts"),
        F.col("html").cast("binary").alias("body"),
        F.octet_length("html").alias("size"),
        F.when(F.col("kind_of") > 0, head).alias("head"),
        F.when(F.col("kind_of") == 0, "text/plain").alias("mime"),
    )
    planned = A.plan_files(A.mark_repeats(records), ["job", "shard"], limit=200_000)
    index = warc.write_archive(planned, uri, software="trawlkit/1")
    back = warc.read_records(index, uri).join(index.select("file", "offset", "mime"), ["file", "offset"])
    return back.select("file", "url", "mime", "kind", "head", F.md5("body").alias("body_md5"))
