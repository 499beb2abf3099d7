"""Body normalisation: drop what differs between copies of the same page.

Bodies are bytes. Regexes run on an ISO-8859-1 view, one character per byte, so bounds count
bytes, and word boundaries are written out for ASCII. A step with rare texts in its pattern is
tried only on bodies that hold one of them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import urls
from trawlkit.functions.pinned import with_pinned

# Smallest lengths at which a piece of the URL is removed from the body.
MIN_PATH = 5
MIN_BARE_PATH = 5
MIN_DECODED_PATH = 4
MIN_SUBPATH = 50
MIN_QUERY = 3
SUBPATH_SKIPS = 2
MAX_COMMENTS = 1000

# The removed fragments, in the order of removal.
COMMENT = r"(?s)<!--.{1,4000}?-->"
FRAGMENTS = {
    "nb_tokens": r'(?:petok|_token|applicationTime)"?:(?:"[-_A-Za-z0-9.]+"|[0-9.]+)',
    "nb_hexruns": r"[A-Fa-f0-9.]{10,256}",
    "nb_idnum": r'(?=[inc](?:d|ame|lass)=")(?<![0-9A-Za-z_])(?:id|name|class)="[^"]{0,100}[-_][0-9]+"',
    "nb_mailto": r'<a href="mailto:[^"@]{1,100}@[^"]{2,100}">(?:&#[0-9a-fA-Fx]{2,4};){3,100}</a>',
    "nb_fblike": r'(?d)<div class="fb-like" data-href=".*?</div>',
    "nb_twshare": r'(?d)<a href="https?://twitter.com/share[^"]{0,4096}" class="twitter-share-button.*?</a>',
    "nb_canonical": r'(?d)<(?:link rel="(?:canonical|shortlink|alternate)".{1,1000}?href=|meta property="og:url" content=)"[^"]+" />',
    "nb_hreflang": r'<link href="[^"]+" rel="alternate" hreflang="[^"]+" />',
    "nb_hidden": r'<input type="hidden"[^>]{1,16384}?>',
    "nb_flashvars": (
        r'<param name="flashvars" value="servannee=[0-9]{4}&amp;servmois=[0-9]{1,2}&amp;servjour=[0-9]{1,2}'
        r'&amp;servheure=[0-9]{1,2}&amp;servminute=[0-9]{1,2}&amp;servseconde=[0-9]{1,2}" />'
    ),
    "nb_viewing": r"\([0-9]+ Viewing\)",
    "nb_active": r"Currently Active Users</a>: [0-9]+ \([0-9]+ members and [0-9]+ guests\)",
    "nb_cachebust": r"[&?](?:(?:v|cb)=[0-9]+|pos=[A-Za-z0-9=]+)",
    "nb_numvals": r'(?d)(?=[sv"])(?:splinks-|var hash = .|":"?)-?[0-9]+',
    "nb_newrelic": r"(?d)window\.NREUM\|\|\(NREUM=\{\}\);NREUM\.info=\{.{1,3000}?\}",
}
DRUPAL_MARK = "Drupal"
DRUPAL_FRAGMENTS = {
    "nb_dr_settings": r"(?d)jQuery\.extend\(Drupal.settings, ?\{.{1,40000}?\}\);",
    "nb_dr_domid": r"(?<![0-9A-Za-z_])view-dom-id-[0-9a-f]+(?![0-9A-Za-z_])",
    "nb_dr_views": r'(?d)<div class="views-field views-field-[-a-z]+">.*',
    "nb_dr_crumb": r'(?d)<div class="breadcrumb">.{1,4000}?    </div>',
    "nb_dr_css": r"/css_[-_A-Za-z0-9]{10,100}\.css",
    "nb_dr_style": r'(?d)<style type="text/css" media="all">@import url\(.{1,4096}?\);</style>',
}
LAST_FRAGMENTS = {
    "nb_bodyclass": r'<(?:body|div)(?: id="[^"]+")? class="[^"]+"(?: class="[^"]+")?(?: data-src="[^"]{1,2000}")?',
}

# Texts of which a body must hold one for the step to match.
MARKS = {
    "nb_tokens": ["petok", "_token", "applicationTime"],
    "nb_mailto": ['<a href="mailto:'],
    "nb_canonical": ['<link rel="', '<meta property="og:url"'],
    "nb_fblike": ['<div class="fb-like"'],
    "nb_twshare": ["://twitter.com/share"],
    "nb_hreflang": ['rel="alternate" hreflang='],
    "nb_hidden": ['<input type="hidden"'],
    "nb_flashvars": ['value="servannee='],
    "nb_viewing": [" Viewing)"],
    "nb_active": ["Currently Active Users"],
    "nb_cachebust": ["?v=", "&v=", "?cb=", "&cb=", "?pos=", "&pos="],
    "nb_numvals": ["splinks-", "var hash = ", '":'],
    "nb_newrelic": ["window.NREUM||"],
    "nb_dr_settings": ["jQuery.extend("],
    "nb_dr_domid": ["view-dom-id-"],
    "nb_dr_views": ['class="views-field'],
    "nb_dr_crumb": ['class="breadcrumb"'],
    "nb_dr_css": ["/css_"],
    "nb_dr_style": ["@import url("],
}


def byte_view(data: Column) -> Column:
    """Bytes as text of one character per byte."""
    return F.decode(data, "ISO-8859-1")


def view_bytes(view: Column) -> Column:
    return F.encode(view, "ISO-8859-1")


def _needle(text: Column) -> Column:
    return byte_view(F.encode(text, "UTF-8"))


def body_path(url: Column) -> Column:
    return F.regexp_replace(F.rtrim(urls.url_path(url), F.lit("/")), "^/", "")


def body_subpath(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.array_join(F.slice(parts, F.lit(SUBPATH_SKIPS + 1), F.greatest(F.size(parts) - SUBPATH_SKIPS, F.lit(0))), "/")


def path_needles(path: Column) -> dict[str, Column]:
    """The ways a page writes its own path. An empty needle removes nothing."""
    none = F.lit("")
    bare = F.replace(path, F.lit("/"), none)
    form = urls.quote_plus(path)
    decoded = urls.unquote(path)
    decoded_form = F.when(path.contains("%") & (F.char_length(decoded) >= MIN_DECODED_PATH), urls.quote_plus(decoded)).otherwise(none)
    return {
        "nb_path_raw": _needle(path),
        "nb_path_bs": _needle(F.replace(path, F.lit("/"), F.lit("\\/"))),
        "nb_path_qp": form,
        "nb_path_qp_lower": urls.lower_escapes(form),
        "nb_path_noslash": F.when(F.char_length(bare) >= MIN_BARE_PATH, _needle(bare)).otherwise(none),
        "nb_path_under": _needle(F.replace(path, F.lit("/"), F.lit("_"))),
        "nb_path_json": F.when(
            path != "", F.concat(F.lit('"'), _needle(F.replace(path, F.lit("/"), F.lit("\\u002F"))), F.lit('"'))
        ).otherwise(none),
        "nb_path_unq": decoded_form,
        "nb_path_unq_lower": urls.lower_escapes(decoded_form),
    }


def long_enough(text: Column, least: int) -> Column:
    return F.when(F.char_length(text) >= least, text).otherwise(F.lit(""))


def query_needles(url: Column) -> dict[str, Column]:
    query = urls.url_query(url)
    marked = F.when(F.char_length(query) >= MIN_QUERY, F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    return {"nb_query_raw": _needle(marked), "nb_query_quoted": urls.quote(marked)}


def strip_comments(view: Column) -> Column:
    """Remove the first comments, at most MAX_COMMENTS of them."""
    return F.array_join(F.split(view, COMMENT, MAX_COMMENTS + 1), "")


def strip_fragments(view: Column, fragments: dict[str, str]) -> Column:
    for pattern in fragments.values():
        view = F.regexp_replace(view, pattern, "")
    return view


def with_fragments_stripped(df: DataFrame, step: str, fragments: dict[str, str], when: Column | None = None) -> DataFrame:
    """Apply the fragments to column `step` one after the other, each only where it can match."""
    view = F.col(step)
    for name, pattern in fragments.items():
        tests = [view.contains(mark) for mark in MARKS.get(name, [])]
        hold = reduce(or_, tests) if tests else None
        if when is not None:
            hold = when if hold is None else when & hold
        done = F.regexp_replace(view, pattern, "")
        df = df.withColumn(step, done if hold is None else F.when(hold, done).otherwise(view))
    return df


def strip_needles(view: Column, needles: dict[str, Column]) -> Column:
    for needle in needles.values():
        view = F.replace(view, needle, F.lit(""))
    return view


def with_normal_view(df: DataFrame, view: str, url: str, out: str) -> DataFrame:
    """Add `out`, the normalised form of the byte view `view` of the page at `url`."""
    path, sub, drupal, step = f"_{out}_path", f"_{out}_sub", f"_{out}_drupal", f"_{out}_step"
    whole = body_path(F.col(url))
    named = df.withColumns(
        {
            path: long_enough(whole, MIN_PATH),
            sub: long_enough(body_subpath(whole), MIN_SUBPATH),
            drupal: F.col(view).contains(DRUPAL_MARK),
        }
    )
    body = strip_needles(F.col(view), path_needles(F.col(path)))
    body = strip_needles(body, path_needles(F.col(sub)))
    body = strip_needles(body, query_needles(F.col(url)))
    stepped = named.withColumn(step, strip_comments(body))
    stepped = with_fragments_stripped(stepped, step, FRAGMENTS)
    stepped = with_fragments_stripped(stepped, step, DRUPAL_FRAGMENTS, F.col(drupal))
    stepped = with_fragments_stripped(stepped, step, LAST_FRAGMENTS)
    return with_pinned(stepped, **{out: F.col(step)}).drop(path, sub, drupal, step)


def normalize_body(df: DataFrame, body: str = "body", url: str = "url", out: str = "normal_body") -> DataFrame:
    """Add the normalised body as bytes."""
    view, plain = f"_{out}_view", f"_{out}_text"
    viewed = df.withColumn(view, byte_view(F.col(body).cast("binary")))
    done = with_normal_view(viewed, view, url, plain)
    return done.withColumn(out, view_bytes(F.col(plain))).drop(view, plain)
