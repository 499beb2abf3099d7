"""Rules in Python's syntax, run by Java: the same URLs must match."""

import random
import re

import pytest

from trawlkit.functions.dialect import to_java
from trawlkit.functions.rules import PLACEHOLDER, has_open_choice
from trawlkit.operators import url_rules as U

pytestmark = pytest.mark.filterwarnings("ignore::FutureWarning")

# Rules whose spelling Java reads otherwise or not at all, with texts that tell.
LITERAL = [
    ("[?&[]x=", ["http://h/?x=", "http://h/[x=", "http://h/x="]),
    ("/{id}/", ["http://h/{id}/", "http://h/id/"]),
    ("/a{,3}b$", ["/b", "/aaab", "/aaaab", "/a{,3}b"]),
    ("[[]y", ["[y", "y"]),
    ("[a&&b]z", ["az", "&z", "bz", "cz"]),
    (r"\\Z", [r"\Z", "Z", ""]),
    (r"a\Z", ["a", "a\n", "ab"]),
    ("a$", ["a", "a\n", "a\r", "a ", "ab"]),
    ("(?m)^b$", ["a\nb", "a\rb", "b\nc", "b\u0085"]),
    (".b", ["\rb", "\nb", " b", "xb"]),
    ("(?s).b", ["\nb", "b"]),
    (r"\d", ["٣", "5", "x", "²"]),
    (r"^\w+$", ["été", "a-b", "a_1", "中"]),
    (r"[^\W\d]x", ["ax", "1x", "-x", "_x"]),
    (r"[^a\S]x", [" x", "ax", "bx", " x"]),
    (r"\bcaf\b", ["café", "caf-", "caf", "xcaf"]),
    (r"\Bb", ["ab", "-b", "b"]),
    (r"\s", [" ", "　", "\x1c", "a"]),
    ("(?P<x>a+)-(?P=x)$", ["aa-aa", "aa-aaa", "b-b"]),
    (r"(a)|(b)\2", ["bb", "b", "a"]),
    (r"(a)\1[0]", ["aa0", "a0"]),
    (r"(<)?h(?(1)>|$)", ["<h>", "h", "<h", "h>"]),
    ("(?i)Äb", ["äB", "ab"]),
    ("a(?i:b)c", ["aBc", "aBC", "abc"]),
    ("(?i)a(?-i:b)", ["Ab", "AB"]),
    ("(?ia)ké", ["Ké", "Ké", "KÉ"]),
    (r"(?a)\d\w", ["5a", "٣a", "5é"]),
    ("(?x) a b # note", ["ab", "a b"]),
    ("(?>a+)b", ["aab", "ab", "b"]),
    ("a++b", ["aab", "b"]),
    ("a{2}?b", ["aab", "ab"]),
    ("(?<!x)y(?!z)", ["y", "xy", "yz"]),
    ("x(?!)", ["x", ""]),
    ("[]a]b", ["]b", "ab", "b"]),
    ("[^]]b", ["]b", "ab"]),
    ("[a-]x", ["-x", "ax", "bx"]),
    ("a|", ["a", "b", ""]),
    (r"\x41é\N{COLON}\0", ["Aé:\x00", "A"]),
    ("#x", ["#x", "x"]),
]


def matches(spark, pairs):
    """Java's answers for (pattern, text) pairs."""
    rows = [(i, to_java(p), t) for i, (p, t) in enumerate(pairs)]
    table = spark.createDataFrame(rows, "i int, p string, t string").selectExpr("i", "t RLIKE p AS hit")
    return [r.hit for r in table.orderBy("i").collect()]


def different(spark, pairs):
    return [(p, t, hit) for (p, t), hit in zip(pairs, matches(spark, pairs)) if hit != bool(re.search(p, t))]


def test_literal_rules_mean_the_same(spark):
    assert different(spark, [(p, t) for p, texts in LITERAL for t in texts]) == []


ATOMS = ["a", "b", "/", "-", "é", r"\.", r"\d", r"\w", r"\W", r"\S", ".", "[ab]", "[^a/]", "[[&]", "[&&b]", r"[^\W_]", r"[\d-]", "[a-c~]", "{", "}", "]", "&", "#", " ", r"\b", "^", "$", r"\B"]
TEXTS = list("ab/-é.1_&#{}[] ~A") + ["\n"]


def grown(rnd, depth):
    """A random rule."""
    parts = []
    for _ in range(rnd.randint(1, 4)):
        if depth and rnd.random() < 0.4:
            opening = rnd.choice(["(", "(?:", "(?=", "(?!", "(?i:", "(?s:", "(?>", "(?m:"])
            part = opening + "|".join(grown(rnd, depth - 1) for _ in range(rnd.randint(1, 3))) + ")"
        else:
            part = rnd.choice(ATOMS)
        parts.append(part + rnd.choice(["", "", "", "", "?", "*", "+", "{2}", "{,2}", "{1,}", "*?", "?+"]))
    return "".join(parts)


def test_random_rules_mean_the_same(spark):
    rnd, pairs = random.Random(11), []
    while len(pairs) < 20_000:
        rule = rnd.choice(["", "", "(?i)", "(?m)", "(?s)", "(?a)"]) + grown(rnd, 2)
        try:
            re.compile(rule)
        except re.error:
            continue
        pairs += [(rule, "".join(rnd.choices(TEXTS, k=rnd.randint(1, 9)))) for _ in range(8)]
    assert different(spark, pairs) == []


def test_every_readable_rule_is_loaded(spark):
    rows = [("user", i, p) for i, (p, _) in enumerate(LITERAL)] + [("user", 900, "a("), ("user", 901, "*")]
    rules = U.load_rules(spark.createDataFrame(rows, "set_name string, line_no int, pattern string"))
    assert [r.line_no for r in rules.invalid] == [900, 901]
    # "#x" is a comment line.
    assert len(rules.rules) == len(LITERAL) - 1


@pytest.mark.parametrize("pattern, found", [("a|b", True), ("(a|b)", False), ("[|]", False), ("[]|]", False), ("[^]|]x|y", True), (r"\|", False), (r"\(|b", True), ("(?:a)(b|c)d", False)])
def test_open_choice(pattern, found):
    assert has_open_choice(pattern) is found


TEMPLATES = [
    "^https?://" + PLACEHOLDER + "/a|zzz",
    "[?&[]to=" + PLACEHOLDER + "+$",
    r"(?P<q>[=])" + PLACEHOLDER + r"(?P=q)",
    "(?i)/TO/" + PLACEHOLDER + r"\Z",
]


def test_templates_of_the_dialect(spark):
    seeds = [("j", "http://one.example/"), ("j", "http://two.example:80/x")]
    netlocs = ["one.example", "two.example:80"]
    found = [
        "http://one.example/a", "http://other/a", "http://other/zzz", "http://h/?to=one.example", "http://h/[to=one.exampleee",
        "http://h/[to=oneXexample", "http://h/?x=two.example:80=", "http://h/?x=two.example:81=", "http://h/to/one.example", "http://h/to/one.example/",
    ]
    rows = [("s", i, t) for i, t in enumerate(TEMPLATES)]
    rules = U.load_rules(spark.createDataFrame(rows, "set_name string, line_no int, pattern string"))
    assert not rules.invalid
    candidates = spark.createDataFrame([("j", u) for u in found], "job string, url string")
    table = U.match_rules(candidates, spark.createDataFrame(seeds, "job string, url string"), rules)
    expected = {}
    for url in found:
        filled = [t.replace(PLACEHOLDER, re.escape(n)) for t in TEMPLATES for n in netlocs]
        expected[url] = next((f for f in filled if re.search(f, url)), None)
    assert sum(v is not None for v in expected.values()) >= 5
    assert {r.url: r.pattern for r in table.collect()} == expected
