"""What a URL rule (a regex) demands of a URL, found from its parse tree.

The answers only gate the regex test, so they must never be too strict: unknown means None.
`dialect.py` writes the same tree in Java's syntax.
"""

from __future__ import annotations

import re
from itertools import product

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

PLACEHOLDER = "{any_start_netloc}"
PREFIX_TEMPLATE = "^https?://" + PLACEHOLDER + "/"
MAX_HOSTS = 64

# Words so common in URLs that they tell rules apart badly.
COMMON_WORDS = {"http", "https", "www", "com", "org", "net", "html", "php", "index"}
WORD = "[A-Za-z0-9]+"

_REPEATS = {sre.MAX_REPEAT, sre.MIN_REPEAT}


def _parse(pattern: str):
    try:
        tree = sre_parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    return None if tree.state.flags & (re.IGNORECASE | re.VERBOSE | re.MULTILINE) else tree


def _pure_text(items) -> str | None:
    text = ""
    for op, arg in items:
        if op is sre.LITERAL:
            text += chr(arg)
        elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            inner = _pure_text(arg[3])
            if inner is None:
                return None
            text += inner
        else:
            return None
    return text


def _runs(items) -> list[str]:
    """Texts that every match must hold."""
    runs, run = [], ""
    for op, arg in items:
        text, inner = None, []
        if op is sre.LITERAL:
            text = chr(arg)
        elif op is sre.AT:
            continue
        elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            text = _pure_text(arg[3])
            inner = _runs(arg[3]) if text is None else []
        elif op in _REPEATS and arg[0] >= 1:
            text_once = _pure_text(arg[2])
            inner = [run + text_once] if text_once else _runs(arg[2])
        if text is not None:
            run += text
            continue
        runs += [run, *inner]
        run = ""
    return [r for r in [*runs, run] if r]


def must_contain(pattern: str) -> str | None:
    """Longest text every matching URL holds."""
    tree = _parse(pattern)
    runs = _runs(tree) if tree is not None else []
    return max(runs, key=len) if runs else None


def must_hold_word(pattern: str) -> str | None:
    """A whole word (letters and digits, other characters around it) every matching URL holds."""
    tree = _parse(pattern)
    words = set()
    for run in _runs(tree) if tree is not None else []:
        for found in re.finditer(WORD, run):
            if 0 < found.start() and found.end() < len(run):
                words.add(found.group())
    return max(words, key=lambda w: (w not in COMMON_WORDS, len(w), w)) if words else None


def _choices(op, arg) -> list[str] | None:
    """All texts one item can match, if they are few and known."""
    if op is sre.LITERAL:
        return [chr(arg)]
    if op is sre.IN:
        return [chr(a) for o, a in arg] if all(o is sre.LITERAL for o, _ in arg) else None
    if op is sre.BRANCH:
        found = [_texts(b) for b in arg[1]]
        return None if any(f is None for f in found) else [t for f in found for t in f]
    if op is sre.SUBPATTERN and not arg[1] and not arg[2]:
        return _texts(arg[3])
    if op in _REPEATS and arg[0] == 0 and arg[1] == 1:
        inner = _texts(arg[2])
        return None if inner is None else ["", *inner]
    return None


def _texts(items) -> list[str] | None:
    found = [""]
    for op, arg in items:
        options = _choices(op, arg)
        if options is None or len(found) * len(options) > MAX_HOSTS:
            return None
        found = [a + b for a, b in product(found, options)]
    return found


def anchored_hosts(pattern: str) -> list[str] | None:
    """Authorities a URL must have to match `^https?://host/...`, when they can be listed."""
    tree = _parse(pattern)
    if tree is None:
        return None
    items = list(tree)
    if not items or items[0] != (sre.AT, sre.AT_BEGINNING):
        return None
    found, rest = [""], items[1:]
    scheme_texts = {"http://", "https://"}
    while rest and not all(t in scheme_texts for t in found):
        options = _choices(*rest[0])
        if options is None:
            return None
        found = [a + b for a, b in product(found, options)]
        if not all(any(s.startswith(t) for s in scheme_texts) for t in found):
            return None
        rest = rest[1:]
    hosts = [""]
    for op, arg in rest:
        if op is sre.LITERAL and chr(arg) == "/":
            return sorted(set(hosts))
        options = _choices(op, arg)
        if options is None or any("/" in o for o in options) or len(hosts) * len(options) > MAX_HOSTS:
            return None
        hosts = [a + b for a, b in product(hosts, options)]
    return None


def python_valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return False
    return True


def has_open_choice(pattern: str) -> bool:
    """Does a valid pattern have an alternative outside all groups?"""
    depth, i = 0, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 1
        elif char == "[":
            # A closing bracket that comes first belongs to the class.
            i += 2 if pattern[i + 1 : i + 2] == "^" else 1
            i += 1 if pattern[i : i + 1] == "]" else 0
            while i < len(pattern) and pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and depth == 0:
            return True
        i += 1
    return False
