"""A rule in Python's regex syntax, written anew in Java's from its parse tree.

Both engines backtrack alike, so it is enough that each node of the tree means the same: classes
are spelled out, groups are numbered, flags other than case are resolved while printing, tests on
a group become references to an empty group inside it. What Java cannot hold (a reference inside
a look-behind, a test on a group that comes later) raises or fails to compile.
"""

from __future__ import annotations

import re

from trawlkit.functions.rules import sre, sre_parser

# Stands for the start netloc in a translated template.
MARK = "\ue000"
LONGEST = 2**31 - 1

# What Python's classes hold, as members of a Java class.
_UNICODE = {"digit": r"\p{Nd}", "word": r"\p{L}\p{N}_", "space": r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"}
_ASCII = {"digit": "0-9", "word": "0-9A-Z_a-z", "space": r"\t-\r\x20"}


def _char(code: int) -> str:
    text = chr(code)
    if text == MARK or (text.isascii() and text.isalnum()):
        return text
    return "\\" + text if 32 < code < 127 else f"\\x{{{code:x}}}"


class _Printer:
    def __init__(self, tree):
        self.numbers: dict[int, int] = {}
        self.markers: dict[int, int] = {}
        self.count = 0
        self.tested = set(_tested_groups(tree))

    def _members(self, kind: str, flags: int) -> str:
        return (_ASCII if flags & re.ASCII else _UNICODE)[kind]

    def _category(self, category, flags: int) -> str:
        name = str(category).lower().removeprefix("category_")
        members = self._members(name.removeprefix("not_"), flags)
        return f"[^{members}]" if name.startswith("not_") else members

    def _in(self, items, flags: int) -> str:
        negated, nested, inside = False, False, ""
        for op, arg in items:
            if op is sre.NEGATE:
                negated = True
            elif op is sre.LITERAL:
                inside += _char(arg)
            elif op is sre.RANGE:
                inside += f"{_char(arg[0])}-{_char(arg[1])}"
            else:
                inside += self._category(arg, flags)
                nested |= str(arg).startswith("CATEGORY_NOT")
        # Java versions disagree on what ^ covers when classes are nested.
        return f"(?:(?![{inside}])(?s:.))" if negated and nested else f"[{'^' * negated}{inside}]"

    def _at(self, place, flags: int) -> str:
        if place is sre.AT_BEGINNING:
            return r"(?:\A|(?<=\n))" if flags & re.MULTILINE else "^"
        if place is sre.AT_END:
            return r"(?=\n|\z)" if flags & re.MULTILINE else "$"
        if place in (sre.AT_BEGINNING_STRING, sre.AT_END_STRING):
            return r"\A" if place is sre.AT_BEGINNING_STRING else r"\z"
        word = f"[{self._members('word', flags)}]"
        if place is sre.AT_BOUNDARY:
            return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        return f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))"

    def _group(self, arg, flags: int) -> str:
        group, added, removed, items = arg
        inner = (flags | added) & ~removed
        opening = "(?:"
        if group is not None:
            self.count += 1
            self.numbers[group] = self.count
            opening = "("
        text = self._branch_safe(items, inner)
        if (inner ^ flags) & (re.IGNORECASE | re.ASCII):
            text = f"(?{_case(inner) or '-iu'}:{text})"
        if group in self.tested:
            self.count += 1
            self.markers[group] = self.count
            text += "()"
        return f"{opening}{text})"

    def _branch_safe(self, items, flags: int) -> str:
        return "".join(self._item(op, arg, flags) for op, arg in items)

    def _repeat(self, op, arg, flags: int) -> str:
        low, high, items = arg
        text = self._branch_safe(items, flags)
        single = len(items) == 1 and items[0][0] in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY)
        if not single:
            text = f"(?:{text})"
        kind = {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?"}.get(op, "+")
        top = "" if high >= LONGEST else str(int(high))
        short = {(0, ""): "*", (1, ""): "+", (0, "1"): "?"}.get((int(low), top))
        return text + (short or f"{{{int(low)},{top}}}") + kind

    def _exists(self, arg, flags: int) -> str:
        group, then, other = arg
        # An empty group inside the tested one is set when that is.
        seen = rf"(?:\{self.markers[group]})"
        return f"(?:{seen}{self._branch_safe(then, flags)}|(?!{seen}){self._branch_safe(other or [], flags)})"

    def _item(self, op, arg, flags: int) -> str:
        if op is sre.LITERAL:
            return _char(arg)
        if op is sre.NOT_LITERAL:
            return f"[^{_char(arg)}]"
        if op is sre.ANY:
            return "(?s:.)" if flags & re.DOTALL else r"[^\n]"
        if op is sre.IN:
            return self._in(arg, flags)
        if op is sre.BRANCH:
            return f"(?:{'|'.join(self._branch_safe(b, flags) for b in arg[1])})"
        if op is sre.SUBPATTERN:
            return self._group(arg, flags)
        if op is sre.AT:
            return self._at(arg, flags)
        if op in (sre.ASSERT, sre.ASSERT_NOT):
            look = "=" if op is sre.ASSERT else "!"
            return f"(?{'<' if arg[0] < 0 else ''}{look}{self._branch_safe(arg[1], flags)})"
        if op is sre.GROUPREF:
            return rf"(?:\{self.numbers[arg]})"
        if op is sre.GROUPREF_EXISTS:
            return self._exists(arg, flags)
        if op is sre.FAILURE:
            return "(?!)"
        if op is getattr(sre, "ATOMIC_GROUP", None):
            return f"(?>{self._branch_safe(arg, flags)})"
        return self._repeat(op, arg, flags)


def _tested_groups(node) -> list[int]:
    """Groups that some condition asks for."""
    found = []
    if isinstance(node, tuple) and len(node) == 2 and node[0] is sre.GROUPREF_EXISTS:
        found.append(node[1][0])
    if isinstance(node, (list, tuple, sre_parser.SubPattern)):
        for child in node:
            found += _tested_groups(child)
    return found


def _case(flags: int) -> str:
    if not flags & re.IGNORECASE:
        return ""
    return "i-u" if flags & re.ASCII else "iu"


def to_java(pattern: str) -> str:
    """The rule in Java's dialect; (?d) keeps \\n the only line end. Raises re.error for a bad rule."""
    tree = sre_parser.parse(pattern)
    flags = tree.state.flags
    case = _case(flags)
    return "(?d)" + (f"(?{case})" if case else "") + _Printer(tree)._branch_safe(tree, flags)
