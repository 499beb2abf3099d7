"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(PATTERNS) for m in p.finditer(text or "") if valid(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def similar(rows):
    """(number of shingles, least id reachable) per (id, text) row."""
    sets, parent, lists = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in lists[s])
        for s in own:
            lists[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)]


def without_repeats(texts, window=400):
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if times[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def without_lines(rows, least=10):
    """(id, text, lines, removed) after boilerplate removal of (id, text, site) rows."""
    bare = lambda line: line.strip(" \t\r")
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if bare(line) and site is not None:
                sites[bare(line)].add(site)
    out = []
    for doc_id, text, _ in rows:
        parts = text.split("\n") if text is not None else []
        kept = [p for p in parts if len(sites[bare(p)]) < least]
        if not any(bare(p) for p in kept):
            kept = parts
        out.append((doc_id, "\n".join(kept) if text is not None else None, len(parts), len(parts) - len(kept)))
    return out


def least_padding(lengths, buckets):
    """The least total padded size by trying every choice of boundaries."""
    from itertools import combinations

    kinds = sorted(set(lengths))
    best = None
    for count in range(min(buckets, len(kinds))):
        for cut in combinations(kinds[:-1], count):
            bounds = [*cut, kinds[-1]]
            size = sum(min(b for b in bounds if b >= n) for n in lengths)
            best = size if best is None else min(best, size)
    return best or 0
