"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Native expressions only. A kind's finds come as an array: the text is split at the pattern, the
finds are extracted by it, and running sums of the lengths give the positions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions.pinned import with_pinned
from trawlkit.llm.common import MARK, rebuilt

# Score an additional kind needs; a base kind is kept whatever its score.
LEAST_SCORE = 0.6
# What a context word near a find adds.
CONTEXT_GAIN = 0.3
# Code points looked at before and after a find.
BEFORE, AFTER = 40, 20


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's checksum of a string of digits."""

    def worth(place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(place % 2 == 1, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, place: total + worth(place)) % 10 == 0


def mod97(account: Column) -> Column:
    """An account number's check: rotated by four, letters as 10 to 35, remainder 1."""
    bare = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(rest: Column, place: Column) -> Column:
        code = F.ascii(F.substring(turned, place, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def parts_below_256(address: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    small = lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255")
    return F.forall(F.split(address, "[.]"), small)


def digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda found: F.length(digits_of(found)).between(low, high)


def card_number(found: Column) -> Column:
    digits = digits_of(found)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def social_number(found: Column) -> Column:
    return ~found.rlike("^(000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. `hint` is a cheap test a text must pass to be searched at all."""

    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: float
    context: str
    hint: Callable[[Column], Column]
    base: bool = True


def has(mark: str) -> Callable[[Column], Column]:
    return lambda text: F.contains(text, F.lit(mark))


def like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


# Countries of account numbers by the number of characters, spaces not counted.
ACCOUNT_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FO FI GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def account_pattern() -> str:
    """Account numbers of the length their country has, so that what follows one is never part of it.

    Of other countries, as many characters as can be had.
    """
    known = [rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{size - 4}}}" for size, names in ACCOUNT_LENGTHS.items()]
    others = rf"(?!{'|'.join(' '.join(ACCOUNT_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join([*known, others])})(?![A-Za-z0-9])"


# Possessive runs keep the matcher from recursing or going back over long texts; they end where the
# greedy ones do, as what follows a run is never part of it. A find of email can only begin where a
# run of its characters begins, or right after the find before.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda f: F.lit(True), 0.9, "mail|contact", has("@")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", parts_below_256, 0.5, r"\bip\b|address|host|server|login", like(r"[0-9]\.[0-9]")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", card_number, 0.9, "card|visa|master|credit|payment", like(r"[0-9](?:[\x20-]?[0-9]){13}")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", digit_count(10, 15), 0.8, "phone|tel|call|mobile|fax|whatsapp", has("+")),
    Kind("iban", account_pattern(), mod97, 0.8, "iban|account|bank", like(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", social_number, 0.4, r"\bssn\b|social security|tax", like("[0-9]-[0-9]{2}-[0-9]"), False),
    Kind("local_phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", digit_count(10, 10), 0.4, "phone|tel|call|mobile|fax|whatsapp", like(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"), False),
)
BASE = tuple(k for k in KINDS if k.base)
# Redaction replaces a phone before the card that may lie inside it.
REDACTION_ORDER = ("email", "iban", "phone", "card", "ip", "ssn", "local_phone")


def _column(what: str, kind: Kind) -> str:
    return f"{MARK}{what}_{kind.name}"


def _add_finds(df: DataFrame, text: str, kinds: tuple[Kind, ...]) -> DataFrame:
    """Per kind the text between finds, one piece more than finds, and the finds."""
    body, columns = F.col(f"`{text}`"), {}
    for kind in kinds:
        searched = kind.hint(body)
        columns[_column("pieces", kind)] = F.when(searched, F.split(body, kind.pattern, -1)).otherwise(F.array(body))
        finds = F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))
        columns[_column("finds", kind)] = F.when(searched, finds).otherwise(F.array().cast("array<string>"))
    return with_pinned(df, **columns)


def _score(kind: Kind, i: Column) -> Column:
    """The kind's score, more where the text next to the find, up to its neighbours, has a context word."""
    pieces = F.col(_column("pieces", kind))
    near = F.concat_ws(" ", F.right(F.get(pieces, i), F.lit(BEFORE)), F.left(F.get(pieces, i + 1), F.lit(AFTER)))
    gain = F.when(F.lower(near).rlike(kind.context), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(kind.score) + gain)


def _accepted(kind: Kind, find: Column, i: Column) -> Column:
    return kind.confirmed(find) if kind.base else kind.confirmed(find) & (_score(kind, i) >= LEAST_SCORE)


def _add_ends(df: DataFrame) -> DataFrame:
    """Where each find ends: running sums of the lengths of pieces and finds.

    In blocks of about the root of their number, as appending to an array copies it each time. Each
    step is pinned, since an expression inside a lambda is evaluated once per entry.
    """

    def lengths(kind: Kind) -> Column:
        pieces = F.col(_column("pieces", kind))
        return F.transform(_column("finds", kind), lambda find, i: (F.length(find) + F.length(F.get(pieces, i))).cast("long"))

    def blocks(kind: Kind) -> Column:
        steps = F.col(_column("steps", kind))
        width = F.ceil(F.sqrt(F.size(steps))).cast("int")
        starts = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / width).cast("int"))
        cut = F.transform(starts, lambda b: F.slice(steps, b * width + 1, width))
        return F.when(F.size(steps) > 0, cut).otherwise(F.array().cast("array<array<bigint>>"))

    zero = F.lit(0).cast("long")

    def sums(start: Column, entries: Column) -> Column:
        return F.aggregate(entries, F.array(start), lambda done, x: F.array_append(done, F.element_at(done, -1) + x))

    def before(kind: Kind) -> Column:
        totals = F.transform(_column("blocks", kind), lambda block: F.aggregate(block, zero, lambda done, x: done + x))
        return sums(zero, totals)

    def ends(kind: Kind) -> Column:
        start = F.col(_column("before", kind))
        within = F.transform(_column("blocks", kind), lambda block, b: F.slice(sums(F.get(start, b), block), F.lit(2), F.size(block)))
        return F.flatten(within)

    for what, make in (("steps", lengths), ("blocks", blocks), ("before", before), ("ends", ends)):
        df = with_pinned(df, **{_column(what, kind): make(kind) for kind in KINDS})
    return df


def _spans(kind: Kind, rank: int) -> Column:
    ends = F.col(_column("ends", kind))

    def span(find: Column, i: Column) -> Column:
        return F.struct(
            (F.get(ends, i) - F.length(find)).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"),
            F.lit(kind.name).alias("kind"), _score(kind, i).alias("score"), _accepted(kind, find, i).alias("accepted"),
        )

    return F.filter(F.transform(_column("finds", kind), span), lambda s: s["accepted"])


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_spans and personal_spans to every row.

    Spans are structs (start, end, kind, score) in code points, end exclusive, by start and then by
    kind as listed in KINDS. The base kinds are kept as the pattern and its checksum say; of the
    others (account numbers, social security numbers, local phones) only finds that reach
    LEAST_SCORE and overlap no base span. A null text counts as empty: no spans. Repeated rows give
    repeated results. Own columns of the output names give way.
    """
    work = docs.withColumn(f"{MARK}text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    work = _add_ends(_add_finds(work, f"{MARK}text", KINDS))
    work = with_pinned(work, **{_column("spans", kind): _spans(kind, rank) for rank, kind in enumerate(KINDS)})
    base, more = (F.concat(*[F.col(_column("spans", k)) for k in KINDS if k.base == own]) for own in (True, False))
    work = with_pinned(work, **{f"{MARK}base": F.array_sort(base), f"{MARK}more": more})
    apart = lambda s: ~F.exists(f"{MARK}base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    every = F.array_sort(F.concat(F.col(f"{MARK}base"), F.filter(f"{MARK}more", apart)))
    shape = lambda spans: F.transform(spans, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "end", "kind", "score")]))
    counts = {f"n_{k.name}": F.size(_column("spans", k)).cast("long") for k in BASE}
    outputs = {**counts, "base_spans": shape(F.col(f"{MARK}base")), "personal_spans": shape(every)}
    own = [c for c in docs.columns if c.lower() not in outputs]
    return with_pinned(work.drop(*[c for c in docs.columns if c.lower() in outputs]), **outputs).select(*[F.col(f"`{c}`") for c in [*own, *outputs]])


def joined_spans(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with each find replaced by its kind's name in brackets; a null text stays null.

    Kinds go one after the other, in REDACTION_ORDER. What a later kind finds is judged in the text
    as it then is, so overlapping finds are replaced once.
    """
    by_name = {k.name: k for k in KINDS}
    work = docs.withColumn(f"{MARK}body_", F.col(f"`{text}`"))
    for name in REDACTION_ORDER:
        work = _redact_kind(work, by_name[name])
    return rebuilt(work.withColumn(text, F.col(f"{MARK}body_")), docs.columns)


def _redact_kind(work: DataFrame, kind: Kind) -> DataFrame:
    work = _add_finds(work, f"{MARK}body_", (kind,))
    pieces, finds = F.col(_column("pieces", kind)), F.col(_column("finds", kind))

    def shown(find: Column, i: Column) -> Column:
        return F.concat(F.get(pieces, i), F.when(_accepted(kind, find, i), F.lit(f"[{kind.name.upper()}]")).otherwise(find))

    whole = F.concat(F.array_join(F.transform(finds, shown), ""), F.element_at(pieces, -1))
    body = F.when(F.size(finds) > 0, whole).otherwise(F.col(f"{MARK}body_"))
    return with_pinned(work, **{f"{MARK}next": body}).drop(f"{MARK}body_", *[_column(w, kind) for w in ("pieces", "finds")]).withColumnRenamed(f"{MARK}next", f"{MARK}body_")
