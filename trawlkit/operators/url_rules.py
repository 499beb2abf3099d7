"""Accept or ignore URLs by regex rules, with seed exemption and blame.

Rules are operator configuration (set files of some hundred lines); they become expressions of
the plan. URLs never leave their partition for matching: a rule bound to known hosts is only
tried on URLs of those hosts, other rules only on URLs with a word some rule needs, every rule
only on URLs holding its longest fixed text, and rules with the start-netloc placeholder become
one join on the URL's authority.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import urls
from trawlkit.functions.dialect import MARK, to_java
from trawlkit.functions.pinned import with_pinned
from trawlkit.functions.rules import (
    PLACEHOLDER,
    PREFIX_TEMPLATE,
    WORD,
    anchored_hosts,
    has_open_choice,
    must_contain,
    must_hold_word,
    python_valid,
)
from trawlkit.session import broadcast_if_small

# Rules of one chain of tests, which is one expression.
CHAIN_RULES = 500

# Reasons given by verdict_url.
DATA_URI, SEED, IGNORED, PASSED = "data uri", "seed", "ignored", "passed"


@dataclass(frozen=True)
class Rule:
    set_name: str
    line_no: int
    pattern: str

    @property
    def templated(self) -> bool:
        return PLACEHOLDER in self.pattern

    @property
    def prefix_templated(self) -> bool:
        alone = self.pattern.startswith(PREFIX_TEMPLATE) and self.pattern.count(PLACEHOLDER) == 1
        return alone and not has_open_choice(self.pattern)


@dataclass(frozen=True)
class RuleSet:
    """Valid rules in order of (set_name, line_no), one per distinct pattern."""

    rules: list[Rule]
    invalid: list[Rule] = field(default_factory=list)


def pattern_lines(lines: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Keep lines that are rules: not empty, no comment. A leading space is part of a rule."""
    text = F.col(pattern)
    return lines.where((F.length(text) > 0) & ~text.startswith("#"))


def java_valid(spark, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(to_java(pattern))
    except Exception:
        return False
    return True


def _read_lines(patterns: DataFrame) -> list[Rule]:
    rows = pattern_lines(patterns).select("set_name", "line_no", "pattern").collect()
    return sorted((Rule(*row) for row in rows), key=lambda r: (r.set_name, r.line_no))


def load_rules(patterns: DataFrame, sets: list[str] | None = None, per_set: bool = False) -> RuleSet:
    """Read the rule table (set_name, line_no, pattern) into a RuleSet.

    A bad regex is set aside in `invalid` and the other rules stay in force. With `per_set` a
    pattern is kept in each set that has it, for URLs on which only some sets are active.
    """
    spark = patterns.sparkSession
    chosen = patterns if sets is None else patterns.where(F.col("set_name").isin(list(sets)))
    good, bad, seen = [], [], set()
    for rule in _read_lines(chosen):
        key = (rule.set_name if per_set else "", rule.pattern)
        if key in seen:
            continue
        seen.add(key)
        probe = rule.pattern.replace(PLACEHOLDER, "x")
        (good if python_valid(probe) and java_valid(spark, probe) else bad).append(rule)
    return RuleSet(good, bad)


def rule_validity(spark, patterns: DataFrame) -> DataFrame:
    """The rule table with a column `valid`."""
    rules = load_rules(patterns)
    bad = [r.pattern for r in rules.invalid]
    flag = ~F.col("pattern").isin(bad) if bad else F.lit(True)
    return pattern_lines(patterns).withColumn("valid", flag)


def start_netlocs(seeds: DataFrame, compat_empty_seeds: bool = False) -> DataFrame:
    """Distinct (job, netloc) of the seeds.

    With `compat_empty_seeds` a job counts as having one empty seed and no other.
    """
    if compat_empty_seeds:
        return seeds.select("job", F.lit("").alias("netloc")).distinct()
    return seeds.select("job", urls.url_netloc(F.col("url")).alias("netloc")).distinct()


def _literal_rules(rules: list[Rule]) -> Column:
    """The rules as one value, however many."""
    rows = json.dumps([{"set_name": r.set_name, "line_no": r.line_no, "pattern": r.pattern} for r in rules])
    return F.from_json(F.lit(rows), "array<struct<set_name: string, line_no: int, pattern: string>>")


def expand_patterns(patterns: DataFrame, netlocs: DataFrame) -> DataFrame:
    """(job, set_name, line_no, pattern) with placeholders filled in: the list shown to operators.

    A report for people; matching never needs the expanded list.
    """
    lines = _read_lines(patterns)
    templated, plain = [r for r in lines if r.templated], [r for r in lines if not r.templated]
    parts = []
    if templated:
        filled = netlocs.select("job", "netloc", F.inline(_literal_rules(templated)))
        text = F.replace(F.col("pattern"), F.lit(PLACEHOLDER), urls.regex_escape(F.col("netloc")))
        parts.append(filled.select("job", "set_name", "line_no", text.alias("pattern")))
    if plain:
        parts.append(netlocs.select("job").distinct().select("job", F.inline(_literal_rules(plain))))
    if not parts:
        return netlocs.sparkSession.createDataFrame([], "job string, set_name string, line_no int, pattern string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def distinct_patterns(expanded: DataFrame) -> DataFrame:
    """Each pattern of a job once, with the lowest (set_name, line_no) it comes from."""
    origin = F.min(F.struct("set_name", "line_no")).alias("origin")
    return expanded.groupBy("job", "pattern").agg(origin).select("job", "pattern", "origin.set_name", "origin.line_no")


@dataclass(frozen=True)
class _Test:
    """A rule as tried on a URL: its place, its regex, and what a URL must hold for it."""

    index: int
    regex: str
    text: str | None
    word: str | None

    def on(self, url: Column) -> Column:
        hit = url.rlike(self.regex)
        return F.when(hit if self.text is None else url.contains(self.text) & hit, F.lit(self.index))


def _test(index: int, pattern: str) -> _Test:
    return _Test(index, to_java(pattern), must_contain(pattern), must_hold_word(pattern))


def _tried(tests: list[_Test]) -> Callable[[Column], Column]:
    return lambda url: F.coalesce(*[t.on(url) for t in tests])


def _chain(url: Column, tests: list[_Test]) -> Column:
    """First test that hits. Run inside a lambda, so the plan's generated code stays small
    enough to be compiled."""
    parts = [tests[k : k + CHAIN_RULES] for k in range(0, len(tests), CHAIN_RULES)]
    found = [F.element_at(F.transform(F.array(url), _tried(part)), 1) for part in parts]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def _first(url: Column, words: Column, tests: list[_Test]) -> Column:
    gated, rest = [t for t in tests if t.word], [t for t in tests if not t.word]
    parts = []
    if gated:
        wanted = sorted({t.word for t in gated})
        parts.append(F.when(F.exists(words, lambda w: w.isin(wanted)), _chain(url, gated)))
    if rest:
        parts.append(_chain(url, rest))
    return parts[0] if len(parts) == 1 else F.least(*parts)


def _generic_template(pattern: str) -> str:
    return pattern.replace(PLACEHOLDER, "[^/]*")


def _loose_template(pattern: str) -> str:
    return pattern.replace(PLACEHOLDER, "(?:[^/?#]*)")


def _without_netloc(pattern: str) -> str | None:
    """What is left of a template where its placeholder takes no part in the match."""
    return None if "(?!" in pattern or "(?<!" in pattern else pattern.replace(PLACEHOLDER, "(?!)")


def _by_set(indexed: list[tuple[int, Rule]]) -> dict[str, list[tuple[int, Rule]]]:
    grouped: dict[str, list[tuple[int, Rule]]] = {}
    for i, rule in indexed:
        grouped.setdefault(rule.set_name, []).append((i, rule))
    return grouped


def first_rule(
    url: Column, words: Column, authority: Column, on_start_netloc: Column, rules: RuleSet, active_sets: Column | None = None
) -> Column:
    """Index of the first rule that matches, null for none (floating templates apart).

    `words` are all matches of WORD in the URL.
    """
    parts = []
    for set_name, members in _by_set(list(enumerate(rules.rules))).items():
        anchored, templated, generic, hosts = [], [], [], set()
        for i, rule in members:
            if rule.prefix_templated:
                templated.append(_test(i, _generic_template(rule.pattern)))
            elif not rule.templated:
                listed = anchored_hosts(rule.pattern)
                (generic if listed is None else anchored).append(_test(i, rule.pattern))
                hosts.update(listed or [])
        found = []
        if anchored:
            found.append(F.when(authority.isin(sorted(hosts)), _chain(url, anchored)))
        if templated:
            found.append(F.when(on_start_netloc, _first(url, words, templated)))
        if generic:
            found.append(_first(url, words, generic))
        if active_sets is not None:
            found = [F.when(F.array_contains(active_sets, set_name), f) for f in found]
        parts += found
    if not parts:
        return F.lit(None).cast("int")
    return parts[0] if len(parts) == 1 else F.least(*parts)


def _floating_hits(candidates: DataFrame, netlocs: DataFrame, rules: RuleSet) -> DataFrame | None:
    """(job, url, floating) for templates whose netloc may stand anywhere in the URL: their hits
    in order of the rules, one for each.

    URLs that pass the loose form are cut into the pieces a start netloc of their job could
    be (its lengths are few), and the pieces are joined to the netlocs by equality. A URL that
    matches without the netloc (in another alternative) is given the job's least one.
    """
    floating = [(i, r) for i, r in enumerate(rules.rules) if r.templated and not r.prefix_templated]
    if not floating:
        return None
    url = F.col("url")

    def near_rule(i: int, rule: Rule) -> Column:
        free = _without_netloc(rule.pattern)
        free = F.lit(False) if free is None else url.rlike(to_java(free))
        return F.when(url.rlike(to_java(_loose_template(rule.pattern))), F.struct(F.lit(i).alias("rule"), free.alias("free")))

    near = (
        candidates.select("job", "url")
        .withColumn("rules", F.array_compact(F.array(*[near_rule(i, r) for i, r in floating])))
        .where(F.size("rules") > 0)
        .distinct()
        .select("job", "url", F.inline("rules"))
    )
    sizes = netlocs.groupBy("job").agg(F.collect_set(F.length("netloc")).alias("sizes"))
    pieces = (
        near.where(~F.col("free"))
        .join(broadcast_if_small(sizes), "job")
        .select("job", "url", "rule", F.explode("sizes").alias("size"))
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.length("url") - F.col("size") + 1, F.lit(1)))))
        .select("job", "url", "rule", url.substr(F.col("start"), F.col("size")).alias("netloc"))
        .where(~F.col("netloc").rlike("[/?#]"))
        .distinct()
    )
    shown = F.create_map(*[F.lit(x) for i, r in floating for x in (i, r.pattern)])
    tried = F.create_map(*[F.lit(x) for i, r in floating for x in (i, to_java(r.pattern.replace(PLACEHOLDER, MARK)))])
    escaped = urls.regex_escape(F.col("netloc"))
    tried = F.replace(tried[F.col("rule")], F.lit(MARK), escaped)
    bound = pieces.join(broadcast_if_small(netlocs), ["job", "netloc"]).withColumn("tried", tried).where(F.expr("url RLIKE tried"))
    least = netlocs.groupBy("job").agg(F.min("netloc").alias("netloc"))
    unbound = near.where("free").join(broadcast_if_small(least), "job")
    hits = bound.select("job", "url", "rule", "netloc").unionByName(unbound.select("job", "url", "rule", "netloc"))
    filled = F.replace(shown[F.col("rule")], F.lit(PLACEHOLDER), escaped).alias("filled")
    firsts = hits.select("job", "url", "rule", filled).groupBy("job", "url", "rule").agg(F.min("filled").alias("filled"))
    return firsts.groupBy("job", "url").agg(F.sort_array(F.collect_list(F.struct("rule", "filled"))).alias("floating"))


def match_rules(
    candidates: DataFrame, seeds: DataFrame, rules: RuleSet, compat_empty_seeds: bool = False, active_sets: str | None = None
) -> DataFrame:
    """Add `ignored` and the blamed `pattern` (placeholder filled in) to candidates(job, url, ...)."""
    netlocs = start_netlocs(seeds, compat_empty_seeds)
    authority = urls.slash_authority(F.col("url"))
    marked = candidates.withColumns({"_authority": authority, "_words": F.regexp_extract_all(F.col("url"), F.lit(WORD), 0)})
    floating = _floating_hits(candidates, netlocs, rules)
    if any(r.prefix_templated for r in rules.rules):
        flags = netlocs.select("job", F.col("netloc").alias("_authority"), F.lit(True).alias("_start"))
        marked = marked.join(broadcast_if_small(flags), ["job", "_authority"], "left")
    else:
        marked = marked.withColumn("_start", F.lit(False))
    sets = None if active_sets is None else F.col(active_sets)
    on_start = F.coalesce(F.col("_start"), F.lit(False))
    hit = first_rule(F.col("url"), F.col("_words"), F.col("_authority"), on_start, rules, sets)
    marked = with_pinned(marked, _rule=hit)
    filled = F.lit(None).cast("string")
    if floating is not None:
        marked = marked.join(floating, ["job", "url"], "left")
        hits = F.col("floating")
        if sets is not None:
            set_of = F.from_json(F.lit(json.dumps([r.set_name for r in rules.rules])), "array<string>")
            hits = F.filter(hits, lambda h: F.array_contains(sets, F.element_at(set_of, h["rule"] + 1)))
        marked = marked.withColumn("floating", F.get(hits, F.lit(0)))
        first = F.least(F.col("_rule"), F.col("floating.rule"))
        filled = F.when(F.col("floating.rule") == first, F.col("floating.filled"))
        marked = marked.withColumn("_filled", filled).withColumn("_rule", first).drop("floating")
        filled = F.col("_filled")
    if rules.rules:
        texts = F.from_json(F.lit(json.dumps([r.pattern for r in rules.rules])), "array<string>")
        text = F.replace(
            F.element_at(texts, F.col("_rule") + 1), F.lit(PLACEHOLDER), urls.regex_escape(F.col("_authority"))
        )
        blamed = F.coalesce(filled, text)
    else:
        blamed = filled
    return (
        marked.withColumn("ignored", F.col("_rule").isNotNull())
        .withColumn("pattern", blamed)
        .drop("_authority", "_words", "_start", "_rule", "_filled")
    )


def is_data_uri(url: Column) -> Column:
    return url.startswith("data:")


def mark_seeds(candidates: DataFrame, seeds: DataFrame, out: str = "is_seed", compat_empty_seeds: bool = False) -> DataFrame:
    """Flag URLs equal to a seed of their job."""
    if compat_empty_seeds:
        return candidates.withColumn(out, F.col("url") == "")
    known = seeds.select("job", "url").distinct().withColumn(out, F.lit(True))
    joined = candidates.join(broadcast_if_small(known), ["job", "url"], "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def verdict_url(
    candidates: DataFrame,
    seeds: DataFrame,
    rules: RuleSet,
    compat_empty_seeds: bool = False,
    active_sets: str | None = None,
) -> DataFrame:
    """Decide on candidates(job, url, verdict, ...): adds accepted, reason, pattern.

    A data URI is refused; a seed keeps its incoming verdict; an ignored URL is refused; any
    other URL keeps its incoming verdict.
    """
    matched = match_rules(candidates, seeds, rules, compat_empty_seeds, active_sets)
    flagged = mark_seeds(matched, seeds, "_seed", compat_empty_seeds)
    reason = (
        F.when(is_data_uri(F.col("url")), F.lit(DATA_URI))
        .when(F.col("_seed"), F.lit(SEED))
        .when(F.col("ignored"), F.lit(IGNORED))
        .otherwise(F.lit(PASSED))
    )
    return (
        flagged.withColumn("reason", reason)
        .withColumn("accepted", F.when(F.col("reason").isin(DATA_URI, IGNORED), F.lit(False)).otherwise(F.col("verdict")))
        .withColumn("pattern", F.when(F.col("reason") == IGNORED, F.col("pattern")))
        .drop("_seed", "ignored")
    )


def ignore_reports(verdicts: DataFrame, suppressed: str = "suppressed") -> DataFrame:
    """Rows to report: ignored URLs seen while reporting is on."""
    return verdicts.where((F.col("reason") == IGNORED) & ~F.col(suppressed))
