"""Rules that change while crawls run: each URL meets the rules in force when it was offered.

Rule sets are versioned: all rows of versions(set_name, line_no, pattern, effective_ts) with one set
and time are that set's lines from then on; a null time means from the start. Which sets a crawl uses
is a log controls(job, name, value, effective_ts, seq) of its `igsets`. A crawl's own rules are the
set named OWN + job. Sets and their versions are operator configuration; the log and the URLs are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawlkit.functions.values import parse_igsets
from trawlkit.operators.asof import as_of, micros
from trawlkit.operators.url_rules import RuleSet, load_rules, verdict_url
from trawlkit.session import written_table

OWN = "own:"
# Fixed value: the control that names the sets of a crawl.
IGSETS = "igsets"

# Parts a set from the start of its version; it sorts before every character of a name.
_PART = "\x00"


def sets_asof(events: DataFrame, controls: DataFrame, default: Sequence[str] = ("global",), ts: str = "ts", order: str = "seq", out: str = "active_sets") -> DataFrame:
    """Add the names of the sets in use at the event, the crawl's own among them.

    Of several changes at one instant the last by log order counts. A crawl that named no sets
    yet, and an event without a time, have the default ones. An empty text means no set.
    """
    named = controls.where((F.col("name") == IGSETS) & F.col("value").isNotNull() & F.col("effective_ts").isNotNull())
    last = F.max(F.struct(F.col(order), "value")).getField("value")
    changes = named.groupBy("job", micros(F.col("effective_ts")).alias("_at")).agg(parse_igsets(last).alias(out))
    found = as_of(events, written_table(changes, "igsets"), ["job"], [out], micros(F.col(ts)))
    chosen = F.coalesce(F.col(out), F.array(*[F.lit(s) for s in default]).cast("array<string>"))
    own = F.array_compact(F.array(F.concat(F.lit(OWN), F.col("job"))))
    return found.withColumn(out, F.concat(chosen, own))


def load_versions(versions: DataFrame) -> tuple[RuleSet, list[tuple[str, str, int | None, int | None]]]:
    """The rules, each in a set named after its version, and (set, version, from, until) in microseconds."""
    timed = versions.withColumn("_from", micros(F.col("effective_ts")))
    starts = timed.select("set_name", "_from").distinct()
    until = F.lead("_from").over(W.partitionBy("set_name").orderBy(F.col("_from").asc_nulls_first()))
    spans = starts.withColumn("_until", until).collect()
    version = F.concat("set_name", F.lit(_PART), F.coalesce(F.col("_from").cast("string"), F.lit("")))
    rules = load_rules(timed.select(version.alias("set_name"), "line_no", "pattern"), per_set=True)
    named = [(r.set_name, f"{r.set_name}{_PART}{'' if r._from is None else r._from}", r._from, r._until) for r in spans]
    return rules, sorted(named, key=lambda n: n[1])


def _in_force(sets: Column, at: Column, spans: list[tuple[str, str, int | None, int | None]]) -> Column:
    """Versions of the sets that hold at a time; without a time those from the start."""
    found = []
    for name, version, since, until in spans:
        holds = F.array_contains(sets, name)
        if since is not None:
            holds = holds & F.coalesce(at >= since, F.lit(False))
        if until is not None:
            holds = holds & F.coalesce(at < until, F.lit(since is None))
        found.append(F.when(holds, F.lit(version)))
    return F.array_compact(F.array(*found)).cast("array<string>")


def verdict_asof(
    candidates: DataFrame, seeds: DataFrame, versions: DataFrame, controls: DataFrame, default: Sequence[str] = ("global",), ts: str = "ts", order: str = "seq"
) -> DataFrame:
    """Verdicts on candidates(job, url, verdict, ts, ...) under the sets and versions of their time.

    Adds accepted, reason, pattern. The result depends on the two logs up to a URL's time only, so a
    replay with longer logs gives the same rows.
    """
    rules, spans = load_versions(versions)
    chosen = sets_asof(candidates, controls, default, ts, order, "_sets")
    placed = chosen.withColumn("_sets", _in_force(F.col("_sets"), micros(F.col(ts)), spans))
    return verdict_url(placed, seeds, rules, active_sets="_sets").drop("_sets")
