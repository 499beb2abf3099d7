"""Settings that change while a crawl runs: a change log controls(job, name, value, effective_ts, seq).

A text that its setting refuses leaves the last good value in force. Of several changes at one
instant the last good one by log order (`seq`) counts; a log without that column is ordered by the
text. A setting that was never set has its default.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import values as V
from trawlkit.functions.pinned import with_pinned
from trawlkit.operators.asof import as_of, micros
from trawlkit.operators.running import running
from trawlkit.session import broadcast_if_small, lookup_side, written_table


@dataclass(frozen=True)
class Setting:
    control: str  # its name in the log
    read: Callable[[Column], Column]  # null for texts it refuses
    default: int | bool | None


# Names, controls and defaults of the settings in job data.
SETTINGS = {
    "max_content_length": Setting("max_content_length", V.whole_number, -1),
    "suppress_ignore_reports": Setting("igoff", V.parse_flag, True),
    "video": Setting("video", V.parse_flag, True),
    "scrape": Setting("scrape", V.parse_flag, True),
    "concurrency": Setting("concurrency", V.parse_concurrency, 2),
    "delay_min": Setting("delay", lambda text: V.parse_delay(text).getField("delay_min"), 0),
    "delay_max": Setting("delay", lambda text: V.parse_delay(text).getField("delay_max"), 0),
}


def _log_order(controls: DataFrame, order: str) -> Column:
    return F.col(order) if order in controls.columns else F.col("value")


def _read(controls: DataFrame, names: list[str]) -> DataFrame:
    """The log with a typed column per setting, null where a line does not set it or is refused."""
    return with_pinned(controls, **{f"_v_{n}": F.when(F.col("name") == SETTINGS[n].control, SETTINGS[n].read(F.col("value"))) for n in names})


def typed_changes(controls: DataFrame, names: list[str], order: str = "seq") -> DataFrame:
    """(job, _at, one column per setting): the good values set at each instant, in microseconds."""
    last = _log_order(controls, order)
    good = [F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(last.alias("order"), F.col(f"_v_{n}").alias("value")))).getField("value").alias(n) for n in names]
    at = micros(F.col("effective_ts")).alias("_at")
    some = reduce(or_, [F.col(f"_v_{n}").isNotNull() for n in names])
    return _read(controls, names).where(F.col("effective_ts").isNotNull() & some).groupBy("job", at).agg(*good)


def _or_default(names: list[str]) -> dict[str, Column]:
    return {n: F.coalesce(F.col(n), F.lit(SETTINGS[n].default)) for n in names}


def settings_asof(events: DataFrame, controls: DataFrame, names: list[str], ts: str = "ts", order: str = "seq") -> DataFrame:
    """Add one typed column per setting with the value in force at the event."""
    # The log is read and parsed once, whatever is asked of it then.
    changes = written_table(typed_changes(controls, names, order), "changes")
    found = as_of(events, changes, ["job"], names, micros(F.col(ts)))
    return found.withColumns(_or_default(names))


def current_settings(controls: DataFrame, names: list[str], order: str = "seq") -> DataFrame:
    """(job, one column per setting): what holds at the end of the log, a row per job in it."""
    when = F.struct("effective_ts", _log_order(controls, order).alias("order"))
    last = [F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), when)).alias(n) for n in names]
    return _read(controls, names).groupBy("job").agg(*last).withColumns(_or_default(names))


def changed_controls(controls: DataFrame, version: str = "value", order: str = "effective_ts") -> DataFrame:
    """Add `changed`: the version differs from the one seen before; the first sight counts.

    `order` is a timestamp or whole number, unique per (job, name).
    """
    numbered = controls.withColumn("_at", F.col(order) if order != "effective_ts" else micros(F.col(order)))
    seen = {"_seen": ("max", F.struct(F.col("_at").alias("at"), F.col(version).alias("version")))}
    line = running(numbered, ["job", "name"], "_at", seen, inclusive=False)
    changed = F.col("_seen").isNull() | ~F.col("_seen.version").eqNullSafe(F.col(version))
    return line.withColumn("changed", changed).drop("_seen", "_at")


def scrape_gate(events: DataFrame, controls: DataFrame, ts: str = "ts") -> DataFrame:
    """Add `scrape_off`: once link extraction was switched off it stays off."""
    off = (
        controls.where((F.col("name") == "scrape") & (F.col("value") == "off"))
        .groupBy("job")
        .agg(F.min(F.col("effective_ts").cast("timestamp")).alias("_off"))
    )
    gated = events.join(broadcast_if_small(off), "job", "left")
    is_off = F.coalesce(F.col(ts).cast("timestamp") >= F.col("_off"), F.lit(False))
    return gated.withColumn("scrape_off", is_off).drop("_off")


def stop_gate(results: DataFrame, controls: DataFrame, ts: str = "ts", order: str = "seq") -> DataFrame:
    """Results up to and including the first one that notices a stop request."""
    stops = (
        controls.where((F.col("name") == "stop") & (F.col("value") == "on"))
        .groupBy("job")
        .agg(F.min(F.col("effective_ts").cast("timestamp")).alias("_stop"))
    )
    timed = results.join(broadcast_if_small(stops), "job", "left")
    past = F.col(ts).cast("timestamp") >= F.col("_stop")
    last = lookup_side(timed.where(past).groupBy("job").agg(F.min(order).alias("_last")))
    kept = timed.join(last, "job", "left").where(F.col("_last").isNull() | (F.col(order) <= F.col("_last")))
    return kept.drop("_stop", "_last")
