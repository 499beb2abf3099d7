"""One round of a crawl over stored responses, composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import urls
from trawlkit.operators import dupes, frontier, links
from trawlkit.operators.responses import verdict_response
from trawlkit.operators.url_rules import RuleSet, verdict_url
from trawlkit.session import broadcast_if_small, lookup_side, written_table

JOB = ["job"]


@dataclass(frozen=True)
class Round:
    """Screened responses without bodies, duplicate marks, and the URLs to queue next."""

    screened: DataFrame
    marked: DataFrame
    queue: DataFrame


@dataclass(frozen=True)
class _Seen:
    """What a round makes of its responses; links are resolved and in queue form."""

    screened: DataFrame
    marked: DataFrame
    links: DataFrame


def _seen(responses: DataFrame, seeds: DataFrame, rules: RuleSet, limit: Column | int, video: Column | bool, find_dupes: bool) -> _Seen:
    keys = ["job", "seq"]
    # Rules see keys and URLs only; bodies meet the outcome, where they lie if it is small.
    offered = verdict_url(responses.select(*keys, "url").withColumn("verdict", F.lit(True)), seeds, rules)
    accepted = lookup_side(offered.where("accepted").select(*keys))
    screened = verdict_response(responses.join(accepted, keys, "left_semi"), limit, video)
    taken = screened.where("taken")
    html = dupes.is_html(F.col("body"), F.col("headers"))
    marked = dupes.detect_dupes(taken, find_dupes, html, scope=JOB)
    fresh = dupes.links_of_fresh_pages(links.extract_links(taken.where(html), scope=JOB), marked, "seq", JOB)
    return _Seen(screened.drop("body"), marked, links.queue_form(links.resolve_links(fresh)))


def crawl_round(
    responses: DataFrame,
    seeds: DataFrame,
    rules: RuleSet,
    limit: Column | int = -1,
    video: Column | bool = True,
    find_dupes: bool = True,
) -> Round:
    """Take responses(job, seq, url, version, headers, body) through a round; seq is unique within a job.

    Ignored URLs and refused responses give no links, and neither do duplicates. Links found are
    resolved, brought to queue form and put to the rules; what was fetched already is left out.
    Bodies stay where they are read: only digests and links are shuffled.
    """
    seen = _seen(responses, seeds, rules, limit, video, find_dupes)
    targets = seen.links.select("job", F.col("dst_url").alias("url"))
    new = frontier.new_urls(targets, responses).withColumn("verdict", F.lit(True))
    queue = verdict_url(new, seeds, rules).where("accepted").select("job", "url")
    return Round(seen.screened, seen.marked, queue)


def queue_round(
    responses: DataFrame,
    queue: DataFrame,
    seeds: DataFrame,
    rules: RuleSet,
    limit: Column | int = -1,
    video: Column | bool = True,
    find_dupes: bool = True,
    max_level: int | None = None,
    requisites_level: int = frontier.REQUISITES_LEVEL,
    offsite: bool = True,
    no_parent: bool = True,
) -> Round:
    """The same with a queue(job, url, status, level, depth, kind, root); its `queue` is the whole next one.

    A URL whose response was taken is done; one that the rules or its headers refuse is skipped; those without a
    response keep their status. Links of responses taken are followed by the rules of `frontier.expand_frontier`
    from the place their page has in the queue; a response to a URL that is not queued adds nothing. What is
    new is todo, or skipped where the rules refuse it. (job, url) is unique in the queue; of several responses
    to a URL one that was taken counts.
    """
    seen = _seen(responses, seeds, rules, limit, video, find_dupes)
    taken = seen.screened.where("taken").select("job", "url", F.lit(True).alias("_taken"))
    answered = responses.select("job", "url", F.lit(False).alias("_taken")).unionByName(taken)
    outcome = lookup_side(answered.groupBy("job", "url").agg(F.max("_taken").alias("_taken")))
    status = F.when(F.col("_taken"), "done").when(~F.col("_taken"), "skipped").otherwise(F.col("status"))
    old = queue.select("job", "url", "status", "level", "depth", "kind", "root").join(outcome, ["job", "url"], "left")
    old = written_table(old.withColumn("status", status), "queue")

    hosts = seeds.select("job", urls.url_host(F.col("url")).alias("host")).distinct().withColumn("local", F.lit(True))
    found = seen.links.select("job", F.col("url").alias("src"), F.col("dst_url").alias("dst"), "inline").distinct()
    found = found.withColumn("host", urls.url_host(F.col("dst"))).join(broadcast_if_small(hosts), ["job", "host"], "left")
    found = found.withColumn("local", F.coalesce("local", F.lit(False))).drop("host")
    places = frontier.next_places(old.where("_taken"), found, old, max_level, requisites_level, offsite, no_parent)
    put = verdict_url(written_table(places, "places").withColumn("verdict", F.lit(True)), seeds, rules)
    new = put.withColumn("status", F.when(F.col("accepted"), "todo").otherwise("skipped"))
    columns = ["job", "url", "status", "level", "depth", "kind", "root"]
    return Round(seen.screened, seen.marked, old.select(*columns).unionByName(new.select(*columns)))
