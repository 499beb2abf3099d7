"""The set of URLs a crawl reaches, breadth first over a link table.

Links and reached URLs lie in the shared checkpoint folder, bucketed by the keys they are joined
on. A round moves only the targets its newest URLs lead to, reduced to one row each: neither the links
nor what was reached before is shuffled again. Sources with very many links are split over
several join keys; only then the newest URLs move too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import urls
from trawlkit.session import BucketedTable, broadcast_if_small, written_table

# Default depths.
REQUISITES_LEVEL = 5
OFFSITE_LEVEL = 1

PAGE, LEAF, REQUISITE = 0, 1, 2
KINDS = ["page", "leaf", "requisite"]

LINKS_PER_KEY = 1_000_000


def folder_of(url: Column) -> Column:
    """URL up to and including the last slash of its path."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(base.rlike("^[^:/]+://[^/]+$"), F.concat(base, F.lit("/"))).otherwise(F.regexp_extract(base, "^(.*/)", 1))


def _site(url: Column) -> Column:
    return F.concat_ws("://", urls.url_scheme(url), urls.url_netloc(url))


def in_scope(dst: Column, root: Column, local: Column, inline: Column, no_parent: bool = True, offsite: bool = True) -> Column:
    """May a link be followed: requisites always, pages of start hosts under the seed's folder,
    pages elsewhere only if off-site links are on."""
    under = F.lit(True)
    if no_parent:
        under = (_site(dst) != _site(root)) | dst.startswith(folder_of(root))
    return inline | (local & under) | (~local & F.lit(offsite))


def _as_reach(places: DataFrame) -> DataFrame:
    """(job, url, reach, root) of places(job, url, level, depth, kind, root)."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    return places.select("job", "url", F.struct(kind.alias("kind"), F.col("level").cast("int").alias("level"), F.col("depth").cast("int").alias("depth")).alias("reach"), "root")


def _as_places(reached: DataFrame) -> DataFrame:
    """The way back."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return reached.select("job", "url", "reach.level", "reach.depth", F.element_at(kinds, F.col("reach.kind") + 1).alias("kind"), "root")


def _heavy_sources(links: DataFrame, per_key: int) -> DataFrame:
    """Sources with more links than one key may have, and into how many parts they are split."""
    counted = links.groupBy("job", "src").count().where(F.col("count") > per_key)
    return written_table(counted.select("job", "src", F.ceil(F.col("count") / per_key).cast("int").alias("parts")), "heavy")


def _newest(
    sources: DataFrame,
    links: DataFrame,
    keys: list[str],
    reached: DataFrame,
    max_level: int | None,
    requisites_level: int,
    offsite: bool,
    no_parent: bool,
) -> DataFrame:
    """What links(job, src, dst, inline, local) of the sources add to reached(job, url, reach, root)."""
    kind, level, depth = (F.col(f"reach.{c}") for c in ("kind", "level", "depth"))
    inline, local, dst = F.col("inline"), F.col("local"), F.col("dst")
    deeper = F.lit(True) if max_level is None else level + 1 <= max_level
    allowed = F.when(inline, depth + 1 <= requisites_level).otherwise((kind == PAGE) & deeper)
    reach = F.struct(
        F.when(inline, F.lit(REQUISITE)).when(local, F.lit(PAGE)).otherwise(F.lit(LEAF)).alias("kind"),
        F.when(inline, level).otherwise(level + 1).alias("level"),
        F.when(inline, depth + 1).otherwise(F.lit(0)).alias("depth"),
    )
    found = (
        sources.join(links, keys)
        .where(allowed & in_scope(dst, F.col("root"), local, inline, no_parent, offsite))
        .groupBy("job", dst.alias("url"))
        .agg(F.min(F.struct(reach.alias("reach"), "root")).alias("best"))
        .select("job", "url", "best.reach", "best.root")
    )
    return found.join(reached.select("job", "url"), ["job", "url"], "left_anti")


def expand_frontier(
    seeds: DataFrame,
    links: DataFrame,
    max_level: int | None = None,
    requisites_level: int = REQUISITES_LEVEL,
    offsite: bool = True,
    no_parent: bool = True,
    links_per_key: int = LINKS_PER_KEY,
    buckets: int | None = None,
) -> DataFrame:
    """Reached URLs of seeds(job, url) over links(job, src, dst, inline).

    Result: (job, url, level, depth, kind, root). `level` counts page links, `depth` the
    requisite links since the last page. A `page` is expanded in full; a `leaf` (page on another
    host) and a `requisite` only for their own requisites. A URL belongs to the round that first
    reaches it; within a round the better kind, then the lower level, then the lower depth wins.
    `max_level=0` takes the seeds and their requisites only. `buckets` of the stored links and
    URLs default to the session's shuffle partitions, which they should equal.
    """
    spark, url = links.sparkSession, F.col("url")
    hosts = seeds.select("job", urls.url_host(url).alias("host")).distinct().withColumn("local", F.lit(True))
    known = links.select("job", "src", "dst", F.coalesce(F.col("inline"), F.lit(False)).alias("inline"))
    known = known.withColumn("host", urls.url_host(F.col("dst"))).join(broadcast_if_small(hosts), ["job", "host"], "left")
    known = known.select("job", "src", "dst", "inline", F.coalesce("local", F.lit(False)).alias("local"))
    heavy = _heavy_sources(links, links_per_key)
    has_heavy, keys = not heavy.isEmpty(), ["job", "src"]
    if has_heavy:
        # A constant part would drop out of the join, and the links' buckets with it.
        parts = F.coalesce(F.col("parts"), F.lit(1))
        known = known.join(broadcast_if_small(heavy), keys, "left")
        known = known.withColumn("part", F.pmod(F.xxhash64("dst"), parts).cast("int")).drop("parts")
        keys = [*keys, "part"]
    graph = BucketedTable(spark, "links", keys, buckets)
    graph.add(known.repartition(graph.buckets, *keys))

    start = F.struct(F.lit(PAGE).alias("kind"), F.lit(0).alias("level"), F.lit(0).alias("depth"))
    reached = BucketedTable(spark, "reached", ["job", "url"], buckets)
    reached.add(seeds.select("job", "url").distinct().select("job", "url", start.alias("reach"), url.alias("root")))
    number = 0
    while not reached.rows(number).isEmpty():
        sources = reached.rows(number).select("job", url.alias("src"), "reach", "root")
        if has_heavy:
            sources = sources.join(broadcast_if_small(heavy), ["job", "src"], "left")
            last_part = F.coalesce(F.col("parts"), F.lit(1)) - 1
            sources = sources.withColumn("part", F.explode(F.sequence(F.lit(0), last_part))).drop("parts")
        number += 1
        reached.add(
            _newest(sources, graph.rows(), keys, reached.rows(), max_level, requisites_level, offsite, no_parent), number
        )
    graph.close()
    return _as_places(reached.close())


def next_places(
    sources: DataFrame,
    links: DataFrame,
    queue: DataFrame,
    max_level: int | None = None,
    requisites_level: int = REQUISITES_LEVEL,
    offsite: bool = True,
    no_parent: bool = True,
) -> DataFrame:
    """Places (job, url, level, depth, kind, root) that links(job, src, dst, inline, local) of the sources add to a queue.

    Sources and queue have the same columns; the rules are those of `expand_frontier`.
    """
    start = _as_reach(sources).withColumnRenamed("url", "src")
    return _as_places(_newest(start, links, ["job", "src"], _as_reach(queue), max_level, requisites_level, offsite, no_parent))


def new_urls(candidates: DataFrame, queued: DataFrame) -> DataFrame:
    """Distinct candidate (job, url) not queued yet."""
    return candidates.select("job", "url").distinct().join(queued.select("job", "url"), ["job", "url"], "left_anti")
