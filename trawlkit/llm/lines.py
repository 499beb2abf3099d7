"""Line dedup by distinct-site spread.

A line that occurs on many sites is boilerplate. A HyperLogLog sketch of the sites is kept per
line; sketches merge in the aggregation, so a line of any frequency costs one small sketch per
task before the shuffle. Lines whose estimate lies near the threshold are counted exactly.
Native expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.common import MARK, rebuilt, with_outputs
from trawlkit.session import written_table

# Sites a line must be seen on before it counts as boilerplate.
MIN_SITES = 10
# log2 of the sketch's registers: relative error about 1.6 %.
LG_REGISTERS = 12

TEXT, LINE, SITE, GONE = f"{MARK}text", f"{MARK}line", f"{MARK}site", f"{MARK}gone"


def line_hash(line: Column) -> Column:
    """Lines are compared without spaces, tabs and carriage returns around them; blank: null."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.xxhash64(bare))


def near_band(min_sites: int, lg_registers: int = LG_REGISTERS) -> int:
    """How far an estimate may be from the threshold before it is trusted: four standard errors."""
    return max(1, math.ceil(4 * 1.04 / math.sqrt(2**lg_registers) * min_sites))


def site_lines(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """One row per text hash, distinct line of that text and site, without the texts."""
    body = F.col(f"`{text}`")
    return docs.select(
        F.xxhash64(body).alias(TEXT),
        F.col(f"`{site}`").cast("string").alias(SITE),
        F.explode(F.array_distinct(F.transform(F.split(body, "\n"), line_hash))).alias(LINE),
    ).where(F.col(LINE).isNotNull())


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """Hashes of the lines seen on at least min_sites distinct sites; a null site counts as none."""
    band = near_band(min_sites, lg_registers)
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg(SITE, F.lit(lg_registers)))
    seen = lines.where(F.col(SITE).isNotNull())
    spread = written_table(
        seen.groupBy(LINE).agg(estimate.alias("sites")).where(F.col("sites") >= min_sites - band), "line-spread"
    )
    sure = spread.where(F.col("sites") > min_sites + band).select(LINE)
    near = spread.where(F.col("sites") <= min_sites + band).select(LINE)
    exact = (
        seen.join(near, LINE, "left_semi")
        .groupBy(LINE)
        .agg(F.countDistinct(SITE).alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select(LINE)
    )
    return sure.unionByName(exact)


def drop_spread_lines(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS
) -> DataFrame:
    """Remove boilerplate lines; adds n_lines and n_removed and keeps every row.

    A text all of whose non-blank lines are boilerplate stays as it is: it is a copied document,
    which is the business of document dedup, and nothing of it would be left. A null text stays
    null with 0 lines; an empty text is one blank line. Blank lines are never removed. Rows with
    one text get one result, whatever their ids. Own columns named n_lines or n_removed give way.
    """
    lines = written_table(site_lines(docs, text, site).select(TEXT, SITE, LINE), "site-lines")
    spread = written_table(spread_lines(lines, min_sites, lg_registers), "spread-lines")
    # Which lines go depends on the text alone, so copies of a text share one list. The lists are
    # written, so that the join has a plain shuffle on either side and AQE can split a hot text; it is
    # a merge join at every size, because the lists grow with the corpus.
    gone = written_table(lines.join(spread, LINE).groupBy(TEXT).agg(F.collect_set(LINE).alias(GONE)), "gone-lines")
    body = F.col(f"`{text}`")
    parts = F.split(body, "\n")
    stays = lambda part: ~F.coalesce(F.array_contains(F.col(GONE), line_hash(part)), F.lit(False))
    left = F.filter(parts, stays)
    bare = ~F.exists(left, lambda part: line_hash(part).isNotNull())
    kept = F.when(F.col(GONE).isNull() | bare, parts).otherwise(left)
    joined = (
        docs.withColumn(TEXT, F.xxhash64(body))
        .join(gone.hint("merge"), TEXT, "left")
        .withColumn(f"{MARK}parts", F.when(body.isNotNull(), kept))
        .withColumn(f"{MARK}all", F.coalesce(F.size(parts), F.lit(0)).cast("long"))
    )
    n_kept = F.coalesce(F.size(f"{MARK}parts"), F.lit(0)).cast("long")
    out = with_outputs(
        joined.withColumn(text, F.array_join(f"{MARK}parts", "\n")),
        {"n_lines": F.col(f"{MARK}all"), "n_removed": F.col(f"{MARK}all") - n_kept},
    )
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return rebuilt(out, [*own, "n_lines", "n_removed"])
