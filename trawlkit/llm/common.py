"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Internal columns start with this; a table must not use such names itself.
MARK = "__llm_"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_outputs(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """The table's own columns plus outputs; an own column of an output's name gives way."""
    taken = {name.lower() for name in outputs}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(name) for name, c in outputs.items()])


def lookup(df: DataFrame, name: str) -> Column:
    """A column by name, whatever characters the name holds."""
    return df[f"`{name}`"] if "." in name else df[name]


def null_safe_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def text_key(column: Column) -> Column:
    """128 bits that stand for a text: two hashes of different make."""
    return F.concat(F.hex(F.xxhash64(column)), F.lit(":"), F.hex(F.xxhash64(F.lit(7919), column)))


def rebuilt(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def sampled(id: Column, classes: Column, sizes: dict, wanted: int) -> Column:
    """About `wanted` rows of each class, by a hash of the id: all of a class that has no more.

    63 bits of hash against a 63-bit bound, so that a class of any size keeps its chance.
    """
    bounds = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, chance_bound(n, wanted))])
    return F.shiftrightunsigned(F.xxhash64(id), 1) <= F.element_at(bounds, classes)


def chance_bound(n: int, wanted: int) -> int:
    return min((1 << 63) - 1, (wanted << 63) // max(n, 1) - 1)
