"""A store of digests seen so far, for runs and streams that come back to it.

Rows (scope, digest, first_url, first_seq) lie in folders by batch and, within, by a hash of the
digest. Beside each batch lie bitmaps of its digests. A lookup asks the bitmaps first and then
reads only the partitions of digests that may be known, so a batch of new pages reads next to no
rows. Compaction merges old batches into one folder and says so in a manifest that is written last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlkit.session import scratch_path, written_table

BATCH, PART = "batch_id", "part"
ROWS = "scope string, digest string, first_url string, first_seq bigint"
MAPS = "word bigint, bits bigint"
# For a store of many millions: partitions of the digests, and bits of a partition's bitmap. 2^24 in
# each of 32 give 16 bits to each of 33 million digests. Only words that are set are stored; a
# fuller map lets more through, which the rows then settle. Both are fixed when a store is made.
PARTS, MAP_BITS = 32, 24


@dataclass(frozen=True)
class DigestIndex:
    path: str
    parts: int = PARTS
    map_bits: int = MAP_BITS

    # Folders ----------------------------------------------------------------------------------

    def _system(self, spark: SparkSession):
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, spark: SparkSession, name: str):
        return spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, spark: SparkSession, name: str) -> list[str]:
        system, path = self._system(spark), self._path(spark, name)
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def _merged(self, spark: SparkSession) -> tuple[str | None, int]:
        """Folder of the last compaction and the last batch it holds."""
        made = self._names(spark, "manifest")
        if not made:
            return None, -1
        upto, folder = made[-1].split("-", 1)
        return folder, int(upto)

    def _folders(self, spark: SparkSession, before: int) -> list[str]:
        """Folders that together hold each batch before the given one once."""
        merged, upto = self._merged(spark)
        if before <= upto:
            raise ValueError(f"batch {before} comes before the compaction up to batch {upto}")
        batches = [n for n in self._names(spark, "batches") if upto < int(n.split("=")[1]) < before]
        return ([f"merged/{merged}"] if merged else []) + [f"batches/{n}" for n in batches]

    def _read(self, spark: SparkSession, kind: str, schema: str, before: int, parts: list[int] | None) -> DataFrame:
        found = spark.createDataFrame([], f"{schema}, {PART} int")
        for folder in self._folders(spark, before):
            path = f"{self.path}/{folder}/{kind}"
            if self._system(spark).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
                one = spark.read.schema(f"{schema}, {PART} int").parquet(path)
                found = found.unionByName(one if parts is None else one.where(F.col(PART).isin(parts)))
        return found

    # Lookup -----------------------------------------------------------------------------------

    def _spots(self, rows: DataFrame) -> DataFrame:
        spot = F.pmod(F.xxhash64("scope", "digest"), F.lit(1 << self.map_bits))
        part = F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(self.parts)).cast("int")
        return rows.withColumns({PART: part, "word": F.shiftright(spot, 6), "bit": F.pmod(spot, F.lit(64)).cast("int")})

    def possible(self, digests: DataFrame, before: int) -> DataFrame:
        """Distinct (scope, digest, part) that the bitmaps do not rule out."""
        spark = digests.sparkSession
        asked = self._spots(digests.where(F.col("digest").isNotNull()).select("scope", "digest").distinct())
        maps = self._read(spark, "maps", MAPS, before, None).groupBy(PART, "word").agg(F.bit_or("bits").alias("bits"))
        hit = F.expr("(shiftrightunsigned(bits, bit) & 1) = 1")
        return asked.join(maps, [PART, "word"]).where(hit).select("scope", "digest", PART)

    def known(self, digests: DataFrame, before: int) -> DataFrame:
        """(scope, digest, first_url) of those digests(scope, digest) that batches before hold.

        A null scope is a scope. Only partitions with a possible hit are read.
        """
        spark = digests.sparkSession
        asked = written_table(self.possible(digests, before), "asked")
        # At most as many numbers as there are partitions.
        parts = [r[0] for r in asked.select(PART).distinct().collect()]
        stored = self._read(spark, "rows", ROWS, before, parts)
        first = stored.alias("s").join(asked.alias("a"), (F.col(f"s.{PART}") == F.col(f"a.{PART}")) & (F.col("s.digest") == F.col("a.digest")) & F.col("s.scope").eqNullSafe(F.col("a.scope")), "left_semi")
        earliest = F.min(F.struct("first_seq", "first_url")).getField("first_url").alias("first_url")
        return first.groupBy("scope", "digest").agg(earliest)

    # Writing ----------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, folder: str) -> None:
        placed = self._spots(rows.select("scope", "digest", "first_url", F.col("first_seq").cast("long").alias("first_seq")))
        # One task per partition: a partition is one file however many tasks made its rows.
        dealt = placed.repartition(F.col(PART))
        dealt.drop("word", "bit").sortWithinPartitions(PART, "digest").write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/{folder}/rows")
        stored = rows.sparkSession.read.schema(f"{ROWS}, {PART} int").parquet(f"{self.path}/{folder}/rows")
        bits = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
        maps = self._spots(stored).groupBy(PART, "word").agg(bits)
        maps.repartition(F.col(PART)).write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/{folder}/maps")

    def add(self, firsts: DataFrame, batch: int) -> None:
        """Store a batch's new digests (scope, digest, first_url, first_seq); a replay overwrites them."""
        self._write(firsts.where(F.col("digest").isNotNull()), f"batches/{BATCH}={batch:012d}")

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Merge all batches up to one that will not be replayed.

        The manifest names the new folder last: a compaction that was cut short changes nothing.
        What a compaction replaces stays until the next one, for readers that still hold it.
        """
        merged, done = self._merged(spark)
        if upto <= done:
            return
        rows = self._read(spark, "rows", ROWS, upto + 1, None)
        first = F.min(F.struct("first_seq", "first_url")).alias("first")
        single = rows.groupBy("scope", "digest").agg(first).select("scope", "digest", "first.first_url", "first.first_seq")
        folder = scratch_path(spark, "merged").rsplit("/", 1)[1]
        self._write(single, f"merged/{folder}")
        system = self._system(spark)
        system.mkdirs(self._path(spark, f"manifest/{upto:012d}-{folder}"))
        for name in self._names(spark, "merged"):
            if name not in (folder, merged):
                system.delete(self._path(spark, f"merged/{name}"), True)
        for name in self._names(spark, "batches"):
            if int(name.split("=")[1]) <= done:
                system.delete(self._path(spark, f"batches/{name}"), True)
