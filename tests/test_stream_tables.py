"""Stream queries over tables that are folders of files, against their DuckDB statements."""

import datetime

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from trawlkit.plans import catalog

NAMES = ["dupe_stream", "st_dupes", "st_ignores", "st_rule_versions"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of several files each; one file has a name of its own, not Spark's."""
    at = tmp_path_factory.mktemp("tables")
    paths = ["en/1?utm_source=a", "de/2", "", "es/3?id=1", "en/4#top", "de/5?ref=x"]
    pages = [(k, f"http://{'wm'[k % 2]}.example/{paths[k % 6]}", f"<p>page {k % 7}</p>") for k in range(24)]
    begin, kinds = datetime.datetime(2024, 1, 1), ["view", "click", "error", "purchase", "signup"]
    events = [(k, begin + datetime.timedelta(hours=k), k % 5, kinds[k % 5], k / 4, f'{{"k": {k}}}') for k in range(30)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    ).repartition(2).write.parquet(f"{at}/events.parquet")
    first = sorted((at / "pages.parquet").glob("part-*.parquet"))[0]
    (at / "pages.parquet" / "own.parquet").write_bytes(first.read_bytes())
    (at / "pages.parquet" / f".{first.name}.crc").unlink()
    first.unlink()
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_table_of_several_files(spark, folder, name):
    db = duckdb.connect()
    for table in ("pages", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    assert oracle.compare(spark, db, folder, catalog.queries()[name], catalog.oracle_sql()[name]) is None
    assert catalog.queries()[name](spark, folder).count() > 0
