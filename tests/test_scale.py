"""Plans that matter on large data: skew, pushdown, pruning, size-checked broadcasts."""

import pytest
from pyspark.sql import functions as F

from trawlkit import session
from trawlkit.operators import counters, dupes, frontier
from trawlkit.operators import url_rules as U
from trawlkit.operators.queue import dump_queue
from trawlkit.plans.fixtures import Crawl

LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def large(spark, monkeypatch):
    """Thresholds lowered until the test tables count as large."""
    before = {k: spark.conf.get(k, None) for k in LARGE}
    for k, v in LARGE.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(session, "small_enough", lambda df, rows=0: False)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_after_run(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_digest_is_split(large):
    rows = large.range(60000).select(
        F.col("id").alias("seq"),
        F.concat(F.lit("http://h/"), "id").alias("url"),
        F.md5(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") / 2).cast("bigint").cast("string"))).alias("digest"),
    )
    marked = dupes.mark_dupes(session.written_table(rows))
    plan = plan_after_run(marked)
    assert "SortMergeJoin(skew=true)" in plan and "Broadcast" not in plan
    assert marked.where("seq % 3 = 0 AND seq > 0 AND dupe_of = 'http://h/0'").count() == 19999


def test_hot_seed_host_is_split(large):
    table = large.range(60000).select(
        F.lit("j").alias("job"),
        "id",
        F.concat(F.lit("http://"), F.when(F.col("id") % 3 == 0, F.lit("hot.ex")).otherwise(F.concat(F.lit("h"), "id")), F.lit("/p?id="), "id").alias("url"),
        F.lit(True).alias("verdict"),
    )
    seeds = table.where("id % 2 = 0").select("job", F.concat(F.regexp_extract("url", "^(http://[^/]*/)", 1), F.lit("s")).alias("url"))
    rules = U.RuleSet([U.Rule("s", 1, "^https?://{any_start_netloc}/p")])
    done = U.verdict_url(session.written_table(table), session.written_table(seeds), rules)
    plan = plan_after_run(done)
    assert "SortMergeJoin(skew=true)" in plan and "Broadcast" not in plan
    # Start hosts are the hot one and those of even ids.
    assert done.where("reason = 'ignored'").count() == 20000 + 20000


def test_running_groups_are_cut_into_spans(spark):
    rows = spark.range(10).select(F.lit("one").alias("job"), (F.col("id") * 2**20).alias("seq"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("body_size"))
    plan = counters.running_counters(rows, ["job"], "seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in plan
    assert all("_span2" in line for line in plan.splitlines() if "_in_bytes_downloaded" in line and line.lstrip(" :+-").startswith("Window") and "_v_bytes" in line)


def test_queue_filter_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("url_string_id"), F.lit("done").alias("status"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "q"))
    spark.range(10).select("id", F.lit("u").alias("url"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "s"))
    done = dump_queue(spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "s")), "done")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,done)" in plan and "unused" not in plan


def test_verdicts_read_no_bodies(spark, data):
    t = Crawl(spark, data)
    done = U.verdict_url(t["candidates"], t["seeds"], U.load_rules(t["patterns"]))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_on_costly_columns_do_not_repeat_them(spark, data):
    t = Crawl(spark, data)
    matched = U.match_rules(t["candidates"], t["seeds"], U.load_rules(t["patterns"])).where("ignored")
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE (?d)/es/") + plan.count("RLIKE(") <= 1 or plan.count("(?d)/es/") == 1
    digests = dupes.page_digests(t["bodies_near"]).where("digest IS NOT NULL")
    assert digests._jdf.queryExecution().optimizedPlan().toString().count("NREUM.info") <= 4


def shuffled_sources(plan):
    """Per exchange of a plan, the folders of the scans it moves."""
    name = lambda node: node.getClass().getSimpleName()
    children = lambda node: [node.children().apply(i) for i in range(node.children().size())]
    found = []

    def walk(node, above):
        if name(node) == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan(), above)
        if name(node).endswith("QueryStageExec"):
            return walk(node.plan(), above)
        if name(node) == "ShuffleExchangeExec":
            above = [*above, []]
            found.append(above[-1])
        if name(node) == "FileSourceScanExec":
            for moved in above:
                moved.append(node.relation().location().rootPaths().apply(0).toString())
        for child in children(node):
            walk(child, above)

    walk(plan, [])
    return found


@pytest.mark.parametrize("parts", [1, 2])
def test_frontier_moves_neither_links_nor_reached(large, parts):
    keys = ["job", "src"] if parts == 1 else ["job", "src", "part"]
    links = session.BucketedTable(large, "links", keys)
    edges = [("j", f"u{i}", i % parts, f"u{(i * 7 + k) % 500}", False, True) for i in range(500) for k in range(3)]
    edges = large.createDataFrame(edges, "job string, src string, part int, dst string, inline boolean, local boolean")
    links.add(edges.select(*keys, "dst", "inline", "local"))
    reached = session.BucketedTable(large, "reached", ["job", "url"])
    schema = "job string, url string, reach struct<kind: int, level: int, depth: int>, root string"
    for number in range(2):
        rows = [("j", f"u{i}", (0, number, 0), "u0") for i in range(number * 100, number * 100 + 100)]
        reached.add(large.createDataFrame(rows, schema), number)
    sources = reached.rows(1).select("job", F.col("url").alias("src"), "reach", "root")
    if parts > 1:
        sources = sources.withColumn("part", F.explode(F.sequence(F.lit(0), F.length("root") - 1)))
    newest = frontier._newest(sources, links.rows(), keys, reached.rows(), None, 5, True, False)
    expected = {f"u{(i * 7 + k) % 500}" for i in range(100, 200) for k in range(3)} - {f"u{i}" for i in range(200)}
    assert {r.url for r in newest.collect()} == expected
    moves = shuffled_sources(newest._jdf.queryExecution().executedPlan())
    # Targets found go to what was reached; the newest URLs go to the links only where those are split.
    assert len(moves) == parts
    assert max(len(m) for m in moves) == 2
    for scans in moves:
        assert len(scans) == 2 or reached.path.rsplit("/")[-1] in scans[0]


def test_bucketed_table_leaves_no_name_behind(spark):
    table = session.BucketedTable(spark, "names", ["k"], 2)
    for number in range(3):
        table.add(spark.range(number * 5, number * 5 + 5).select(F.col("id").alias("k")), number)
    assert [r.k for r in table.rows(1).orderBy("k").collect()] == [5, 6, 7, 8, 9]
    assert table.rows().count() == 15
    assert sorted(r.k for r in table.close().collect()) == list(range(15))
    assert not spark.catalog.tableExists(table.table)
