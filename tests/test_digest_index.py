"""The digest index: pruned reads, scopes, replays, compaction; and the stream on top of it."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from trawlkit.operators.digest_index import DigestIndex
from trawlkit.streaming import flows

FIRSTS = "scope string, digest string, first_url string, first_seq long"


def md5(x):
    return hashlib.md5(str(x).encode()).hexdigest()


def firsts(spark, rows):
    return spark.createDataFrame([(s, md5(x), u, q) for s, x, u, q in rows], FIRSTS)


def known(spark, index, asked, before):
    frame = spark.createDataFrame([(s, md5(x)) for s, x in asked], "scope string, digest string")
    return {(r.scope, r.digest): r.first_url for r in index.known(frame, before).collect()}


def scanned(plan):
    return [line for line in plan.splitlines() if "FileScan" in line and "first_url" in line]


def test_known_digests_by_scope_and_batch(spark, tmp_path):
    index = DigestIndex(str(tmp_path / "i"))
    assert known(spark, index, [("a", 1)], 0) == {}
    index.add(firsts(spark, [("a", 1, "u1", 5), ("b", 2, "u2", 6), (None, 3, "u3", 7)]), 0)
    index.add(firsts(spark, [("b", 1, "v1", 8), ("a", 4, None, 9)]), 1)
    asked = [("a", 1), ("b", 1), ("b", 2), ("a", 2), (None, 3), ("a", 3), ("a", 4)]
    assert known(spark, index, asked, 1) == {("a", md5(1)): "u1", ("b", md5(2)): "u2", (None, md5(3)): "u3"}
    # A digest known under a null URL is known.
    assert known(spark, index, asked, 2) == {("a", md5(1)): "u1", ("b", md5(1)): "v1", ("b", md5(2)): "u2", (None, md5(3)): "u3", ("a", md5(4)): None}


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    index = DigestIndex(str(tmp_path / "i"))
    index.add(firsts(spark, [("a", 1, "half", 1)]), 0)
    index.add(firsts(spark, [("a", 2, "whole", 1), ("a", 3, "whole", 2)]), 0)
    assert known(spark, index, [("a", 1), ("a", 2), ("a", 3)], 1) == {("a", md5(2)): "whole", ("a", md5(3)): "whole"}


def test_a_lookup_reads_only_partitions_with_possible_hits(spark, tmp_path):
    index = DigestIndex(str(tmp_path / "i"))
    index.add(firsts(spark, [("a", k, f"u{k}", k) for k in range(2000)]), 0)
    one = spark.createDataFrame([("a", md5(7)), ("a", md5("new"))], "scope string, digest string")
    found = index.known(one, 1)
    part = index._spots(one.where(F.col("digest") == md5(7))).first().part
    lines = scanned(found._jdf.queryExecution().executedPlan().toString())
    assert lines and all(re.search(rf"PartitionFilters: \[[^\]]*part#\d+ = {part}\)", line) for line in lines)
    assert [r.first_url for r in found.collect()] == ["u7"]
    # Nothing possible, nothing read.
    fresh = spark.createDataFrame([("a", md5(f"fresh{k}")) for k in range(50)], "scope string, digest string")
    assert index.possible(fresh, 1).count() <= 1
    # A saturated bitmap lets digests through, and the rows settle them.
    full = DigestIndex(str(tmp_path / "full"), map_bits=6)
    full.add(firsts(spark, [("a", k, f"u{k}", k) for k in range(20000)]), 0)
    assert full.possible(fresh, 1).count() > 25
    assert full.known(fresh, 1).count() == 0


@pytest.mark.parametrize("cut_short", [False, True])
def test_compaction_keeps_every_digest(spark, tmp_path, monkeypatch, cut_short):
    index = DigestIndex(str(tmp_path / "i"))
    rng = random.Random(1)
    asked = [(s, k) for s in ("a", "b") for k in range(60)]
    for batch in range(4):
        index.add(firsts(spark, [(rng.choice("ab"), rng.randrange(60), f"u{batch}", batch * 100 + i) for i in range(25)]), batch)
    before = known(spark, index, asked, 4)
    if cut_short:
        path = DigestIndex._path
        with monkeypatch.context() as m:
            m.setattr(DigestIndex, "_path", lambda *a: 1 / 0 if a[2].startswith("manifest/") else path(*a))
            with pytest.raises(ZeroDivisionError):
                index.compact(spark, 2)
        assert known(spark, index, asked, 4) == before
    index.compact(spark, 2)
    assert len(index._folders(spark, 4)) == 2
    assert known(spark, index, asked, 4) == before
    index.compact(spark, 2)  # already done
    index.add(firsts(spark, [("a", "late", "l", 999)]), 4)
    index.compact(spark, 4)
    assert len(index._folders(spark, 9)) == 1 and len(index._names(spark, "merged")) <= 3
    assert known(spark, index, [*asked, ("a", "late")], 9) == {**before, ("a", md5("late")): "l"}
    with pytest.raises(ValueError):
        index.known(firsts(spark, [("a", 1, "u", 1)]), 3)


def test_stream_with_scope_restarts_and_compaction(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), i, f"http://h/{i % 9}", f"body {rng.randrange(12)}".encode()) for i in range(60)]
    schema = "job string, seq bigint, url string, body binary"
    for n in range(6):  # a start per batch
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = flows.table_stream(spark, str(tmp_path / "in"), schema)
        flows.stream_dupes(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "ck"), "job", compact_every=2).awaitTermination()
    got = {r.seq: r.dupe_of for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    seen, want = {}, {}
    for job, seq, url, body in rows:
        want[seq] = seen.get((job, body))
        seen.setdefault((job, body), url)
    assert got == want
    assert len(DigestIndex(str(tmp_path / "store"))._folders(spark, 99)) <= 3


def test_same_page_in_two_crawls_is_no_duplicate(spark, tmp_path):
    spark.createDataFrame([("x", 1, "http://h/", b"same"), ("y", 2, "http://h/", b"same")], "job string, seq bigint, url string, body binary").write.parquet(str(tmp_path / "in"))
    for scope, dupes in (("job", 0), (None, 1)):
        stream = flows.table_stream(spark, str(tmp_path / "in"), "job string, seq bigint, url string, body binary")
        base = tmp_path / str(scope)
        flows.stream_dupes(stream, str(base / "store"), str(base / "out"), str(base / "ck"), scope).awaitTermination()
        assert spark.read.parquet(str(base / "out")).where(F.col("dupe_of").isNotNull()).count() == dupes
