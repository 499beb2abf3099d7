"""Archive files: records, layout by packed bytes, references, offsets, reading back."""

import base64
import datetime
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from trawlkit.operators import archive
from trawlkit.sources import warc

COLUMNS = "job string, shard int, seq bigint, url string, ts timestamp, body binary, head string, mime string, status int, note string"
WHEN = datetime.datetime(2024, 5, 6, 7, 8, 9)
HEAD = "HTTP/1.1 404 Not Found\r\nA: b\r\n\r\n"


def label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def records(spark):
    body = [bytearray(str(i).encode() * 300) for i in range(40)]
    rows = [("j", i % 2, i, f"http://h/{i}", WHEN, body[i % 30], HEAD if i % 3 else None, None if i % 3 else "text/css", 404, "x") for i in range(40)]
    rows += [
        ("j", 0, 100, None, None, None, None, None, None, None),
        ("j", 0, 102, "http://h/a\r\nWARC-Type: x", WHEN, bytearray(b"\r\n\r\nWARC/1.0\r\n"), HEAD, None, 404, None),
        ("k", 7, 0, "http://h/é", WHEN, bytearray(b"z" * 3_000_000), HEAD, None, 404, None),
        ("k", 7, 1, "http://h/0", WHEN, body[0], None, None, None, None),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archive")
    marked = archive.mark_repeats(records(spark))
    index = warc.write_archive(marked, f"file://{folder}/open", f"file://{folder}/done", "soft/1", limit=2_000)
    return folder, index


def test_first_bodies_are_kept_and_later_ones_refer_to_them(spark):
    marked = {(r.job, r.seq): r for r in archive.mark_repeats(records(spark)).collect()}
    assert len(marked) == 44
    assert sorted(k for k, r in marked.items() if r.is_repeat) == [("j", i) for i in range(30, 40)]
    assert all(marked["j", i].refers_url == f"http://h/{i - 30}" and marked["j", i].refers_ts == WHEN for i in range(30, 40))


def test_offsets_open_every_record_and_files_hold_nothing_else(written):
    folder, index = written
    rows = index.collect()
    assert len(rows) == 44 and not [p for p in (folder / "open").iterdir() if p.name.endswith(".open")]
    by_file = {}
    for row in rows:
        by_file.setdefault(row.file, []).append(row)
    assert sorted(p.name for p in (folder / "done").iterdir() if p.name.endswith(".gz")) == sorted(by_file)
    assert len(by_file) > 4
    for name, held in by_file.items():
        data = (folder / "done" / name).read_bytes()
        held.sort(key=lambda r: r.seq)
        at = held[0].offset
        info = gzip.decompress(data[:at])
        assert info.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n") and f"WARC-Filename: {name}".encode() in info
        for row in held:
            assert row.offset == at
            assert gzip.decompress(data[at : at + row.length]).startswith(b"WARC/1.0\r\nWARC-Type: " + row.kind.encode())
            at += row.length
        assert at == len(data)
        # A record belongs to the file in which its first byte falls.
        assert sum(r.length for r in held[:-1]) < 2_000 + held[0].length


def test_records_read_back_are_those_written(spark, written):
    folder, index = written
    back = {(r.file, r.offset): r for r in warc.read_records(index, f"file://{folder}/done").collect()}
    given = {(r.job, r.shard, r.seq): r for r in archive.mark_repeats(records(spark)).collect()}
    assert len(back) == 44
    for row in index.collect():
        got, own = back[row.file, row.offset], given[row.job, row.shard, row.seq]
        body = bytes(own.body or b"")
        assert got.kind == row.kind == ("revisit" if own.is_repeat else "response" if own.head else "resource")
        assert got.body == (None if own.is_repeat else body) and got.head == own.head
        assert got.digest == row.digest == label(body)
        assert got.url == (own.url and own.url.replace("\r\n", " "))
        assert got.date == ("2024-05-06T07:08:09Z" if own.ts else row.ts.strftime("%Y-%m-%dT%H:%M:%SZ")) and row.ts.year >= 2024
    picked = warc.read_records(index.where("seq = 102"), f"file://{folder}/done").collect()
    assert [r.body for r in picked] == [b"\r\n\r\nWARC/1.0\r\n"]


def test_references_name_what_they_repeat(written):
    folder, index = written
    row = index.where("seq = 31").first()
    data = (folder / "done" / row.file).read_bytes()[row.offset : row.offset + row.length]
    text = gzip.decompress(data).decode()
    assert "WARC-Refers-To-Target-URI: http://h/1\r\n" in text and "WARC-Refers-To-Date: 2024-05-06T07:08:09Z\r\n" in text
    assert f"WARC-Block-Digest: {label(HEAD.encode())}\r\n" in text and text.endswith(HEAD + "\r\n\r\n")


def test_publishing_again_changes_nothing(spark, written):
    folder, index = written
    manifest = next(p.name for p in (folder / "open").iterdir() if p.name.startswith("manifest-"))
    before = sorted((p.name, p.stat().st_size) for p in (folder / "done").iterdir())
    assert warc.publish(spark, f"file://{folder}/open", manifest, f"file://{folder}/done") == index.select("file").distinct().count()
    assert sorted((p.name, p.stat().st_size) for p in (folder / "done").iterdir()) == before


def test_index_carries_offsets_in_key_order(written):
    found = archive.archive_index(written[1].where("url IS NOT NULL")).collect()
    assert [r.url_key for r in found] == sorted(r.url_key for r in found) and all(r.offset > 0 for r in found)


def test_no_records_make_no_files(spark, tmp_path):
    index = warc.write_archive(records(spark).limit(0), f"file://{tmp_path}/open")
    assert index.count() == 0 and warc.read_records(index, f"file://{tmp_path}/open").count() == 0
    assert not [p for p in (tmp_path / "open").iterdir() if p.name.endswith(".gz")]


def test_head_lines(spark):
    headers = F.array(F.struct(F.lit("A").alias("name"), F.lit("x\r\ny").alias("value")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("z").alias("value")))
    version, status, reason = F.lit("HTTP/1.0"), F.lit(200), F.lit(None).cast("string")
    row = spark.range(1).select(warc.http_head(version, status, reason, headers), warc.http_head(version, F.lit(None).cast("int"), reason, headers)).first()
    assert row[0] == "HTTP/1.0 200 \r\nA: x y\r\n\r\n" and row[1] is None
