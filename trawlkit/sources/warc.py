"""Archive files: records packed into .warc.gz, an index with offsets, and records read back through it.

Use `write_archive`. Each record becomes a gzip member where it lies, its length is known before any
file is opened, and offsets are running sums of lengths. The writer only puts packed bytes in order.
What it wrote counts once its manifest exists; the files named there get their names in parallel tasks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from trawlkit.operators import archive
from trawlkit.session import lookup_side, written_table

SOFTWARE = "trawlkit"
KEYS = ["job", "shard", "seq"]
# Columns of the records; all from `file_no` on may be missing.
TYPES = {
    "job": "string", "shard": "int", "seq": "bigint", "url": "string", "ts": "timestamp", "body": "binary", "file_no": "bigint",
    "head": "string", "mime": "string", "status": "int", "is_repeat": "boolean", "refers_url": "string", "refers_ts": "timestamp",
}
CARRIED = ["job", "shard", "seq", "file_no", "url", "ts", "mime", "status"]
# Bytes a batch gathers before it is handed on.
PORTION = 8 << 20
_LINE_ENDS = re.compile(r"[\r\n]+")
# Fixed value: what a record that repeats another's payload declares.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def file_name(job: str, shard: int, file_no: int) -> str:
    return f"{job}-{shard:05d}-{file_no:05d}.warc.gz"


def http_head(version: Column, status: Column, reason: Column, headers: Column) -> Column:
    """Status line, header lines and an empty line; null if version or status is. Line ends in values become blanks."""

    def flat(text: Column) -> Column:
        return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")

    named = F.filter(headers, lambda h: h["name"].isNotNull())
    shown = F.transform(named, lambda h: F.concat(flat(h["name"]), F.lit(": "), flat(h["value"]), F.lit("\r\n")))
    first = F.concat(version, F.lit(" "), status.cast("string"), F.lit(" "), flat(reason), F.lit("\r\n"))
    return F.concat(first, F.coalesce(F.array_join(shown, ""), F.lit("")), F.lit("\r\n"))


def digest_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def pack_record(kind: str, fields: dict[str, str | None], payload: bytes) -> bytes:
    """One record as its own gzip member. Fields without a value are left out, line ends in values become blanks."""
    named = {"WARC-Type": kind, **fields, "Content-Length": str(len(payload))}
    lines = [f"{name}: {_LINE_ENDS.sub(' ', value)}\r\n" for name, value in named.items() if value is not None]
    return gzip.compress(("WARC/1.0\r\n" + "".join(lines) + "\r\n").encode("utf-8") + payload + b"\r\n\r\n", mtime=0)


def _pack(row: dict) -> tuple[str, str, bytes]:
    """(kind, digest of the payload, packed record)"""
    body, head = row["body"] or b"", (row["head"] or "").encode("utf-8")
    kind = "revisit" if row["is_repeat"] else "response" if head else "resource"
    block = head if kind == "revisit" else head + body
    digest = digest_label(body)
    fields = {
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(str(row[k]) for k in KEYS))}>",
        "WARC-Target-URI": row["url"],
        "WARC-Date": row["stamp"],
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": digest_label(block),
        "Content-Type": "application/http;msgtype=response" if head else row["mime"] or "application/octet-stream",
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To-Target-URI": row["refers_url"], "WARC-Refers-To-Date": row["refers_stamp"]}
    return kind, digest, pack_record(kind, fields, block)


def _portions(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows given with their bytes."""
    held, size = [], 0
    for row, length in rows:
        held.append(row)
        size += length
        if size >= PORTION:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_MOMENT = pa.timestamp("us", "UTC")
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "timestamp": _MOMENT, "binary": pa.binary()}


def _types(columns: dict[str, str]) -> tuple[str, pa.Schema]:
    return ", ".join(f"{n} {t}" for n, t in columns.items()), pa.schema([(n, _ARROW[t]) for n, t in columns.items()])


_MADE = {**{n: TYPES[n] for n in CARRIED}, "kind": "string", "digest": "string", "length": "bigint", "packed": "binary"}


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                kind, digest, packed = _pack(row)
                yield {**{n: row[n] for n in CARRIED}, "kind": kind, "digest": digest, "length": len(packed), "packed": packed}, len(packed)

    return _portions(rows(), _types(_MADE)[1])


_INFO = {"job": "string", "shard": "int", "file_no": "bigint", "seq": "bigint", "file": "string", "info_length": "bigint", "packed": "binary"}


def _info_batches(software: str):
    """The record that opens a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body = f"software: {software}\r\nformat: WARC File Format 1.0\r\n".encode()

        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    name = file_name(row["job"], row["shard"], row["file_no"])
                    packed = pack_record("warcinfo", {"WARC-Filename": name, "Content-Type": "application/warc-fields"}, body)
                    yield {**row, "seq": None, "file": name, "info_length": len(packed), "packed": packed}, len(packed)

        yield from _portions(rows(), _types(_INFO)[1])

    return run


@dataclass
class FilesWritten(WriterCommitMessage):
    moves: list


class ArchiveWriter(DataSourceArrowWriter):
    """Appends packed records, which arrive in order, to the file they belong to."""

    def __init__(self, path: str, manifest: str):
        self.path, self.manifest = path, manifest

    def write(self, iterator) -> FilesWritten:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        attempt, name, out, moves = uuid.uuid4().hex, None, None, []
        try:
            for batch in iterator:
                files, packed = batch.column("file").to_pylist(), batch.column("packed")
                for wanted, data in zip(files, packed, strict=True):
                    if wanted != name:
                        if out is not None:
                            out.close()
                        name = wanted
                        part = f".{name}.{attempt}.open"
                        moves.append({"part": part, "name": name})
                        out = system.open_output_stream(posixpath.join(root, part), compression=None)
                    out.write(data.as_buffer())
        finally:
            if out is not None:
                out.close()
        return FilesWritten(moves)

    def commit(self, messages) -> None:
        """Write the manifest: a line per file of the attempts that count."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(posixpath.join(root, self.manifest), compression=None) as out:
            for message in messages:
                for move in message.moves if message else []:
                    out.write((json.dumps(move) + "\n").encode())

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for move in message.moves if message else []:
                system.delete_file(posixpath.join(root, move["part"]))


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warcfiles"

    def schema(self) -> str:
        return "file string, packed binary"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self.options["manifest"])


def publish(spark: SparkSession, path: str, manifest: str, final: str) -> int:
    """Give the files of a manifest their names in `final`; may be repeated after a failure. Returns their number."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        _, target = fs.FileSystem.from_uri(final)
        system.create_dir(target, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                source, wanted = posixpath.join(root, row["part"]), posixpath.join(target, row["name"])
                try:
                    system.move(source, wanted)
                except OSError:
                    # An earlier attempt has moved it, or the move failed.
                    missing = system.get_file_info(source).type == fs.FileType.NotFound
                    if not missing or system.get_file_info(wanted).type == fs.FileType.NotFound:
                        raise
            yield pa.RecordBatch.from_pydict({"moved": pa.array([batch.num_rows], pa.int64())})

    listed = spark.read.schema("part string, name string").json(posixpath.join(path, manifest))
    moved = listed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(move, "moved bigint")
    return moved.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]


def _stamp(ts: Column, otherwise: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(F.coalesce(ts, otherwise), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archive(records: DataFrame, path: str, final: str | None = None, software: str = SOFTWARE, limit: int = archive.FILE_LIMIT) -> DataFrame:
    """Write records(job, shard, seq, url, ts, body) to one file per (job, shard, file_no); return their index.

    Further columns count where they exist: `file_no` as the layout (else a file takes packed records up
    to `limit` bytes, which costs a shuffle of the packed bytes more), `head` (see `http_head`; a record without
    one is a resource of type `mime`; it ends with an empty line), `mime`, `status`, and those of `operators.archive.mark_repeats`.
    seq is unique in (job, shard); job, shard and seq are not null. A null ts is the time of this call, a
    null url leaves the record without a target, a null body is empty. Other columns are ignored.

    `path` and `final` are URIs of one file system that all executors reach. The index has the columns
    job, shard, seq, url, ts, mime, status, kind, digest, length, offset, file.
    """
    spark = records.sparkSession
    spark.dataSource.register(ArchiveSource)
    now = F.lit(spark.sql("SELECT current_timestamp()").first()[0])
    typed = records.select(*[(F.col(n) if n in records.columns else F.lit(None)).cast(t).alias(n) for n, t in TYPES.items()])
    typed = typed.withColumn("ts", F.coalesce("ts", now))
    stamped = typed.withColumns({"stamp": _stamp(F.col("ts"), now), "refers_stamp": _stamp(F.col("refers_ts"), now)}).drop("refers_ts")
    packed = written_table(stamped.mapInArrow(_pack_batches, _types(_MADE)[0]), "packed")

    facts = packed.drop("packed")
    planned = facts if "file_no" in records.columns else archive.plan_files(facts.drop("file_no"), ["job", "shard"], "seq", "length", limit)
    placed = written_table(archive.place_records(planned), "placed")
    opening = written_table(placed.select("job", "shard", "file_no").distinct().mapInArrow(_info_batches(software), _types(_INFO)[0]), "opening")
    files = lookup_side(opening.select("job", "shard", "file_no", "file", "info_length"))

    bodies = packed.select(*KEYS, "file_no", "packed")
    if "file_no" not in records.columns:
        bodies = bodies.drop("file_no").join(placed.select(*KEYS, "file_no"), KEYS)
    parts = bodies.join(files.drop("info_length"), ["job", "shard", "file_no"]).select("file", "seq", "packed")
    whole = parts.unionByName(opening.select("file", "seq", "packed"))
    manifest = f"manifest-{uuid.uuid4().hex}.json"
    # The opening record has no seq and comes first.
    ordered = whole.repartition("file").sortWithinPartitions("file", F.col("seq").asc_nulls_first()).select("file", "packed")
    ordered.write.format("warcfiles").mode("append").option("path", path).option("manifest", manifest).save()
    publish(spark, path, manifest, final or path)

    index = placed.join(files, ["job", "shard", "file_no"]).withColumn("offset", F.col("offset") + F.col("info_length"))
    return index.select(*KEYS, "url", "ts", "mime", "status", "kind", "digest", "length", "offset", "file")


_READ = {"file": "string", "offset": "bigint", "kind": "string", "url": "string", "date": "string", "digest": "string", "head": "string", "body": "binary"}


def parse_record(data: bytes) -> dict:
    """Kind, url, date, digest, HTTP head and body of an unpacked record. A revisit has no body."""
    fields, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in fields.decode("utf-8").split("\r\n")[1:])
    block, head = rest[: int(named["Content-Length"])], None
    if named.get("Content-Type", "").startswith("application/http"):
        line, _, block = block.partition(b"\r\n\r\n")
        head = (line + b"\r\n\r\n").decode("utf-8")
    body = None if named["WARC-Type"] == "revisit" else block
    return {"kind": named["WARC-Type"], "url": named.get("WARC-Target-URI"), "date": named.get("WARC-Date"), "digest": named.get("WARC-Payload-Digest"), "head": head, "body": body}


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(file, offset, kind, url, date, digest, head, body) of the records an index names by file, offset and length.

    Only their bytes are read, in order of place. `folder` is the URI the files lie under.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)

        def rows():
            name, source = None, None
            try:
                for batch in batches:
                    for row in batch.to_pylist():
                        if row["file"] != name:
                            if source is not None:
                                source.close()
                            name, source = row["file"], system.open_input_file(posixpath.join(root, row["file"]))
                        data = gzip.decompress(source.read_at(row["length"], row["offset"]))
                        yield {"file": name, "offset": row["offset"], **parse_record(data)}, len(data)
            finally:
                if source is not None:
                    source.close()

        yield from _portions(rows(), _types(_READ)[1])

    wanted = index.select("file", "offset", F.col("length").cast("bigint").alias("length"))
    placed = wanted.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, _types(_READ)[0])
