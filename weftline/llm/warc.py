"""Deterministic sharded WARC 1.1 archives, written and read back.

Records are range-sorted by page id into shards whose bounds follow from the
rows alone, and a shard rolls to a new file when the compressed size passes a
limit.  Headers, record ids, dates and digests follow from the rows, too, so a
repeated task, and a repeated run, writes equal bytes.  Files are written under
temporary names and renamed, and the manifest, which lists every file with its
records, size and digest, is written last and completes a folder.  Reading holds
each file against the manifest and raises where anything differs.

Of the records with equal payloads the one with the largest page id is the
response, and the others are revisits of it.  That page is found by grouping on
the payload's digest alone (the bodies don't take part), and only payloads that
repeat are joined back.

A revisit keeps the HTTP header of its payload, from which its length is read.
Records are dated by ``date_col`` where a column is named, else all by the
constant ``Settings.date``: the rows know no other.

Defined cases: null html is an empty payload; a null url is written as an empty
target; a null page id sorts first, is written as ``null`` and read back as
null; of rows that repeat a page id and a payload all but one are revisits
of that id; a null date is ``Settings.date``; a very long page is one record, held
whole by one task; an empty table gives a manifest without files; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import save, work_dir
from weftline.llm.ranges import SHARD, range_sharded
from weftline.llm.tokenfile import _commit, _open

FILES = "name string, records long, compressed_bytes long, sha256 string"
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
    ]
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Settings:
    file_bytes: int = 64 << 20
    shard_pages: int = 4096
    level: int = 6
    date: str = "2020-01-01T00:00:00Z"
    least_payload: int = 0  # payloads shorter than this are never revisits
    software: str = "weftline"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    value = urn[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


def _clean(url: str | None) -> str:
    return "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, s: Settings) -> bytes:
    """One response or revisit record, its headers and digests made anew from the row."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
    ]
    if revisit:
        headers += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    return _record([*headers, ("Content-Type", "application/http; msgtype=response")], block)


class _File:
    """One archive file: a gzip member for each record."""

    def __init__(self, store: pafs.FileSystem, root: str, name: str, s: Settings):
        self.store, self.root, self.name, self.s = store, root, name, s
        self.temporary = f"{root}/.{uuid.uuid4().hex}"
        self.out = store.open_output_stream(self.temporary)
        self.records, self.bytes, self.sha = 0, 0, hashlib.sha256()
        self.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", s.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], f"software: {s.software}\r\n".encode()))
        self.records = 0

    def add(self, record: bytes) -> None:
        member = zlib.compress(record, self.s.level, wbits=31)
        self.out.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)

    def close(self) -> dict:
        self.out.close()
        _commit(self.store, self.temporary, f"{self.root}/{self.name}")
        return {"name": [self.name], "records": [self.records], "compressed_bytes": [self.bytes], "sha256": [self.sha.hexdigest()]}


def _writer(uri: str, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(uri)
        at, roll, file = None, 0, None
        last, written = None, set()  # responses of the page id at hand: whole copies of a row stand together
        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            shards, pages, urls, refers, revisits, dates = (columns[k].to_pylist() for k in (0, 1, 2, 4, 5, 6))
            for shard, page_id, url, html, refers_to, revisit, date in zip(shards, pages, urls, columns[3], refers, revisits, dates, strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                if (shard, page_id) != last:
                    last, written = (shard, page_id), set()
                if not revisit and len(payload) >= s.least_payload:
                    digest = hashlib.sha1(payload).digest()
                    revisit, refers_to = (True, page_id) if digest in written else (False, refers_to)
                    written.add(digest)
                if file is not None and (shard != at or file.bytes >= s.file_bytes):
                    yield pa.RecordBatch.from_pydict(file.close())
                    file, roll = None, roll + 1
                if shard != at:
                    at, roll = shard, 0
                if file is None:
                    file = _File(store, root, f"pages-{shard:05d}-{roll:05d}.warc.gz", s)
                file.add(page_record(page_id, url, payload, refers_to, revisit, date or s.date, s))
        if file is not None:
            yield pa.RecordBatch.from_pydict(file.close())

    return run


def with_revisits(pages: DataFrame, s: Settings, folder: str, date_col: str | None = None) -> DataFrame:
    """(page_id, url, html, refers_to, revisit, date, at); ``at`` is a hash of the row that tells repeated page ids apart."""
    date = F.date_format(F.col(f"`{date_col}`").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"), date.alias("date"))
    rows = rows.withColumn("at", F.xxhash64("page_id", "url", "html"))
    marks = rows.select("page_id", F.sha1("html").alias("digest"), F.length("html").alias("size"), "at").where(F.col("size") >= s.least_payload)
    groups = marks.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "at")).alias("first")).where("n > 1")
    groups = save(groups.select(F.col("digest").alias("g_digest"), F.col("size").alias("g_size"), F.col("first.page_id").alias("to"), F.col("first.at").alias("to_at")), f"{folder}/groups")
    same = (F.col("digest") == F.col("g_digest")) & (F.col("size") == F.col("g_size"))
    links = save(marks.join(groups, same).select(F.col("page_id").alias("l_page"), F.col("at").alias("l_at"), "to", "to_at").distinct(), f"{folder}/links")
    joined = rows.join(links, F.col("page_id").eqNullSafe(F.col("l_page")) & (F.col("at") == F.col("l_at")), "left")
    first = F.col("page_id").eqNullSafe(F.col("to")) & (F.col("at") == F.col("to_at"))
    return joined.select("page_id", "url", "html", F.col("to").alias("refers_to"), (F.col("l_at").isNotNull() & ~first).alias("revisit"), "date", "at")


def write_archives(pages: DataFrame, uri: str, settings: Settings = Settings(), date_col: str | None = None) -> dict:
    """Write the archives and return their manifest; columns page_id, url and html are used, and ``date_col`` where named."""
    store, root = _open(uri)
    store.create_dir(root, recursive=True)
    rows = with_revisits(pages, settings, work_dir(pages.sparkSession, "warc"), date_col)
    rows = range_sharded(rows, "page_id", F.col("at"), settings.shard_pages).sortWithinPartitions(SHARD, "page_id", "url", "revisit", "html")
    rows = rows.select(SHARD, "page_id", "url", "html", "refers_to", "revisit", "date")
    # one row for each file comes to the driver
    files = sorted(tuple(r) for r in rows.mapInArrow(_writer(uri, settings), FILES).collect())
    manifest = {"files": [dict(zip(("name", "records", "compressed_bytes", "sha256"), f, strict=True)) for f in files]}
    with store.open_output_stream(f"{root}/.manifest") as f:
        f.write(json.dumps(manifest).encode())
    _commit(store, f"{root}/.manifest", f"{root}/manifest.json")
    return manifest


class _Counted:
    """A stream that counts and digests what is read from it."""

    def __init__(self, stream):
        self.stream, self.bytes, self.sha = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        got = self.stream.read(n)
        self.bytes += len(got)
        self.sha.update(got)
        return got


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive, member by member."""
    pending, inflate, plain = b"", zlib.decompressobj(31), []
    while True:
        if not pending:
            pending = stream.read(1 << 20)
            if not pending:
                if any(plain):
                    raise ValueError("the archive ends within a record")
                break
        plain.append(inflate.decompress(pending))
        pending = b""
        if inflate.eof:
            pending, inflate, record = inflate.unused_data, zlib.decompressobj(31), b"".join(plain)
            plain = []
            head, _, rest = record.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = rest[: int(headers["Content-Length"])]
            if rest[len(block) :] != b"\r\n\r\n":
                raise ValueError("a record doesn't end where its length says")
            yield headers, block


def _reader(uri: str):
    def parse(h: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response":
            if len(payload) != int(fields["Content-Length"]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't match its header")
        to = _page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
        return _page(h["WARC-Record-ID"]), int(fields["Content-Length"]), digest, h["WARC-Type"], to, h["WARC-Target-URI"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(uri)
        schema = pa.schema([(f.name, pa.string() if f.dataType == T.StringType() else pa.int64()) for f in RECORDS.fields])
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for file in batch.to_pylist():
                with store.open_input_stream(f"{root}/{file['name']}", compression=None) as stream:
                    source, rows, count = _Counted(stream), [], 0
                    for headers, block in records(source):
                        if headers["WARC-Type"] != "warcinfo":
                            rows.append(parse(headers, block))
                            count += 1
                        if len(rows) == 4096:
                            yield emit(rows)
                            rows = []
                    if (count, source.bytes, source.sha.hexdigest()) != (file["records"], file["compressed_bytes"], file["sha256"]):
                        raise ValueError(f"{file['name']} isn't what the manifest says")
                    if rows:
                        yield emit(rows)

    return run


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """One row for each page record of a complete folder; raises where a file isn't what the manifest says."""
    store, root = _open(uri)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        files = [tuple(x[k] for k in ("name", "records", "compressed_bytes", "sha256")) for x in json.loads(f.read())["files"]]
    if not files:
        return spark.createDataFrame([], RECORDS)
    return spark.sparkContext.parallelize(files, len(files)).toDF(FILES).mapInArrow(_reader(uri), RECORDS)
