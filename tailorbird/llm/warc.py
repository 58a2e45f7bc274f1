"""WARC archives as a Spark data source.

Reading plans partitions over files, takes predicates on record headers from Spark, parses a record's header
first and leaves the payload of unwanted records undecoded: a plain record is skipped by its Content-Length,
a compressed one by the `sl` (skip lengths) field of its gzip member where it has one, as those written here
do, or else by inflating and discarding bounded pieces.

Writing makes one gzip member per record, in files of about `file_bytes`; files count once the driver has
written the list of a commit, so a task that ran twice leaves nothing visible.

`archive_pages` stores equal payloads once: the row with the largest page_id becomes a response, the others
become revisits that refer to it.

Cases: a null html is an empty payload; null URLs are written as `urn:unknown`; rows that share the largest
page_id of a payload are all responses; a null page_id ranks below all others, and rows that have only null
ids are all responses; extra columns are ignored; an empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .shared import scratch_path

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, "
    "content_type string, http_status int, payload_length long, digest_ok boolean, payload binary"
)
#: What a table must have to be written; payload_hash is the SHA-1 in hexadecimal digits.
WRITTEN = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_hash string, payload_length long, payload binary"

#: Columns that are record headers, hence known before the payload.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
_PIECE = 1 << 16
_HEAD = 1 << 20


def file_system(path: str):
    """A pyarrow file system and the path in it, for any address that pyarrow knows."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", path)
    path = re.sub(r"^file:(?=/[^/])", "file://", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Plain:
    """A file of uncompressed records."""

    def __init__(self, raw: io.BufferedReader):
        self._raw, self._left = raw, b""

    def begin(self) -> bool:
        while not self._left.strip():  # blank lines between records
            self._left = self._raw.read(_PIECE)
            if not self._left:
                return False
        self._left = self._left.lstrip()
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self._left.find(mark)) < 0:
            more = self._raw.read(_PIECE)
            if not more or len(self._left) > _HEAD:
                raise ValueError("a record's header doesn't end")
            self._left += more
        head, self._left = self._left[:at], self._left[at + len(mark) :]
        return head

    def read(self, n: int) -> bytes:
        got, self._left = self._left[:n], self._left[n:]
        if len(got) < n:
            got += self._raw.read(n - len(got))
        if len(got) < n:
            raise ValueError("a record is cut off")
        return got

    def skip(self, n: int) -> None:
        if n > len(self._left):
            self._raw.seek(n - len(self._left) - 1, 1)
            if not self._raw.read(1):  # one can seek beyond an end
                raise ValueError("a record is cut off")
        self._left = self._left[n:]


class _Inflated(_Plain):
    """A file of gzip members; `_left` holds inflated bytes."""

    def __init__(self, raw: io.BufferedReader):
        super().__init__(raw)
        self._in, self._zip, self._end = b"", None, None
        self._whole = self._got = 0  # inflated bytes of the member, by its `sl` field and so far

    def _open(self) -> bool:
        """Begin the next member; notes where it ends if its `sl` field says so."""
        while len(self._in) < 32 and (more := self._raw.read(_PIECE)):
            self._in += more
        if not self._in.rstrip(b"\0"):
            return False
        self._end, at, self._got = None, self._raw.tell() - len(self._in), 0
        if self._in[3] & 4 and self._in[12:16] == b"sl\x08\x00":
            total, self._whole = struct.unpack("<II", self._in[16:24])
            self._end = at + total
        self._zip = zlib.decompressobj(31)
        return True

    def _more(self) -> bytes:
        while True:
            if self._zip is None or self._zip.eof:
                if not self._open():
                    return b""
            self._in = self._in or self._raw.read(_PIECE)
            out = self._zip.decompress(self._in, _PIECE)
            self._got += len(out)
            if not (self._in or out or self._zip.eof):
                raise ValueError("a compressed record is cut off")
            self._in = self._zip.unused_data if self._zip.eof else self._zip.unconsumed_tail
            if out:
                return out

    def begin(self) -> bool:
        while not self._left.strip():
            self._left = self._more()
            if not self._left:
                return False
        self._left = self._left.lstrip()
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self._left.find(mark)) < 0:
            more = self._more()
            if not more or len(self._left) > _HEAD:
                raise ValueError("a record's header doesn't end")
            self._left += more
        head, self._left = self._left[:at], self._left[at + len(mark) :]
        return head

    def read(self, n: int) -> bytes:
        parts, have = [self._left], len(self._left)
        while have < n:
            if not (more := self._more()):
                raise ValueError("a record is cut off")
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        self._left = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        at = self._got - len(self._left)
        if self._end is not None and 0 <= at and self._whole <= at + n + 4:  # nothing else follows in the member
            self._raw.seek(self._end)
            self._in, self._zip, self._left = b"", None, b""
            return
        while n > len(self._left):
            n -= len(self._left)
            self._left = self._more()
            if not self._left:
                raise ValueError("a record is cut off")
        self._left = self._left[n:]


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(raw, wanted=lambda fields: True, payload: str = "bytes") -> Iterator[dict]:
    """The wanted records of one open file. payload: bytes, digest (decoded to be verified only) or none."""
    raw = io.BufferedReader(raw, 1 << 18)
    source = (_Inflated if raw.peek(2)[:2] == b"\x1f\x8b" else _Plain)(raw)
    while source.begin():
        fields = _fields(source.until(b"\r\n\r\n"))
        n = int(fields.get("content-length", 0))
        if not wanted(fields):
            source.skip(n)
            continue
        http, status, body, size, ok = {}, None, None, None, None
        kind = fields.get("warc-type")
        if fields.get("content-type", "").startswith("application/http") and n:
            head = source.until(b"\r\n\r\n")
            n -= len(head) + 4
            http = _fields(head)
            first = head.split(b"\r\n", 1)[0].split()
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
        size = int(http.get("content-length", n)) if kind == "revisit" else n
        if payload == "none" or kind == "revisit":
            source.skip(n)
        else:
            body = source.read(n)
            if digest := fields.get("warc-payload-digest"):
                ok = base64.b32encode(hashlib.sha1(body).digest()).decode() == digest.removeprefix("sha1:")
            if payload == "digest":
                body = None
        yield {
            **{column: fields.get(name) for column, name in HEADERS.items()},
            "content_type": http.get("content-type") or fields.get("content-type"), "http_status": status, "payload_length": size,
            "digest_ok": ok, "payload": body,
        }


def _clean(value: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def format_record(
    record_type: str, record_id: str, target_uri: str | None, warc_date: str, refers_to: str | None, payload_hash: str,
    payload_length: int, payload: bytes | None,
) -> bytes:
    """One response or revisit record; a revisit has the headers of its response but no payload."""
    body = payload if record_type != "revisit" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_length}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {warc_date}",
        f"WARC-Target-URI: {_clean(target_uri or 'urn:unknown')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(payload_hash)).decode()}",
    ]
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field `sl` holds its compressed and inflated lengths, for skipping."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = z.compress(record) + z.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(data) + len(tail)
    if total >> 32 or len(record) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + data + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(record)) + data + tail


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "bytes")
        self.partition_bytes = int(options.get("partitionbytes", 64 << 20))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNotNull)):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, fields: dict[str, str]) -> bool:
        for f in self.filters:
            value = fields.get(HEADERS[f.attribute[0]])
            if isinstance(f, EqualNullSafe):
                ok = value == f.value
            elif value is None:
                ok = False
            elif isinstance(f, IsNotNull):
                ok = True
            else:
                ok = value == f.value if isinstance(f, EqualTo) else value in f.value if isinstance(f, In) else value.startswith(f.value)
            if not ok:
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        store, top = file_system(self.path)
        found = [
            f for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file
        ] if store.get_file_info(top).type == fs.FileType.Directory else [store.get_file_info(top)]
        commits = [f for f in found if f.base_name.startswith("_commit-")]
        files = [f for f in found if re.search(r"\.warc(\.gz)?$", f.base_name)]
        if commits:
            named = {n for c in commits for n in json.loads(store.open_input_stream(c.path).read())}
            files = [f for f in files if f.base_name in named]
        parts, size = [[]], 0
        for f in sorted(files, key=lambda f: f.path):
            if parts[-1] and size + f.size > self.partition_bytes:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [Files(tuple(p)) for p in parts]

    def read(self, partition):
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, SCHEMA.split(", "))])
        store = file_system(self.path)[0]
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                for r in read_records(raw, self.wanted, self.payload):
                    rows.append(r)
                    size += len(r["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.file_bytes, self.level = options["path"], int(options.get("filebytes", 256 << 20)), int(options.get("level", 4))

    def write(self, iterator):
        store, top = file_system(self.path)
        store.create_dir(top, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                member = gzip_member(format_record(**batch.slice(i, 1).to_pylist()[0]), self.level)
                if out is None or size + len(member) > self.file_bytes:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{top}/{names[-1]}", compression=None), 0
                out.write(member)
                size += len(member)
        if out:
            out.close()
        return Written(tuple(names))

    def commit(self, messages):
        store, top = file_system(self.path)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/_commit-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages):
        store, top = file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{top}/{name}")


class WarcSource(DataSource):
    """Options: path; payload (bytes, digest, none), partitionBytes; fileBytes, level."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make `spark.read.format("warc")` and `df.write.format("warc")` known, with predicate pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archives(records: DataFrame, path: str, **options) -> None:
    """Append records with the columns of WRITTEN to an archive folder."""
    register(records.sparkSession)
    names = [x.split()[0] for x in WRITTEN.split(", ")]
    records.select(*names).write.format("warc").options(**options).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def archive_pages(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0, **options) -> None:
    """Write a record for each row of pages (page_id, url, html); payloads under min_bytes are never revisits."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_hash": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")}
    )
    keys = pages.select("page_id", payload.alias("payload")).select(
        "page_id", F.sha1("payload").alias("payload_hash"), F.octet_length("payload").alias("n"),
    ).filter(F.col("n") >= min_bytes)
    repeated = keys.groupBy("payload_hash").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("n"),
    ).filter("n > 1").select("payload_hash", "keeper")
    hashes = scratch_path(pages.sparkSession, "repeated-payloads")
    repeated.write.parquet(hashes)  # so that the join deals out both sides and Spark can split a frequent payload
    repeated = pages.sparkSession.read.schema(repeated.schema).parquet(hashes)
    joined = rows.join(repeated.hint("merge"), "payload_hash", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    write_archives(
        joined.select(
            F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"),
            F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
            F.when(revisit, urn(F.col("keeper"))).alias("refers_to"), "payload_hash", "payload_length",
            F.when(~revisit, F.col("payload")).alias("payload"),
        ),
        path, **options,
    )


def page_records(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the pages' records."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return archives.filter(F.col("record_type").isin("response", "revisit")).select(
        number(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.replace("payload_digest", F.lit("sha1:"), F.lit("")).alias("payload_digest"),
        "record_type", number(F.col("refers_to")).alias("refers_to"), F.col("digest_ok"),
    )
