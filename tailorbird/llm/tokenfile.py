"""Token-id files: whole texts as ids, in ascending doc_id order, in compressed and checksummed blocks.

The documents are dealt out and sorted by doc_id; each task encodes its texts, appends the end id to each,
cuts the stream of ids into blocks for the range coder and writes one file: the blocks, then an index of its
documents.  The manifest, written last, names the files of the tasks that succeeded and the ids before each,
so a task that ran twice leaves nothing visible.  Reading decodes files in parallel and checks every block.

Cases: a null text is an empty one and its document is the end id alone; null doc_ids come first; rows that
repeat a doc_id follow each other in the order of a hash of their texts; an empty table makes a manifest
without documents; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import rangecoder
from .shared import cut
from .tokens import CHUNK, crc32, encoder
from .warc import file_system

_MAGIC = b"TBIDS003"
_FOOTER = "<QQQ"
_SPAN = rangecoder.BLOCK * rangecoder.LANES


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Write docs (doc_id, text) as a folder of token-id files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        store, top = file_system(path)
        name = f"part-{uuid.uuid4().hex}.ids"
        ids, sizes, waiting, total, at = [], [], bytearray(), 0, len(_MAGIC)
        out = None

        def flush(most: int) -> int:
            n = 0
            while len(waiting) >= 4 * most and waiting:
                part = np.frombuffer(bytes(waiting[: 4 * _SPAN]), "<u4")
                del waiting[: 4 * _SPAN]
                # the cost lies in the steps of a block, so a short run is cut into more and shorter blocks
                for block in rangecoder.encode(part, min(rangecoder.BLOCK, max(1024, -(-len(part) // 512)))):
                    out.write(block)
                    n += len(block)
            return n

        for batch in batches:
            for part in cut(batch, CHUNK):
                got, ends = encode(part.column(1), (end_id,))
                ids += part.column(0).to_pylist()
                sizes += np.diff(ends).tolist()
                total += len(got)
                waiting += got.astype("<u4").tobytes()
                if len(waiting) >= 4 * _SPAN:
                    if out is None:
                        store.create_dir(top, recursive=True)
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                        out.write(_MAGIC)
                    at += flush(_SPAN)
        if ids:
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}", compression=None)
                out.write(_MAGIC)
            at += flush(0)
            known = np.array([i is not None for i in ids])
            index = np.diff(
                np.array([i or 0 for i in ids], np.int64), prepend=0,
            ).tobytes() + np.array(sizes, "<u4").tobytes() + np.packbits(known).tobytes()
            out.write(zlib.compress(index, 4))
            out.write(struct.pack(_FOOTER, at, len(ids), total) + _MAGIC)
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [TaskContext.get().partitionId()], "name": [name], "docs": [len(ids)], "ids": [total]}
            )

    spark = docs.sparkSession
    hashed = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", hashed).sortWithinPartitions("doc_id", hashed)
    files = sorted(ordered.mapInArrow(run, "part long, name string, docs long, ids long").collect())  # a row per file
    manifest, start = [], 0
    for f in files:
        manifest.append({"name": f["name"], "docs": f["docs"], "ids": f["ids"], "start": start})
        start += f["ids"]
    store, top = file_system(path)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())


@dataclass
class File(InputPartition):
    name: str
    start: int


SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


class TokenFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.with_ids = options["path"], options.get("ids", "true").lower() == "true"

    def partitions(self):
        store, top = file_system(self.path)
        manifest = json.loads(store.open_input_stream(f"{top}/manifest.json").read())
        return [File(f["name"], f["start"]) for f in manifest]

    def read(self, partition):
        schema = pa.schema(
            [
                ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                ("ids", pa.list_(pa.int32())),
            ]
        )
        if partition is None:  # what Spark asks for where there are no partitions
            return
        store, top = file_system(self.path)
        with store.open_input_file(f"{top}/{partition.name}") as f:
            tail = struct.calcsize(_FOOTER) + len(_MAGIC)
            f.seek(f.size() - tail)
            footer = f.read(tail)
            at, n, total = struct.unpack(_FOOTER, footer[:-8])
            f.seek(at)
            index = zlib.decompress(f.read(f.size() - tail - at))
            known = np.unpackbits(np.frombuffer(index[12 * n :], np.uint8))[:n].astype(bool)
            ids = [int(i) if k else None for i, k in zip(np.cumsum(np.frombuffer(index[: 8 * n], np.int64)), known)]
            sizes = np.frombuffer(index[8 * n : 12 * n], "<u4").astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            f.seek(len(_MAGIC))
            have, done, doc = np.zeros(0, "<u4"), 0, 0  # decoded ids that no document has taken yet, and where they begin
            while f.tell() < at:
                blocks = []
                while len(blocks) < rangecoder.LANES and f.tell() < at:
                    head = f.read(rangecoder.HEADER)
                    _, size = rangecoder.header(head)
                    blocks.append(head + f.read(size))
                have = np.concatenate([have, rangecoder.decode(blocks)])
                last = int(np.searchsorted(starts + sizes, done + len(have), "right"))
                for a in range(doc, last, 2000):
                    yield self._rows(partition, schema, ids, starts, sizes, have, done, a, min(a + 2000, last))
                if last > doc:
                    left = int(starts[last - 1] + sizes[last - 1]) - done
                    have, done, doc = have[left:], done + left, last
            if doc != n or done != total:
                raise rangecoder.BlockError("a file's blocks and index differ")

    def _rows(self, partition, schema, ids, starts, sizes, have, done, a, b):
        parts = [have[s - done : s - done + k] for s, k in zip(starts[a:b].tolist(), sizes[a:b].tolist())]
        columns = [
            ids[a:b], partition.start + starts[a:b], sizes[a:b], [crc32(p) for p in parts],
            parts if self.with_ids else [None] * len(parts),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


class TokenFileSource(DataSource):
    """Options: path; ids (whether to return them)."""

    @classmethod
    def name(cls):
        return "token_ids"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TokenFileReader(dict(self.options))


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and ids of every document of a folder."""
    spark.dataSource.register(TokenFileSource)
    return spark.read.format("token_ids").option("ids", str(ids).lower()).load(path)
