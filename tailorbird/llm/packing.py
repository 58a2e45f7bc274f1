"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Only lengths matter for the plan, so it is made from the counts of pieces by length (at most `size` numbers):
a bin is filled greedily with the longest pieces that still fit; then, while a gap is left, its smallest piece
is replaced by the two unpacked pieces that fit the gap so expanded most tightly.  A filled bin is a pattern
that is used as often as the counts allow, so the plan has at most a few patterns per length however many
documents there are.  Each piece finds its place from its rank among the pieces of its length, which comes
from counts per task; no task ever holds all pieces of a length.

Cases: a null text is an empty one and its document is the end id alone; a document longer than `size` is cut
into full pieces, of which the first may be shorter; repeated rows are packed as often as they stand there; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, map_rows, written
from .tokens import CHUNK, crc32, encoder


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), and part and rank: the task and the piece's rank in it by length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        encode = encoder(vocabulary).encode
        for batch in batches:
            for rows in cut(batch, CHUNK):
                ids, at = encode(rows.column(1), (end_id,))
                totals = np.diff(at)
                each = -(-totals // size)
                doc = np.repeat(np.arange(len(totals)), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                # only the first piece may be shorter
                end = totals[doc] - size * (each[doc] - 1 - piece)
                start = np.maximum(end - size, 0)
                length = end - start
                order = np.argsort(length, kind="stable")
                by_length = np.bincount(length, minlength=size + 1)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(by_length) - by_length, by_length)
                rank += seen[length]
                seen += by_length
                own = [ids[a:b] for a, b in zip((at[doc] + start).tolist(), (at[doc] + end).tolist())]
                columns = [
                    rows.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(length), pa.array(list(map(crc32, own)), pa.int64()),
                ]
                columns += [
                    pa.array(np.full(len(doc), part, np.int32)), pa.array(rank),
                    *([pa.array([x.tobytes() for x in own], pa.binary())] if with_ids else [])
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"][: len(columns)],
                )
                pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Plan:
    """Segments of ranks by length. Rank r of length n, in the last segment at or before it, is copy (r - first)
    of its segment: in sequence `bin + copy // per_bin`, at `offset + n * (copy % per_bin)`."""

    lengths: np.ndarray
    firsts: np.ndarray
    bins: np.ndarray
    per_bin: np.ndarray
    offsets: np.ndarray
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.lengths * (1 << 48) + self.firsts
        at = np.searchsorted(keys, lengths * (1 << 48) + ranks, "right") - 1
        copy = ranks - self.firsts[at]
        return self.bins[at] + copy // self.per_bin[at], self.offsets[at] + lengths * (copy % self.per_bin[at])


def _two_that_fit(counts: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to `room`, if that is over `more_than`."""
    there = counts > 0
    for total in range(room, more_than, -1):
        a = np.arange(max(1, total - len(counts) + 1), total // 2 + 1)
        fits = there[a] & there[total - a] & ((2 * a != total) | (counts[a] > 1))
        if fits.any():
            a = int(a[fits.argmax()])
            return a, total - a
    return None


def plan(counts: np.ndarray, size: int) -> Plan:
    """A plan for counts[n] pieces of each length n from 1 to size."""
    left, used = counts.astype(np.int64).copy(), np.zeros_like(counts, np.int64)
    rows, bins, longest = [], 0, size
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            break
        chosen, gap, n = {}, size, longest
        while gap and n:
            if k := min(left[n], gap // n):
                chosen[n] = int(k)
                left[n] -= k
                gap -= n * k
            n = min(n - 1, gap)
        while gap and len(chosen):
            least = min(chosen)
            pair = _two_that_fit(left, gap + least, least)
            if pair is None:
                break
            left[least] += 1
            chosen[least] -= 1
            chosen = {m: k for m, k in chosen.items() if k}
            for m in pair:
                left[m] -= 1
                chosen[m] = chosen.get(m, 0) + 1
            gap += least - sum(pair)
        times = 1 + int(min(left[m] // k for m, k in chosen.items()))
        offset = 0
        for m, k in sorted(chosen.items(), reverse=True):
            rows.append((m, used[m], bins, k, offset))
            left[m] -= k * (times - 1)
            used[m] += k * times
            offset += m * k
        bins += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, bins)


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id and offset of every piece."""
    placed = written(pieces(docs, vocabulary, size, end_id, with_ids), "pieces")
    by_task = placed.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_task = written(
        by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")),
        "piece-counts",
    )
    counts = np.zeros(size + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[r["length"]] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, size))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(columns):
        *rest, rank = columns
        sequence, offset = shared.value.place(np.array(rest[3], np.int64), np.array(rank, np.int64))
        yield [*rest, sequence, offset]

    ranked = placed.join(by_task.drop("n").hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_rows(ranked.select(*keep, "rank"), run, schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (little-endian unsigned 32-bit) of each sequence of a result that has ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
    )
