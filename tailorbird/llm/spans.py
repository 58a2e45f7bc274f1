"""Substring dedup by sliding spans of sentences.

A text is cut into sentences at words that end in `.`, `!` or `?`, behind `。`, `！`, `？` and `｡`, and at line ends.
In scripts that write no spaces between words, every character is a word that counts half.  A long sentence is cut
further, behind words that outrank their neighbours by a hash of their letters, so that a passage pasted into
the middle of another sentence still has the same inner cuts.  From every sentence a span runs over at least `sentences` of them and at least
`words` words; its 96-bit hash joins globally, and every sentence covered by a span that is not the first of
its hash (smallest doc_id, then place) is removed.

Only hashes move: once to find the first of each repeated hash (with partial sums, so that a hash which many
documents share arrives as one row per task), once to join it back to its places (a join whose large
partitions Spark splits).

Cases: null texts stay null and empty texts empty; a text with fewer sentences or words than a span is never
changed; rows that repeat a doc_id count as documents of their own, in the order of their texts, and null ids
come first; extra columns pass through.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .shared import cut, map_rows, written

_TWO = struct.Struct("<qi4x").unpack

#: Kinds of code points: 1 white space (as for str.isspace, without rare ones), 2 the end of a sentence if white space
#: follows, 3 the end of one whatever follows.
_KIND = np.zeros((1 << 16) + 1, np.int8)
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 1
_KIND[[ord(c) for c in ".!?"]] = 2
_KIND[[ord(c) for c in "。！？｡"]] = 3

#: Code points of scripts without spaces between words: Thai and Lao, Burmese, Khmer, kana, Han, and all beyond 2^16.
_LONE = np.zeros((1 << 16) + 1, bool)
for _a, _b in (
    (0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x2FE0), (0x3005, 0x3008), (0x3041, 0x3100),
    (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0),
):
    _LONE[_a:_b] = True
_LONE[1 << 16] = True

#: A word ends a sentence early if it outranks this many neighbours on both sides; none is longer than LONGEST.
REACH, LONGEST = 4, 20
_END = 1 << 40


def sentences_of(texts: list[str]) -> tuple[str, list[tuple[list[int], list[int]]]]:
    """The texts as one string, and for each text the places in it where its sentences begin, with its end as the
    last, and the number of half words before each. All texts go through together, as most of the work is per call."""
    whole = "\n".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, 1 << 16)
    kind, lone = _KIND[low], _LONE[low]
    space = kind == 1
    # a word begins behind white space, at and behind a lone character, and behind a wide end; ends stay with their word
    start = ~space
    start[1:] &= space[:-1] | lone[1:] | ((kind[1:] < 2) & (lone[:-1] | (kind[:-1] == 3)))
    stop = ~space
    stop[:-1] &= space[1:] | start[1:]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    n = len(begin)
    if not n:
        return whole, [([int(s), int(s + k)][: 1 + bool(k)], [0, 0][: 1 + bool(k)]) for s, k in zip(starts, lengths)]
    lines = np.flatnonzero(points == 10)
    line_of = np.searchsorted(lines, begin)
    ends = kind[end - 1] >= 2
    ends[:-1] |= line_of[1:] != line_of[:-1]
    ends[-1] = True
    # a word's rank comes from its letters alone; the ends of sentences outrank all words
    rank = (
        (points[begin].astype(np.uint64) * 31 + points[end - 1]) * 31 + points[(begin + end) // 2]
    ) * 31 + (end - begin).astype(np.uint64)
    rank = ((rank * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)).astype(np.int64)
    rank[ends] = _END
    padded = np.full(n + 2 * REACH, _END)
    padded[REACH : REACH + n] = rank
    peak = ~ends
    for k in range(1, REACH + 1):
        peak &= (rank > padded[REACH - k : REACH - k + n]) & (rank >= padded[REACH + k : REACH + k + n])
    cuts = np.flatnonzero(ends | peak) + 1
    gaps = np.diff(cuts, prepend=0)
    if gaps.max() > LONGEST:
        cuts = np.sort(
            np.concatenate([cuts, *(np.arange(c - g + LONGEST, c, LONGEST) for c, g in zip(cuts[gaps > LONGEST], gaps[gaps > LONGEST]))])
        )
    first = np.concatenate([[0], cuts[:-1]])  # the first word of each sentence, in all texts
    of_text = np.searchsorted(first, np.searchsorted(begin, np.append(starts, len(whole) + 1)))
    halves = np.append(0, np.cumsum(np.where(lone[begin], 1, 2)))
    places, words = begin[first].tolist(), halves[np.append(first, n)].tolist()
    out = []
    for s, k, a, b in zip(starts.tolist(), lengths.tolist(), of_text.tolist(), of_text[1:].tolist()):
        if a == b:
            out.append(([s, s + k][: 1 + bool(k)], [0, 0][: 1 + bool(k)]))
        else:
            out.append(([s, *places[a + 1 : b], s + k], [w - words[a] for w in words[a : b + 1]]))
    return whole, out


def spans_of(texts: list[str | None], sentences: int, words: int) -> list[list[tuple[int, int, int, int]]]:
    """For each text, (hash, second hash, first sentence, sentence behind the last) of every span."""
    whole, cut_up = sentences_of([t or "" for t in texts])
    digest, found = xxhash.xxh3_128_digest, []
    for places, counts in cut_up:
        n, out, end = len(places) - 1, [], 0
        if n >= sentences and counts[-1] >= 2 * words:
            digests = [digest(whole[a:b].strip().encode("utf-8", "replace")) for a, b in zip(places, places[1:])]
            for i in range(n):
                end = max(end, i + sentences)
                while end <= n and counts[end] - counts[i] < 2 * words:
                    end += 1
                if end > n:
                    break
                out.append((*_TWO(digest(b"".join(digests[i:end]))), i, end))
            if out[-1][3] < n:  # a short end that no span has reached yet: the shortest span that ends there
                i = n - sentences
                while counts[n] - counts[i] < 2 * words:
                    i -= 1
                out.append((*_TWO(digest(b"".join(digests[i:n]))), i, n))
        found.append(out)
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `row_key`, unique and in the order of doc_id: doc_id itself where it can be."""
    ids = docs.select("doc_id").groupBy("doc_id").count().agg(F.max("count"), F.count_if(F.col("doc_id").isNull())).first()
    if (ids[0] or 1) == 1 and not ids[1]:
        return docs.withColumn("row_key", F.col("doc_id"))
    return written(docs.orderBy("doc_id", "text").withColumn("row_key", F.monotonically_increasing_id()), "keyed")


def repeats(docs: DataFrame, sentences: int = 2, words: int = 14) -> DataFrame:
    """row_key, its repeated spans as [at, end) sentence pairs, and the doc_ids that hold their first copies."""

    def run(columns):
        keys, ids, texts = columns
        for key, doc_id, found in zip(keys, ids, spans_of(texts, sentences, words)):
            if found:
                h, g, at, end = map(list, zip(*found))
                yield h, g, [key] * len(h), at, end, [None if doc_id == key else doc_id] * len(h)

    # doc_id is null where row_key says it already, so that it takes no room in the shuffle
    spans = map_rows(docs.select("row_key", "doc_id", "text"), run, "h long, g int, row_key long, at int, end int, other_id long")
    first = spans.groupBy("h", "g").agg(
        F.count("*").alias("n"), F.min(F.struct("row_key", "at", "other_id")).alias("first"),
    ).filter("n > 1").drop("n")
    # written, so that both sides of the join are dealt out anew and Spark can split a hash that many rows share
    first = written(first, "repeated-spans")
    later = spans.drop("other_id").join(first.hint("merge"), ["h", "g"]).filter(
        (F.col("row_key") != F.col("first.row_key")) | (F.col("at") != F.col("first.at"))
    )
    source = F.coalesce("first.other_id", "first.row_key")
    return later.groupBy("row_key").agg(F.collect_list(F.struct("at", "end")).alias("spans"), F.collect_set(source).alias("sources"))


def without(whole: str, places: list[int], spans: list[tuple[int, int]]) -> tuple[str, int]:
    """A text without the sentences that the spans cover, and how many went."""
    gone = bytearray(len(places) - 1)
    for a, b in spans:
        gone[a:b] = b"\1" * (b - a)
    return "".join([whole[a:b] for a, b, g in zip(places, places[1:], gone) if not g]), sum(gone)


def dedup_substrings(docs: DataFrame, sentences: int = 2, words: int = 14) -> DataFrame:
    """docs with `text` cleaned and n_sentences, n_removed and source_ids (documents with the first copies) added.

    Columns of these three names, and of those used on the way, are replaced.
    """
    docs = _keyed(docs.drop("row_key", "spans", "sources", "n_sentences", "n_removed", "source_ids"))
    joined = docs.join(repeats(docs, sentences, words).hint("merge"), "row_key", "left")
    names = [c for c in docs.columns if c != "row_key"]
    schema = docs.select(*names).schema.add("n_sentences", IntegerType()).add("n_removed", IntegerType()).add("source_ids", ArrayType(LongType()))

    def run(batches):
        for batch in batches:
            for part in cut(batch):
                column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                texts, counts, removed = column["text"].to_pylist(), [], []
                whole, cut_up = sentences_of([t or "" for t in texts])
                for i, ((places, _), spans) in enumerate(zip(cut_up, column["spans"].to_pylist())):
                    k = 0
                    if spans:
                        texts[i], k = without(whole, places, [(s["at"], s["end"]) for s in spans])
                    counts.append(len(places) - 1)
                    removed.append(k)
                column |= {
                    "text": pa.array(texts, pa.string()), "n_sentences": pa.array(counts, pa.int32()),
                    "n_removed": pa.array(removed, pa.int32()),
                }
                column["source_ids"] = column["sources"].cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([column[f.name] for f in schema], names=schema.names)

    return joined.mapInArrow(run, schema)
