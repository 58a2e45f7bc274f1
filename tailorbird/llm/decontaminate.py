"""Benchmark decontamination by greedy string tiling.

Rolling Karp-Rabin hashes over `least` words find where a document and a test item share a seed.  For each
such pair, the longest match of words not yet covered is marked again and again, until no match of `least`
words is left; the item counts as leaked if the marked tiles cover at least `coverage` of its words, in
whatever order they stand in the document.

In scripts that write no spaces between words every character is a word that counts half, so that items which
are mostly of such characters take seeds and tiles of twice as many.  An item that is shorter than a seed is
tested by its whole length: it leaks where all of it stands in the document.

The documents never move: each task joins its texts with an index of the test items, sent to the executors.
An index holds items of about `index_chars` characters; a larger benchmark makes several, one pass each.

Cases: null and empty texts leak nothing; an item of fewer than `shortest` words (characters count half) is never
tested, as so few words in a row are no evidence; repeated rows repeat; a null item_id is kept; extra columns are
ignored or pass through.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, map_rows

#: The scripts without spaces between words (Thai, Lao, Tibetan, Burmese, Khmer, Japanese, Chinese).
UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"

_WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
_CHARACTER = re.compile(rf"[{UNSPACED}]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


class _WordHashes(dict):
    """Word to 64-bit hash; starts anew at 100,000 words, about 20 MB in each Python worker."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


_hashes = _WordHashes()


def words_of(text: str | None) -> np.ndarray:
    words = _WORD.findall(text.lower()) if text else []
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of every run of n words, modulo 2^64."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = words[:count].copy()
    for k in range(1, n):
        h *= _BASE
        h += words[k : k + count]
    return h


def runs_of(places: np.ndarray, begin: np.ndarray, end: np.ndarray, found: np.ndarray, least: int, most: int = 1 << 20) -> np.ndarray:
    """The matches (length, i, j) that seeds make along their diagonals.

    Seed k stands at `places[k]` of the item, in ascending order, and at found[begin[k]:end[k]] of the document.
    About `most` pairs of places are laid out at a time, so memory follows the matches, not the pairs.
    """
    counts = end - begin
    slices = np.append(np.flatnonzero(np.diff(np.append(-1, np.cumsum(counts) // most))), len(places))
    out, held_d, held_i, held_at = [], np.zeros(0, np.int64), np.zeros(0, np.int64), -2
    for a, b in zip(slices, slices[1:]):
        n = counts[a:b]
        i = np.repeat(places[a:b], n)
        j = found[np.repeat(begin[a:b] - (np.cumsum(n) - n), n) + np.arange(len(i))]
        d = j - i
        order = np.lexsort((i, d))
        i, d = i[order], d[order]
        new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)))
        d, first, last = d[new], i[new], i[np.append(new[1:], len(i)) - 1]
        # matches that reached the end of the slice before go on here
        on = np.flatnonzero((first == held_at + 1) & np.isin(d, held_d))
        at = np.searchsorted(held_d, d[on])
        first[on] = held_i[at]
        over = np.ones(len(held_d), bool)
        over[at] = False
        out.append(np.stack([held_at - held_i[over] + least, held_i[over], held_i[over] + held_d[over]]))
        held_at = int(places[b - 1])
        open_ = last == held_at
        out.append(np.stack([last - first + least, first, first + d])[:, ~open_])
        held_d, held_i = d[open_], first[open_]
    out.append(np.stack([held_at - held_i + least, held_i, held_i + held_d]))
    return np.concatenate(out, axis=1)


def tiles(item: np.ndarray, doc: np.ndarray, runs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from matches (length, i in item, j in doc): the tiles, longest first."""
    length, i, j = runs[:, np.lexsort((runs[2], runs[1], -runs[0]))].tolist()
    whole, parts = iter(zip([-n for n in length], i, j)), []  # matches by their length, and what is left of some
    free_item, free_doc, found = np.ones(len(item), bool), np.ones(len(doc), bool), []
    ahead = next(whole, None)
    while ahead or parts:
        if ahead and (not parts or ahead <= parts[0]):
            n, i, j = ahead
            ahead = next(whole, None)
        else:
            n, i, j = heapq.heappop(parts)
        n = -n
        free = free_item[i : i + n] & free_doc[j : j + n] & (item[i : i + n] == doc[j : j + n])
        if free.all():
            free_item[i : i + n] = free_doc[j : j + n] = False
            found.append((n, i, j))
            if not len(_stretches(free_item, least)):  # no tile has room any more
                break
        else:
            for a, b in _stretches(free, least).tolist():
                heapq.heappush(parts, (a - b, i + a, j + a))
    return found


def _stretches(free: np.ndarray, least: int) -> np.ndarray:
    """The [begin, end) of every run of at least `least` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8))).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= least]


@dataclass
class Index:
    """The seeds of some test items."""

    least: int
    ids: list
    items: list[np.ndarray]
    hashes: np.ndarray = field(init=False)
    owners: np.ndarray = field(init=False)
    places: np.ndarray = field(init=False)
    filter: np.ndarray = field(init=False)

    def __post_init__(self):
        seeds = [rolling(x, self.least) for x in self.items]
        hashes = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        order = hashes.argsort(kind="stable")
        self.hashes = hashes[order]
        self.owners = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])[order] if seeds else np.zeros(0, int)
        self.places = np.concatenate([*(np.arange(len(s)) for s in seeds), np.zeros(0, int)])[order].astype(int)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(int)] = True

    def leaks(self, text: str | None, coverage: float) -> list[tuple]:
        """(item id, covered share, tiles, longest tile) of each item that the text leaks."""
        return self.leaked(words_of(text), coverage)

    def leaked(self, doc: np.ndarray, coverage: float) -> list[tuple]:
        h = rolling(doc, self.least)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.intp)])
        if not len(at):
            return []
        lo, hi = np.searchsorted(self.hashes, h[at]), np.searchsorted(self.hashes, h[at], "right")
        order = np.flatnonzero(hi > lo)
        order = order[lo[order].argsort(kind="stable")]
        found, lo, hi = at[order], lo[order], hi[order]  # the places of each hash in the document stand together
        if not len(found):
            return []
        begin = np.flatnonzero(np.append(True, lo[1:] != lo[:-1]))
        end, n = np.append(begin[1:], len(found)), (hi - lo)[begin]
        entry = np.repeat(lo[begin] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        group = np.repeat(np.arange(len(begin)), n)
        order = np.lexsort((self.places[entry], self.owners[entry]))
        owner, place, group = self.owners[entry][order], self.places[entry][order], group[order]
        firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        # no tiling covers more of an item than its seeds do
        most = np.add.reduceat(
            np.where(np.append(owner[1:] == owner[:-1], False), np.minimum(np.diff(place, append=0), self.least), self.least),
            firsts,
        )
        out = []
        for a, b, reach in zip(firsts, np.append(firsts[1:], len(owner)), most):
            item = self.items[owner[a]]
            if reach < coverage * len(item):
                continue
            g = group[a:b]
            tiled = tiles(item, doc, runs_of(place[a:b], begin[g], end[g], found, self.least), self.least)
            covered = sum(t[0] for t in tiled)
            if covered >= coverage * len(item):
                out.append((self.ids[owner[a]], covered / len(item), len(tiled), max(t[0] for t in tiled)))
        return out


def seed_of(text: str | None, least: int, shortest: int) -> int:
    """How many words the seeds of an item have; 0 for an item that is never tested."""
    words, characters = len(_WORD.findall((text or "").lower())), len(_CHARACTER.findall((text or "").lower()))
    if 2 * words - characters < 2 * shortest:
        return 0
    return min(words, 2 * least if 2 * characters > words else least)


class Indexes:
    """The seeds of a part of the benchmark: an index for each length of seeds."""

    def __init__(self, rows: list[tuple], least: int, shortest: int):
        by_seed: dict[int, list] = {}
        for item_id, text in rows:
            if seed := seed_of(text, least, shortest):
                by_seed.setdefault(seed, []).append((item_id, words_of(text)))
        self.parts = [Index(n, [i for i, _ in items], [w for _, w in items]) for n, items in sorted(by_seed.items())]

    def leaks(self, text: str | None, coverage: float) -> list[tuple]:
        doc = words_of(text) if self.parts else None
        return [found for index in self.parts for found in index.leaked(doc, coverage)]


def indexes(benchmark: DataFrame, least: int, shortest: int, index_chars: int):
    """Indexes for each part of the benchmark; a part has about `index_chars` characters."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // index_chars))
    for k in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).select("item_id", "text").collect()
        yield Indexes([(r["item_id"], r["text"]) for r in rows], least, shortest)


def leaks(
    docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.8, index_chars: int = 8 << 20, shortest: int = 4,
) -> DataFrame:
    """doc_id, item_id, coverage, tiles and longest of every document that leaks an item."""
    out = None
    for index in indexes(benchmark, least, shortest, index_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(columns, shared=shared):
            rows = [(d, *x) for d, t in zip(*columns) for x in shared.value.leaks(t, coverage)]
            if rows:
                yield [list(c) for c in zip(*rows)]

        found = map_rows(docs.select("doc_id", "text"), run, "doc_id long, item_id long, coverage double, tiles int, longest int")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaked(
    docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.8, index_chars: int = 8 << 20, shortest: int = 4,
) -> DataFrame:
    """The rows of docs that leak no item."""
    for index in indexes(benchmark, least, shortest, index_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared, at=docs.columns.index("text")):
            import pyarrow as pa

            for batch in batches:
                for part in cut(batch):
                    clean = [not shared.value.leaks(t, coverage) for t in part.column(at).to_pylist()]
                    yield part.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
