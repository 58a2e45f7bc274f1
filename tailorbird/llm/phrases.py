"""Phrase collocations by a three-way quicksort of suffix pointers.

Every word begins a suffix of up to four words that ends at its piece of text. Suffixes are routed over the cluster by
their first two words, so that all of a phrase's meet in one task; there a multikey quicksort parts pointers to them by
one word at a time into smaller, equal and larger ones: the equal part of depth d is all suffixes that begin with one
phrase of d words, and its size is that phrase's count. Parts with fewer suffixes than a phrase must have are abandoned.

A first pass counts single words. Words that are too rare for any phrase end a suffix; a bitmap of fixed size tells most
of them apart, and one that it lets through only costs room. Equal suffixes of one buffer travel as one with a weight.
Pairs with over a thousandth of a language's words are routed by their third word too, and only their own counts,
at most a few thousand, are added up over tasks. Joins back to parts and words read written tables, so that Spark can
split the rows of a frequent part.

Cases: null and empty texts have no words; a null language is `und`; repeated rows count as often as they stand; other columns
and ids are ignored; a language without a phrase has no rows. Words are held as 64-bit hashes; should two words of a language
share one, all is done again with other hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, written

_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
_MARK = b"."  # can't be a word
BITS = 24
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
BUFFER = 6 << 20


class _Hashes(dict):
    """A word's hash, never zero; zero is the end of a piece."""

    def __init__(self, seed: int):
        super().__init__({_MARK: 0})
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        self[word] = h = word_hash(word, self.seed)
        return h


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed) or 1


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, and a mark behind each of its pieces. bytes.lower() knows A-Z only."""
    return [w for w in text.lower().translate(_ENDS).replace(b".", b" . ").split(b" ") if w]


def buffers(batches: Iterator[pa.RecordBatch], most: int = BUFFER) -> Iterator[tuple[str, list[bytes]]]:
    """Words with marks of the texts of one language, some megabytes of them at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for part in cut(batch):
            for lang, text in zip(*(c.to_pylist() for c in part.columns)):
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size > most:
                yield from ((lang, tokens(b".".join([*texts, b""]))) for lang, texts in held.items())
                held, size = {}, 0
    yield from ((lang, tokens(b".".join([*texts, b""]))) for lang, texts in held.items())


def _ints(hashes: _Hashes, words: list[bytes]) -> np.ndarray:
    if len(hashes) > 1 << 20:
        hashes.clear()
        hashes[_MARK] = 0
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _pair_mix(lang: str, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    x = (one * _MIX[0]) ^ (two * _MIX[1]) ^ np.uint64(xxhash.xxh64_intdigest(lang, 42))
    return x ^ (x >> np.uint64(29))


def counted_words(texts: DataFrame, seed: int, share: float) -> DataFrame:
    """Rows of lang, h, word and n, partial; and of pairs that are frequent in a buffer: their mix as h, without a word."""

    def run(batches):
        hashes, counts, held = _Hashes(seed), {}, 0

        def out(rows):
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.int64()))], names=["lang", "h", "word", "n"])

        def words():
            rows = [(lang, (h := hashes[w]) - (h >> 63 << 64), w, n) for lang, c in counts.items() for w, n in c.items()]
            for i in range(0, len(rows), 50_000):
                yield out(rows[i : i + 50_000])

        for lang, found in buffers(batches):
            ids = _ints(hashes, found)
            c = counts.setdefault(lang, Counter())
            held -= len(c)
            c.update(found)
            c.pop(_MARK, None)
            held += len(c)
            mix = _pair_mix(lang, ids[:-1], ids[1:])[(ids[:-1] != 0) & (ids[1:] != 0)]
            pairs, n = np.unique(mix, return_counts=True)
            often = n > max(2, share * len(ids))
            if often.any():
                yield out([(lang, int(h), None, int(k)) for h, k in zip(_signed(pairs[often]), n[often])])
            if held > 500_000:
                yield from words()
                counts, held = {}, 0
        yield from words()

    return texts.mapInArrow(run, "lang string, h long, word binary, n long")


def windows(ids: np.ndarray, frequent: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of at least two frequent words, as `depth` rows of hashes ended by zeros, and how often each is there."""
    n = len(ids)
    padded, there = np.append(ids, np.zeros(depth, np.uint64)), np.append(frequent, np.zeros(depth, bool))
    at = np.flatnonzero(there[:n] & there[1 : n + 1])
    rows, valid = [padded[at], padded[at + 1]], np.ones(len(at), bool)
    for k in range(2, depth):
        valid &= there[at + k]
        rows.append(np.where(valid, padded[at + k], np.uint64(0)))
    return merged(np.array(rows[:depth]), np.ones(len(at), np.int64))


def merged(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix once, in sorted order, with the sum of its weights."""
    if not len(weights):
        return rows, weights
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    first = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0)))
    return rows[:, first], np.add.reduceat(weights[order], first)


def routed(texts: DataFrame, seed: int, bits: np.ndarray, heavy: dict[str, np.ndarray], buckets: int, depth: int) -> DataFrame:
    """bucket, lang, heavy and the packed suffixes of a buffer that go there."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast((bits, heavy))

    def run(batches):
        bits, heavy = known.value
        hashes, press = _Hashes(seed), zstandard.ZstdCompressor(1)
        for lang, found in buffers(batches):
            ids = _ints(hashes, found)
            place = (ids ^ np.uint64(xxhash.xxh64_intdigest(lang, 42))) & np.uint64((1 << BITS) - 1)
            frequent = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool) & (ids != 0)
            rows, weights = windows(ids, frequent, depth)
            if not len(weights):
                continue
            mix = _pair_mix(lang, rows[0], rows[1])
            hot = np.isin(mix, heavy[lang]) if lang in heavy else np.zeros(len(mix), bool)
            if depth > 2:
                mix = np.where(hot, mix ^ (rows[2] * _MIX[2]), mix)
            mix ^= mix >> np.uint64(31)
            to = (mix % np.uint64(buckets)).astype(np.int64) * 2 + hot
            order = np.argsort(to, kind="stable")
            to, rows, weights = to[order], rows[:, order], weights[order]
            starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            out = []
            for a, b in zip(starts, [*starts[1:], len(to)]):
                packed = press.compress(np.vstack([rows[:, a:b], weights[None, a:b].view(np.uint64)]).tobytes())
                out.append((int(to[a] >> 1), lang, bool(to[a] & 1), packed))
            for i in range(0, len(out), 256):
                columns = zip(*out[i : i + 256])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.bool_(), pa.binary()))],
                    names=["bucket", "lang", "heavy", "packed"],
                )

    return texts.mapInArrow(run, "bucket int, lang string, heavy boolean, packed binary")


def quicksorted(rows: np.ndarray, weights: np.ndarray, least: list[int]) -> Iterator[tuple[int, int, int]]:
    """(pointer to a suffix, length, count) of every phrase of two words or more; those of d words with fewer than least[d - 1] are abandoned.

    A multikey three-way quicksort of pointers to the suffixes, one word deeper in each equal part.
    """
    waiting = [(np.arange(len(weights)), 0)]
    while waiting:
        at, d = waiting.pop()
        sizes = weights[at]
        if sizes.sum() < least[d]:
            continue
        word = rows[d][at]
        pivot = np.sort(word[:: max(1, len(word) // 9)])
        pivot = pivot[len(pivot) // 2]
        same = word == pivot
        if not same.all():
            low = word < pivot
            waiting += [(at[low], d), (at[~(low | same)], d)]
        if pivot == 0:  # these suffixes ended before
            continue
        equal = at[same]
        count = int(sizes[same].sum())
        if count >= least[d]:
            if d:
                yield int(equal[0]), d + 1, count
            if d + 1 < len(rows):
                waiting.append((equal, d + 1))


def counted_phrases(packed: DataFrame, least: int, depth: int) -> DataFrame:
    """lang, key (the words' hashes) and n of every phrase; of the pairs among heavy ones, partial counts."""

    def run(batches):
        press = zstandard.ZstdDecompressor()

        def of(lang, heavy, blobs):
            parts = [np.frombuffer(press.decompress(b), np.uint64).reshape(depth + 1, -1) for b in blobs]
            whole = np.concatenate(parts, axis=1)
            rows, weights = whole[:depth], whole[depth].view(np.int64)
            found = list(quicksorted(rows, weights, [1, 1, *[least] * depth] if heavy else [least] * (depth + 1)))
            for i in range(0, len(found), 100_000):
                at, size, n = (np.array(x) for x in zip(*found[i : i + 100_000]))
                inside = np.arange(depth)[None, :] < size[:, None]
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(_signed(np.ascontiguousarray(rows[:, at].T[inside]))))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), keys, pa.array(n, pa.int64())], names=["lang", "key", "n"])

        now, blobs = None, []
        for batch in batches:
            for part in cut(batch):
                for bucket, lang, heavy, packed in zip(*(c.to_pylist() for c in part.columns)):
                    if (bucket, lang, heavy) != now:
                        if blobs:
                            yield from of(*now[1:], blobs)
                        now, blobs = (bucket, lang, heavy), []
                    blobs.append(packed)
        if blobs:
            yield from of(*now[1:], blobs)

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket", "lang", "heavy")
    return dealt.mapInArrow(run, "lang string, key array<bigint>, n long")


def counts(docs: DataFrame, least: int = 30, depth: int = 4, share: float = 1e-3, bucket_words: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Written tables of the words (lang, h, word, n) of all texts, and of the phrases (lang, key, n) with at least `least`."""
    spark = docs.sparkSession
    texts = docs.filter("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.encode("text", "UTF-8").alias("text"))
    seed = 0
    while True:
        got = written(counted_words(texts, seed, share), "phrase-partials")
        words = got.filter("word is not null").groupBy("lang", "h").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other"))
        words = written(words, "phrase-words")
        if words.filter("word != other").isEmpty():
            break
        seed += 1
    words = words.select("lang", "h", F.col("word").cast("string").alias("word"), "n")
    place = F.col("h").bitwiseXOR(F.xxhash64("lang")).bitwiseAND(F.lit((1 << BITS) - 1))
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    marked = words.filter(F.col("n") >= least).select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(%s & 63 as int))" % "(h ^ xxhash64(lang))").alias("bit"))
    for at, bit in marked.groupBy("at").agg(F.bit_or("bit")).collect():  # 2 MB at most
        bits[at] = np.uint64(bit & (1 << 64) - 1)
    total = words.agg(F.sum("n")).first()[0] or 0
    # a pair with a share of all words has it in some buffer; of those that were told, fewer than 1 / share are left
    per_lang = words.groupBy("lang").agg(F.sum("n").alias("all"))
    pairs = got.filter("word is null").groupBy("lang", "h").agg(F.sum("n").alias("n")).join(per_lang.hint("merge"), "lang")
    heavy: dict[str, list[int]] = {}
    for lang, h in pairs.filter(F.col("n") > share * F.col("all")).select("lang", "h").collect():
        heavy.setdefault(lang, []).append(h & (1 << 64) - 1)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_words))
    packed = routed(texts, seed, bits, {k: np.array(v, np.uint64) for k, v in heavy.items()}, buckets, depth)
    partial = counted_phrases(packed, least, depth)
    found = partial.groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return words, written(found, "phrase-counts")


def collocations(docs: DataFrame, least: int = 30, depth: int = 4, cover: int = 80, keep: int = 2000, scale: int = 2_000_000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to `depth` words.

    a is the phrase's count, l and r those of its parts at the cut with the lowest score, scale * a / (l + r) rounded down;
    n is the language's number of words. A phrase inside a longer one that has `cover` percent of its count is left out.
    All sums and products are exact.
    """
    words, phrases = counts(docs, least, depth, **options)
    size = F.size("key")
    # every part that a cut can leave, and every word for the text: (kind, place, key)
    part = lambda kind, at, key: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), key.alias("part"))
    parts = F.concat(
        F.transform(F.sequence(F.lit(1), size - 1), lambda k: part("l", k, F.slice("key", F.lit(1), k))),
        F.transform(F.sequence(F.lit(1), size - 1), lambda k: part("r", k, F.slice("key", k + 1, size - k))),
        F.transform(F.sequence(F.lit(1), size), lambda k: part("w", k, F.slice("key", k, F.lit(1)))),
    )
    asked = written(phrases.select("lang", "key", F.col("n").alias("a"), F.explode(parts).alias("p")).select("lang", "key", "a", "p.*"), "phrase-parts")
    told = written(
        phrases.select("lang", F.col("key").alias("part"), F.col("n").alias("f"), F.lit(None).cast("string").alias("word")).unionByName(
            words.filter(F.col("n") >= least).select("lang", F.array("h").alias("part"), F.col("n").alias("f"), "word")
        ),
        "phrase-told",
    )
    known = asked.join(told.hint("merge"), ["lang", "part"])
    values = known.groupBy("lang", "key", "a").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "l", F.struct("at", "f")))).alias("ls"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "r", F.struct("at", "f")))).alias("rs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "w", F.struct("at", "word")))), lambda w: w["word"]), " ").alias("phrase"),
    )
    wide = "decimal(20,0)"
    cuts = F.expr(
        f"transform(sequence(1, size(key) - 1), k -> named_struct('score', ({scale} * cast(a as {wide})) div (cast(ls[k] as {wide}) + cast(rs[k] as {wide})), 'k', k, 'l', ls[k], 'r', rs[k]))"
    )
    best = values.select("lang", "key", "phrase", "a", F.array_min(cuts).alias("c")).select("lang", "key", "phrase", "a", "c.l", "c.r", "c.score")
    # the largest count of the longer phrases around each
    inner = F.expr("flatten(transform(sequence(2, size(key) - 1), m -> transform(sequence(1, size(key) - m + 1), i -> slice(key, i, m))))")
    around = phrases.filter(size > 2).select("lang", F.explode(inner).alias("key"), "n").groupBy("lang", "key").agg(F.max("n").alias("around"))
    best = best.join(written(around, "phrase-around").hint("merge"), ["lang", "key"], "left")
    covered = F.expr(f"100 * cast(around as {wide}) >= {cover} * cast(a as {wide})")
    best = best.filter(~F.coalesce(covered, F.lit(False)))
    # ranked within 64 parts of a language first, so that no task holds a whole language
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= keep)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    sums = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sums")
    return ranked.join(sums.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
