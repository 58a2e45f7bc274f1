"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majorities over the XXH64 of word shingles.  Each of 2^(radius+1)-1 tables keeps
the bits of one structured mask: bit i has the non-zero label m(i) in GF(2)^(radius+1), and table v keeps
bit i if <m(i), v> = 1.  Any `radius` labels leave some v orthogonal to all of them, so every pair within
the radius agrees in the whole key of that table: no link is lost.

Copies meet first as one class per fingerprint.  A small bucket compares its members in place.  A bucket
over `small_bucket` members is never gathered: each member writes itself and its one-bit neighbours (two
values within distance 2 share one, and none farther apart do), and all join the smallest member under each.
Links then form components by hash-to-min steps, each written to the shared folder.

Cases: null and empty texts have fingerprint zero; repeated rows give repeated result rows; a null doc_id
is kept and never names a component unless its class has no other id; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, map_rows, written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
BITS = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of one whole text, as an unsigned integer."""
    words = _WORD.findall((text or "").translate(_LOWER)) if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 14):  # a very long text goes through in parts
        part = words[i : min(n, i + (1 << 14)) + shingle - 1]
        joined = map(" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [" ".join(words)]
        digest = xxhash.xxh64_digest
        h = np.frombuffer(b"".join([digest(s.encode("utf-8", "replace"), 42) for s in joined]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, hashed: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; and th, a hash of the text, if `hashed`."""

    def run(columns):
        ids, texts, *rest = columns
        yield ids, [x - (1 << 64) if (x := fingerprint(t, shingle)) >> 63 else x for t in texts], *rest

    rows = docs.select("doc_id", "text", *([F.xxhash64("text").alias("th")] if hashed else []))
    return map_rows(rows, run, "doc_id long, fp long" + ", th long" * hashed)


def masks(radius: int) -> list[int]:
    """The tables' masks as signed longs."""
    labels = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    found = [sum(1 << i for i, m in enumerate(labels) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(classes: DataFrame, radius: int = 2, small_bucket: int = 64) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the radius, enough to connect all that are linked.

    The linear way for large buckets needs a radius of 2; at others a large bucket is compared block by block,
    all pairs of it, with about two blocks of `small_bucket` members in memory.
    """
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])
    keyed = classes.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    # sums that are joined back are written first: then both sides are dealt out anew and Spark can split a hot key
    sizes = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    members = written(keyed.join(sizes.hint("merge"), ["t", "key"]), "simhash-buckets")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius

    def compared(buckets: DataFrame) -> DataFrame:
        found = F.transform(
            "fps",
            lambda x: F.transform(F.filter("fps", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))),
        )
        return buckets.select(F.explode(F.flatten(found)).alias("p")).select("p.a", "p.b")

    small = compared(members.filter(F.col("n") <= small_bucket).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps")))
    large = members.filter(F.col("n") > small_bucket)
    if radius != 2:  # every two blocks of a large bucket meet once, a block with itself in each of its meetings
        blocks = F.ceil(F.col("n") / small_bucket).cast("int")
        own = large.select(
            "fp", "t", "key", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("i"),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"),
        )
        met = own.groupBy(
            "t", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"),
        ).agg(F.array_sort(F.collect_list("fp")).alias("fps"))
        return small.unionByName(compared(met)).distinct()
    large = large.select("fp").distinct()
    hubs = large.select(
        "fp",
        F.explode(
            F.concat(
                F.array("fp"),
                F.array(*[F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(BITS)]),
            )
        ).alias("hub"),
    )
    least = written(hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").drop("z"), "simhash-hubs")
    starred = hubs.join(least.hint("merge"), "hub").filter("fp != a").select("a", F.col("fp").alias("b"))
    return small.unionByName(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of an edge table (a, b).

    Alternates large-star and small-star steps until the edges no longer change; every node then points
    at its component's smallest.  Each step is written to the shared folder; only counts reach the driver.
    """

    def star(df: DataFrame, small: bool) -> DataFrame:
        both = df.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if small:  # neighbours that are no larger, seen from the larger end
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        else:
            both = both.union(both.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        paired = both.join(least.hint("merge"), "u")
        out = paired.filter("v > u" if not small else "v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        if small:
            out = out.union(least.select("m", "u"))
        return out.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "links")
    last, now = None, sign(edges)
    while now[0] and now != last:
        edges = written(star(written(star(edges, False), "large-star"), True), "small-star")
        last, now = now, sign(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())


def classes_of(prints: DataFrame, radius: int) -> DataFrame:
    """prints (doc_id, fp and others) with `component`, one for each group of linked fingerprints, and component_id, its smallest doc_id."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    named = classes.join(linked.hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    classes = written(named.join(ids.hint("merge"), "component").select("fp", "component", "component_id"), "classes")
    return prints.join(classes.hint("merge"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) for every row."""
    out = classes_of(written(fingerprints(docs, shingle), "fingerprints"), radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each component: that of its smallest doc_id.

    Of rows that repeat an id with one text one stays, chosen by a hash of the row; an id with two texts is two
    documents, of which the one whose text has the smaller hash stands for a component of both. Rows without a doc_id
    can't be named as anyone's copy and all stay.
    """
    th, place = free_name(docs, "text_hash"), free_name(docs, "place")
    prints = written(fingerprints(docs, shingle, hashed=True), "fingerprints")
    own = classes_of(prints, radius).filter("doc_id = component_id")
    keep = written(
        own.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("k.doc_id", F.col("k.th").alias(th)),
        "kept",
    )
    named = docs.filter("doc_id is not null").withColumns({th: F.xxhash64("text"), place: F.xxhash64(*docs.columns)})
    named = named.join(keep.hint("merge"), ["doc_id", th], "left_semi")
    first = Window.partitionBy("doc_id", th).orderBy(place)
    named = named.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
