"""From page signals to evidence: one row per text fragment, with its source, place and confidence.

Signals are rows of item_id, url, source_site and the eight text buckets. Evidence is long: item_id, pos,
source, block_type, text, confidence, metadata. Buckets that are null or blank give no evidence; a null
item_id is a group like any other.

Whole runs keep the blocks of a capture in an array in its own row instead: a page that was looked at twice isn't mixed up,
its other columns stay where they are, and nothing is dealt out.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_SITE, PRIORITIES, SIGNALS, SITES
from ..functions.text import nfkc, norm_colon, norm_ws, strip_tags


def detect_site(url: Column) -> Column:
    """The site that a URL belongs to."""
    out = F.lit(DEFAULT_SITE)
    for part, site in reversed(SITES):
        out = F.when(url.contains(part), F.lit(site)).otherwise(out)
    return out


def item_id(url: Column) -> Column:
    """A deterministic id, so that a capture that runs twice gives one item."""
    return F.sha2(url, 256)


def site_item_id(url: Column) -> Column:
    """The site's own id of an item: the last part of its path that holds a digit."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.nullif(F.regexp_extract(path, r"/([A-Za-z0-9_-]*\d[A-Za-z0-9_-]*)/?$", 1), F.lit(""))


_PART = "\x00"


def _each_nfkc(texts: Column) -> Column:
    """An array of texts, all normalised in one call: they go to Python as one text and are cut apart again."""
    whole = F.array_join(F.transform(texts, lambda t: F.translate(t, _PART, " ")), _PART)
    return F.split(nfkc(whole), _PART)


def raw_blocks() -> Column:
    """The array of a page's blocks before cleaning: one for each bucket that isn't blank, and one for each line of its description."""

    def block(source: str, kind: str, confidence: float, text: Column) -> Column:
        return F.struct(
            F.lit(source).alias("source"), F.lit(kind).alias("block_type"), text.alias("raw"),
            F.lit(confidence).alias("confidence"),
        )

    parts = []
    for source, column, kind, confidence in SIGNALS:
        text = F.col(column)
        if source == "description":
            parts.append(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), partial(block, source, kind, confidence)))
        else:
            parts.append(F.array(block(source, kind, confidence, text)))
    return F.filter(F.concat(*parts), lambda b: b["raw"].rlike(r"(?U)\S"))


def cleaned_blocks(raw: Column | None = None) -> Column:
    """The array of a page's cleaned blocks. `raw` is a column that holds raw_blocks(), which otherwise are made twice: for Python, and for what comes back."""
    blocks = raw_blocks() if raw is None else raw
    texts = _each_nfkc(F.transform(blocks, lambda b: strip_tags(b["raw"])))
    # without blocks there still is one text, an empty one
    both = F.filter(F.arrays_zip(blocks.alias("b"), texts.alias("t")), lambda x: x["b"].isNotNull())
    return F.transform(
        both,
        lambda x, i: F.struct(
            i.cast("int").alias("pos"), x["b"]["source"].alias("source"), x["b"]["block_type"].alias("block_type"),
            norm_ws(norm_colon(x["t"])).alias("text"), x["b"]["confidence"].alias("confidence")
        ),
    )


#: An item's blocks, in the order of their places; t is the text to extract from.
BLOCKS = "array<struct<pos:int,source:string,confidence:double,t:string>>"


def page_blocks() -> Column:
    """A page's blocks with their texts and what to extract from. A description line of nothing but tags is no block."""
    there = F.filter(cleaned_blocks(), lambda b: (b["source"] != "description") | (b["text"] != ""))
    return F.transform(there, lambda b: F.struct(*[b[f].alias(f) for f in ("pos", "source", "text", "confidence")], b["text"].alias("t")))


def signals_to_evidence(signals: DataFrame) -> DataFrame:
    """A cleaned block for each bucket that isn't blank; a description gives one for each of its lines."""
    cleaned = signals.select("item_id", F.explode(cleaned_blocks()).alias("b")).select("item_id", "b.*")
    # a description line of nothing but tags leaves no block; other buckets keep an empty one
    return cleaned.filter((F.col("source") != "description") | (F.col("text") != "")).withColumn(
        "metadata", F.create_map().cast("map<string,string>"),
    )


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Rows alike in every column once, found by a hash of all that a row holds."""
    held = [F.to_json(F.col(c)) if kind in ("map", "struct", "array", "variant") else F.col(c).cast("string") for c, kind in _kinds(rows)]
    name = "_held"
    while name in rows.columns:
        name += "_"
    hashed = F.sha2(F.concat_ws("\x1f", *[F.coalesce(h, F.lit("\x01")) for h in held]), 256)
    return rows.withColumn(name, hashed).dropDuplicates([name]).drop(name)


def clean_own_blocks(rows: DataFrame, blocks: Column, into: str = "blocks") -> DataFrame:
    """rows with BLOCKS of those that aren't noise; of equal texts the one of highest confidence, the first of these on a tie.

    The array is sorted by text, and a block that follows an equal one goes.
    """
    noise = lambda b: (F.length(b["text"]) < 3) | b["text"].rlike(r"(?U)^\d+$")
    there = F.filter(F.coalesce(blocks, F.array()), lambda b: ~F.coalesce(noise(b), F.lit(True)))
    by_text = F.sort_array(
        F.transform(
            there, lambda b: F.struct(
                b["text"].alias("text"), F.coalesce(-b["confidence"], F.lit(float("inf"))).alias("less"), b["pos"].alias("pos"),
                b["source"].alias("source"), b["confidence"].alias("confidence"), b["t"].alias("t"),
            ),
        )
    )
    kept = [c for c in rows.columns if c != into]
    held = rows.select(*kept, by_text.alias("_by_text"))
    first = F.expr("filter(_by_text, (b, i) -> i = 0 OR element_at(_by_text, CAST(i AS int)).text <> b.text)")
    own = F.transform(first, lambda b: F.struct(*[b[f].alias(f) for f in ("pos", "source", "confidence", "t")]))
    return held.select(*kept, F.sort_array(own).cast(BLOCKS).alias(into))


def _kinds(rows: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.typeName()) for f in rows.schema.fields]


def drop_noise(evidence: DataFrame) -> DataFrame:
    """Without blocks of fewer than three characters or of digits alone."""
    return evidence.filter((F.length("text") >= 3) & ~F.col("text").rlike(r"(?U)^\d+$"))


def dedup_evidence(evidence: DataFrame, item: str = "item_id") -> DataFrame:
    """Of blocks of one item with equal texts, the one of highest confidence, the first of these on a tie."""
    rest = [c for c in evidence.columns if c not in (item, "text")]
    best = F.max_by(F.struct(*rest), F.struct("confidence", -F.col("pos"))).alias("best")
    return evidence.groupBy(item, "text").agg(best).select(item, "text", "best.*").select(*evidence.columns)


def clean_blocks(evidence: DataFrame) -> DataFrame:
    return dedup_evidence(drop_noise(evidence))


def build_package(captures: DataFrame) -> DataFrame:
    """captures (url and signals) with a deterministic item_id and the source site."""
    return captures.withColumns({"item_id": item_id(F.col("url")), "source_site": detect_site(F.col("url"))})


def own_packages(signals: DataFrame) -> DataFrame:
    """item_id and evidence_blocks, the stored form, of each row of signals within itself. A row without evidence has an empty array."""
    there = F.filter(cleaned_blocks(F.col("raw")), lambda b: (b["source"] != "description") | (b["text"] != ""))
    none = F.create_map().cast("map<string,string>").alias("metadata")
    stored = F.transform(there, lambda b: F.struct(*[b[f].alias(f) for f in ("source", "text", "block_type", "confidence")], none))
    return signals.select("item_id", raw_blocks().alias("raw")).select("item_id", stored.alias("evidence_blocks"))


def nest_evidence(evidence: DataFrame) -> DataFrame:
    """item_id and evidence_blocks in their order, of long evidence that is gathered by item: the stored form."""
    block = F.struct("pos", "source", "text", "block_type", "confidence", F.map_entries("metadata").alias("entries"))
    plain = lambda b: F.struct(b["source"].alias("source"), b["text"].alias("text"), b["block_type"].alias("block_type"), b["confidence"].alias("confidence"), F.map_from_entries(b["entries"]).alias("metadata"))
    return evidence.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(block)), plain).alias("evidence_blocks"))


def flatten_packages(packages: DataFrame) -> DataFrame:
    """The long evidence of stored packages, whose texts are taken as they are."""
    rows = packages.select("item_id", F.posexplode("evidence_blocks").alias("pos", "b"))
    return rows.select("item_id", "pos", "b.source", "b.block_type", "b.text", F.col("b.confidence").alias("confidence"), "b.metadata")


def stored_blocks() -> Column:
    """The array of a stored package's blocks; their texts are taken as they are, and normalised to extract from."""
    blocks = F.col("evidence_blocks")
    texts = _each_nfkc(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))))
    both = F.filter(F.arrays_zip(blocks.alias("b"), texts.alias("t")), lambda x: x["b"].isNotNull())
    return F.transform(
        both,
        lambda x, i: F.struct(
            i.cast("int").alias("pos"), x["b"]["source"].alias("source"), x["b"]["text"].alias("text"), x["b"]["confidence"].cast("double").alias("confidence"), norm_ws(x["t"]).alias("t")
        ),
    )


def priority(extractor: str, source: str = "source") -> Column:
    """A source's place in an extractor's order; unknown sources come last."""
    return F.expr(_priority(extractor, source))


def _priority(extractor: str, source: str = "source") -> str:
    places = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(PRIORITIES[extractor]))
    return f"CASE {source} {places} ELSE 99 END"


def ordered_blocks(extractor: str, blocks: Column | None = None) -> Column:
    """An item's blocks, or those of them given, in the order in which an extractor looks at them; `at` is its place in the array, from 0."""

    def keyed(b: Column, i: Column) -> Column:
        prio = F.lit(len(PRIORITIES[extractor]))
        for place, source in reversed(list(enumerate(PRIORITIES[extractor]))):
            prio = F.when(b["source"] == source, place).otherwise(prio)
        return F.struct(prio.alias("prio"), b["pos"].alias("pos"), i.alias("at"), *[b[f].alias(f) for f in ("source", "confidence", "t", "low")])

    return F.sort_array(F.transform(F.col("blocks") if blocks is None else blocks, keyed))


def first_block(blocks: Column | str, value, kind: str) -> Column:
    """The first value of a block that isn't null; blocks behind it aren't looked at."""
    return F.aggregate(blocks, F.lit(None).cast(kind), lambda found, b: F.when(found.isNotNull(), found).otherwise(value(b)))


def first_value(blocks: Column | str, value, kind: str) -> Column:
    """(value, confidence) of the first block with a value, which is worked out once for each block; null without one."""
    made = lambda b: F.struct(value(b).alias("value"), b["confidence"].alias("confidence"))
    none = F.lit(None).cast(f"struct<value:{kind},confidence:double>")
    got = F.aggregate(blocks, none, lambda found, b: F.when(found["value"].isNotNull(), found).otherwise(made(b)))
    return F.try_element_at(F.filter(F.array(got), lambda g: g["value"].isNotNull()), F.lit(1))


def joined_texts(blocks: Column | str) -> Column:
    """The texts of blocks, joined by line ends; without blocks an empty text."""
    return F.array_join(F.transform(blocks, lambda b: b["t"]), "\n")
