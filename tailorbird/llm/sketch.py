"""Document fingerprints that keep every shingle hash below a fixed share of all hashes.

A sketch holds those hashes of a text's five-word shingles that lie in the lowest `share` of the 64-bit range. As the
threshold is the same for every text, the sketch of two texts together is the union of their sketches, and of the
hashes of a short text that are kept, those that a long text has are kept there as well: the share of one sketch that
is found in another estimates how much of the one text the other contains, however unequal their lengths are.

Everything here is DataFrame functions. Words are runs of no white space, in lower case; a character of a script
without spaces is a word. A text of fewer words than a shingle has is one shingle; one without words has none.

Cases: null texts are empty; texts alike but for case and white space have one fingerprint; repeated rows give repeated rows;
a null id comes before all others in the order of ids; ids that repeat with other texts follow each other by a hash of
their text; other columns are ignored; of an empty table nothing comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WIDTH = 5
SHARE = 1 / 8

_LONE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_SPACE = " \t\n\x0b\x0c\r"


def _below(share: float):
    """Whether a hash lies in the lowest share of all."""
    return lambda h: h <= F.lit(int(share * (1 << 64)) - 1 - (1 << 63))


def words_of(text: Column) -> Column:
    """The words of a text; never null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    spread = F.when((F.octet_length(low) > F.char_length(low)) & low.rlike(_LONE), F.regexp_replace(low, f"({_LONE})", " $1 ")).otherwise(low)
    bare = F.btrim(spread, F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))


def with_sketch(rows: DataFrame, text: str, into: str, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """rows with a column `into` of the sketch of column `text`: whole (a hash of all words), shingles (their number) and hashes."""
    kept = [c for c in rows.columns if c != into]
    step = rows.select(*kept, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("_words"))
    count = F.size("_words")
    step = step.select(*kept, "_words", F.when(count >= width, count - width + 1).otherwise(F.least(count, F.lit(1))).alias("_n"))
    runs = F.arrays_zip(*[F.slice("_words", k + 1, F.col("_n")).alias(f"w{k}") for k in range(width)])
    hashes = F.when(
        F.size("_words") >= width, F.transform(runs, lambda r: F.xxhash64(*[r[f"w{k}"] for k in range(width)])),
    ).otherwise(F.transform(F.slice("_words", 1, F.col("_n")), lambda _: F.xxhash64("_words")))
    low = F.sort_array(F.array_distinct(F.filter(hashes, _below(share))))
    return step.select(*kept, F.struct(F.xxhash64("_words").alias("whole"), F.col("_n").alias("shingles"), low.alias("hashes")).alias(into))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: the hash of all words, the number of shingles, and the hashes that are kept, in hex."""
    hexed = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat_ws(":", hexed(sketch["whole"]), sketch["shingles"].cast("string"), F.array_join(F.transform(sketch["hashes"], hexed), ""))


def containment(one: Column, other: Column) -> Column:
    """The estimated share of one text's shingles that the other has; without a hash to go by, whether all words are the same."""
    same = (one["whole"] == other["whole"]) & (one["shingles"] == other["shingles"])
    found = F.size(F.array_intersect(one["hashes"], other["hashes"]))
    return F.when(same, 1.0).when(F.size(one["hashes"]) == 0, 0.0).otherwise(found / F.size(one["hashes"]))


def merged(sketches: DataFrame, by: str, sketch: str = "sketch", share: float = SHARE / 64) -> DataFrame:
    """The sketch of all texts of each value of `by` together, at a coarser share, so that a row holds a bounded part of a group."""
    rows = sketches.select(by, F.col(sketch)["shingles"].alias("_n"), F.filter(F.col(sketch)["hashes"], _below(share)).alias("_kept"))
    sums = written(rows.groupBy(by).agg(F.sum("_n").alias("shingles")), "sketch-sums")
    kept = rows.select(by, F.explode("_kept").alias("_h")).distinct().groupBy(by).agg(F.sort_array(F.collect_list("_h")).alias("hashes"))
    same = sums[by].eqNullSafe(kept[by])
    none = F.array().cast("array<bigint>")
    return sums.join(kept.hint("merge"), same, "left").select(
        sums[by], F.struct(F.lit(0).cast("long").alias("whole"), "shingles", F.coalesce("hashes", none).alias("hashes")).alias(sketch)
    )


def followers(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, th (a hash of the text), n (code points), and next_id and next_th of the document behind it; whether rows repeat.

    Ids are dealt out by ranges and looked at within their range; only the first id of each range goes through the driver.
    """
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", F.xxhash64(text).alias("th"), F.char_length(text).alias("n")).groupBy("doc_id", "th", "n").count()
    keys = written(keys.repartitionByRange("doc_id", "th").withColumn("part", F.spark_partition_id()), "sketch-order")
    firsts = keys.groupBy("part").agg(F.min(F.struct("doc_id", "th")).alias("f"), F.max("count").alias("most")).orderBy("part").collect()
    ends = [(a["part"], *b["f"]) for a, b in zip(firsts, [*firsts[1:], *firsts[:1]])]
    behind = keys.sparkSession.createDataFrame(ends, "part int, first_id long, first_th long")
    row = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "th")
    led = keys.select("*", F.lead(F.struct("doc_id", "th")).over(row).alias("f")).join(F.broadcast(behind), "part")
    there = F.col("f").isNotNull()
    led = led.select(
        "doc_id", "th", "n", F.when(there, F.col("f.doc_id")).otherwise(F.col("first_id")).alias("next_id"),
        F.when(there, F.col("f.th")).otherwise(F.col("first_th")).alias("next_th"),
    )
    return written(led, "sketch-next"), any(f["most"] > 1 for f in firsts)


def edited_fingerprints(docs: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """Each document, its text with the last half replaced by the beginning of the next document's, and the sketches of both.

    Gives doc_id, n_chars, edited, sketch, edited_sketch and next_sketch. A document's text is dealt out once by id; to
    the document before it go its sketch and only as much of its text as is needed there.
    """
    order, repeats = followers(docs)
    text = F.coalesce("text", F.lit(""))
    whole = with_sketch(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th")), "text", "sketch", width, share)
    # one row of each repeated one says what follows; the order was written, so its size is known. Names of `whole` stay on
    # both sides of the second join, so that Spark deals it out once for the two
    told = whole.dropDuplicates(["doc_id", "th"]) if repeats else whole
    order = order.withColumnsRenamed({"doc_id": "o_id", "th": "o_th"})
    half = F.floor(F.col("n") / 2).cast("int")
    after = told.join(order, F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("th") == F.col("next_th"))).select(
        "o_id", "o_th", "n", F.substring("text", F.lit(1), half).alias("more"), F.col("sketch").alias("next_sketch"),
    )
    both = whole.join(after.hint("merge"), F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("th") == F.col("o_th")))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.col("more"))
    both = both.select("doc_id", F.col("n").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return with_sketch(both, "edited", "edited_sketch", width, share)
