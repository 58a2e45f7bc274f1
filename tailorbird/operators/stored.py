"""Listings kept as files: point look-ups read one bucket, small changes rewrite only the partitions that they touch.

Rows lie in partitions by bucket and by calendar day in Japan. A bucket comes from the item id, which is a hash of the URL,
so that a URL and an id both name their bucket; within a partition rows are sorted by URL, and files carry column
statistics and Bloom filters of URL and id. A change rewrites the partitions that hold, or will hold, its URLs: the new rows
are written beside the store first and then put in place by a dynamic partition overwrite, so a run that was broken off is
simply repeated. One writer at a time.

Null URLs are no listings and are left out; of rows with one URL the last by retrieved_at stays, of equal times the one
with the larger hash of its columns. Rows without a time lie under the day `none`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_path
from .evidence import item_id

BITS = 1 << 21
LAYOUT = ("bucket", "day")


def bucket_of(own_id: Column, buckets: int) -> Column:
    """The bucket of an item id in hex."""
    return F.pmod(F.conv(F.substring(own_id, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def laid_out(listings: DataFrame, buckets: int) -> DataFrame:
    """listings (url and any others) with item_id, bucket and day, each URL once."""
    rest = [c for c in listings.columns if c not in (*LAYOUT, "item_id")]
    rows = listings.filter("url is not null").select(*rest, item_id(F.col("url")).alias("item_id"))
    at = F.col("retrieved_at").cast("timestamp")
    day = F.coalesce(F.date_format(F.from_utc_timestamp(at, "Asia/Tokyo"), "yyyy-MM-dd"), F.lit("none"))
    last = Window.partitionBy("url").orderBy(F.desc_nulls_last("retrieved_at"), F.xxhash64(*rest).desc())
    rows = rows.withColumn("_place", F.row_number().over(last)).filter("_place = 1").drop("_place")
    return rows.withColumns({"bucket": bucket_of(F.col("item_id"), buckets), "day": day})


def _put(rows: DataFrame, path: str) -> None:
    dealt = rows.repartition("bucket", "day").sortWithinPartitions("bucket", "day", "url")
    writer = dealt.write.mode("overwrite").partitionBy(*LAYOUT).option("partitionOverwriteMode", "dynamic")
    for column in ("url", "item_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(f"{path}/listings")


def write_store(listings: DataFrame, path: str, buckets: int) -> None:
    """A new store. The number of buckets stays; some hundred megabytes a bucket and day are a good size."""
    _put(laid_out(listings, buckets), path)
    listings.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(f"{path}/layout")


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.schema("buckets int").json(f"{path}/layout").first()[0]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All listings, with bucket and day. The table is named anew at each call, as its files change."""
    return spark.read.option("basePath", f"{path}/listings").parquet(f"{path}/listings").withColumn("day", F.col("day").cast("string"))


def find_stored(spark: SparkSession, path: str, url: str | None = None, own_id: str | None = None) -> DataFrame:
    """The listing of a URL or of an item id: one bucket, and of it the row groups whose statistics and Bloom filters allow for it."""
    import hashlib

    if url is not None:
        own_id = hashlib.sha256(url.encode()).hexdigest()
    bucket = int(own_id[:8], 16) % _buckets(spark, path)
    rows = read_store(spark, path).filter((F.col("bucket") == bucket) & (F.col("item_id") == own_id))
    return (rows if url is None else rows.filter(F.col("url") == url)).drop(*LAYOUT)


def _there(partitions: Iterable[tuple[int, str]]) -> Column:
    """Whether a row lies in one of the partitions, as a filter that prunes."""
    days: dict[str, list[int]] = {}
    for bucket, day in partitions:
        days.setdefault(day, []).append(bucket)
    fits = F.lit(False)
    for day, buckets in sorted(days.items()):
        fits = fits | ((F.col("day") == day) & F.col("bucket").isin(buckets))
    return fits


def _drop(spark: SparkSession, path: str, partitions: Iterable[tuple[int, str]]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for bucket, day in partitions:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/listings/bucket={bucket}/day={day}")
        folder.getFileSystem(conf).delete(folder, True)


def upsert_stored(spark: SparkSession, path: str, changed: DataFrame) -> tuple[int, int]:
    """Put changed listings in place of those of their URLs. Gives the numbers of partitions that were written and that fell away.

    Of the store only URLs are read, and only in the buckets of the batch, to find the partitions that it touches.
    """
    new_path = shared_path(spark, "store-new")
    laid_out(changed, _buckets(spark, path)).write.parquet(new_path)
    new = spark.read.parquet(new_path)
    to = {(r["bucket"], r["day"]) for r in new.select(*LAYOUT).distinct().collect()}
    if not to:
        return 0, 0
    old = read_store(spark, path).filter(F.col("bucket").isin(sorted({b for b, _ in to})))
    held = maybe_in(old.select("url", *LAYOUT), "url", bitmap(new, "url")).join(new.select("url").hint("merge"), "url", "left_semi")
    touched = {(r["bucket"], r["day"]) for r in held.select(*LAYOUT).distinct().collect()} | to
    kept = old.filter(_there(touched)).join(new.select("url").hint("merge"), "url", "left_anti")
    merged_path = shared_path(spark, "store-merged")
    kept.unionByName(new.withColumn("day", F.col("day").cast("string")), allowMissingColumns=True).write.parquet(merged_path)
    merged = spark.read.parquet(merged_path)
    left = {(r["bucket"], r["day"]) for r in merged.select(*LAYOUT).distinct().collect()}
    _put(merged, path)
    _drop(spark, path, touched - left)  # an overwrite leaves partitions alone that get no rows
    return len(left), len(touched - left)


def delete_stored_day(spark: SparkSession, path: str, day: str) -> int:
    """Take out the listings retrieved on a calendar day in Japan; how many they were. Whole partitions go, no row is read."""
    rows = read_store(spark, path).filter(F.col("day") == day)
    counted = rows.groupBy("bucket").count().collect()
    _drop(spark, path, [(r["bucket"], day) for r in counted])
    return sum(r["count"] for r in counted)


# --- joins of a few URLs with many --------------------------------------------------------------------------


def _bit(key: Column) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(key), F.lit(BITS))
    return F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")


def bitmap(rows: DataFrame, key: str) -> DataFrame:
    """Which of two million bits the hashes of a column's values set, as at most 32,768 words (half a megabyte)."""
    word, bit = _bit(F.col(key))
    marks = rows.filter(F.col(key).isNotNull()).select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    return marks.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def maybe_in(rows: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """rows without most of those whose key isn't among the marked ones; none that is gets lost. The marks are small whatever they came from."""
    word, bit = _bit(F.col(key))
    near = rows.withColumns({"_word": word, "_place": bit}).join(F.broadcast(marks), "_word")
    return near.filter(F.getbit("_bits", "_place") == 1).select(*rows.columns)
