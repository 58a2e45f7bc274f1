"""The store of listings: an append-only log of changes, folded to one current row per URL.

A change has url, seq, op (upsert, status, ng, ok or delete), payload (the listing, for upserts), is_active and
status (for status), and reason (for ng and ok). `seq` grows with every batch and is unique per URL, so that
folding doesn't depend on the order of rows and a batch written twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rules import VERDICTS
from .stored import bitmap, maybe_in

#: The names of sites in views.
SITE_LABELS = {"yahoo_auctions": "ヤフオク", "yahoo_shopping": "Yahoo!ショッピング", "mercari": "メルカリ", "paypay_flea_market": "PayPayフリマ"}

_EMPTY = {
    "is_active": "boolean",
    "status": "struct<normalized_status:string,raw_status:string,evidence:string,confidence:double,warnings:array<string>>",
    "reason": "string",
}


def sequence_number(batch_id: int, order: Column) -> Column:
    """A number that grows with the batch, then with the order inside it; never a clock."""
    return F.lit(batch_id).cast("long") * (1 << 32) + order.cast("long")


def upsert_changes(decided: DataFrame, seq: Column) -> DataFrame:
    """Changes that insert or replace the listings of decided rows, which have url among their columns."""
    row = F.struct(*[c for c in decided.columns if c != "url"])
    return decided.select(
        "url", seq.alias("seq"), F.lit("upsert").alias("op"), row.alias("payload"),
        *[F.lit(None).cast(t).alias(c) for c, t in _EMPTY.items()]
    )


def status_changes(rechecked: DataFrame, seq: Column) -> DataFrame:
    """Changes of url's is_active and status struct only."""
    return rechecked.select("url", seq.alias("seq"), F.lit("status").alias("op"), "is_active", "status")


def mark_ng(urls: DataFrame, seq: Column, reason: Column | None = None) -> DataFrame:
    return urls.select("url", seq.alias("seq"), F.lit("ng").alias("op"), (F.lit("手動NG") if reason is None else reason).alias("reason"))


def mark_ok(urls: DataFrame, seq: Column, reason: Column | None = None) -> DataFrame:
    return urls.select("url", seq.alias("seq"), F.lit("ok").alias("op"), (F.lit("手動OK") if reason is None else reason).alias("reason"))


def delete_changes(urls: DataFrame, seq: Column) -> DataFrame:
    return urls.select("url", seq.alias("seq"), F.lit("delete").alias("op"))


def latest_per_url(rows: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """The row with the largest order of each key; null keys are a key like any other."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*rows.columns)


def fold_changes(changes: DataFrame) -> DataFrame:
    """The current listings: per URL its last upsert, with the later status and manual changes applied.

    is_active is true from the first insert on and only changes by status, whatever is upserted later.
    """
    seq = F.col("seq")
    of = lambda *ops: F.when(F.col("op").isin(*ops), seq)
    manual = F.collect_list(F.when(F.col("op").isin("ng", "ok"), F.struct("seq", "op", "reason")))
    folded = changes.groupBy("url").agg(
        F.max_by(F.struct("seq", "payload"), of("upsert")).alias("base"), F.max(of("delete")).alias("gone"),
        F.max_by(F.struct("seq", "is_active", "status"), of("status")).alias("told"),
        F.array_sort(manual).alias("manual"),
    )
    folded = folded.filter(F.col("base").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("base.seq"))))
    later = F.filter("manual", lambda m: m["seq"] > F.col("base.seq"))
    verdict = F.when(
        F.try_element_at(later, F.lit(-1))["op"] == "ng", "NO_MATCH",
    ).when(F.size(later) > 0, "MATCH").otherwise(F.col("base.payload.verdict"))
    reasons = F.aggregate(
        later, F.col("base.payload.blocking_reasons"), lambda got,
        m: F.when(
            m["op"] == "ok", F.array().cast("array<string>"),
        ).when(F.array_contains(got, m["reason"]), got).otherwise(F.array_prepend(got, m["reason"]))
    )
    told = F.col("told.seq") > F.coalesce(F.col("gone"), F.lit(-(1 << 62)))
    own = [c for c in changes.schema["payload"].dataType.names]
    changed = {
        "verdict": verdict,
        "blocking_reasons": reasons,
        "needs_recheck": F.when(F.size(later) > 0, F.lit(False)).otherwise(F.col("base.payload.needs_recheck")),
        "status": F.when(F.col("told.seq") > F.col("base.seq"), F.col("told.status")).otherwise(F.col("base.payload.status")),
    }
    columns = [changed.get(c, F.col(f"base.payload.{c}")).alias(c) for c in own]
    override = F.try_element_at(F.filter(later, lambda m: m["op"] == "ok"), F.lit(-1))["reason"]
    return folded.select(
        "url", *columns, F.when(told, F.col("told.is_active")).otherwise(F.lit(True)).alias("is_active"),
        override.alias("manual_override"),
    )


def upsert_listings(current: DataFrame, changed: DataFrame) -> DataFrame:
    """current without the URLs of changed, and changed: a new snapshot of tables that keep no log."""
    return current.join(changed.select("url").distinct().hint("merge"), "url", "left_anti").unionByName(changed)


def jst_day(day: str) -> tuple[Column, Column]:
    """The first moment, in UTC, of a calendar day in Japan (YYYY-MM-DD) and of the next."""
    first = F.to_utc_timestamp(F.lit(f"{day} 00:00:00").cast("timestamp"), "Asia/Tokyo")
    return first, first + F.expr("interval 1 day")


def delete_jst_day(listings: DataFrame, day: str, retrieved: str = "retrieved_at") -> DataFrame:
    """The listings without those retrieved on a calendar day in Japan; the session's time zone must be UTC."""
    first, end = jst_day(day)
    at = F.col(retrieved).cast("timestamp")
    return listings.filter(~F.coalesce((at >= first) & (at < end), F.lit(False)))


def recheck_join(stored: DataFrame, captured: DataFrame, looked_at: DataFrame | None = None) -> DataFrame:
    """Outcome of looking again at stored listings: url, action, verdict, is_active, status and reason.

    `looked_at`, the URLs that were captured again, keeps other listings out of the shuffle, by a bitmap of them; it is read
    apart from captured, so give it where the URLs are known without extracting anything.

    captured has url and the newly extracted status and price. A listing that had a buy-now price and has none
    now is no match any more, whatever its status.
    """
    from .rules import LOST_BUY_NOW

    new = captured.select("url", F.col("status").alias("new_status"), F.col("price").alias("new_price"))
    stored = stored if looked_at is None else maybe_in(stored, "url", bitmap(looked_at, "url"))
    joined = stored.join(new.hint("merge"), "url")
    lost = F.col("price")["buy_now_price_jpy"].isNotNull() & F.col("new_price")["buy_now_price_jpy"].isNull()
    return joined.select(
        "url", F.lit("status_rechecked").alias("action"), F.when(lost, "NO_MATCH").otherwise(F.col("verdict")).alias("verdict"),
        F.col("new_status")["normalized_status"].eqNullSafe("active").alias("is_active"),
        F.when(~lost, F.col("new_status")).alias("status"), F.when(lost, LOST_BUY_NOW).alias("reason"),
    )


# --- queries over listings ----------------------------------------------------------------------------------


def find_by_url(listings: DataFrame, url: str) -> DataFrame:
    return listings.filter(F.col("url") == url)


def find_by_id(listings: DataFrame, item_id: str) -> DataFrame:
    return listings.filter(F.col("item_id") == item_id)


def active_only(listings: DataFrame) -> DataFrame:
    return listings.filter("is_active")


def active_matches(listings: DataFrame) -> DataFrame:
    return active_only(listings.filter(F.col("verdict") == "MATCH"))


def top_listings(
    listings: DataFrame, verdict: str | None = None, sort: str = "score", limit: int = 100, only_active: bool = False,
) -> DataFrame:
    """The best or latest listings, at most 500; filters come first, ties go by URL."""
    rows = listings if verdict is None else listings.filter(F.col("verdict") == verdict)
    rows = active_only(rows) if only_active else rows
    order = F.col("retrieved_at" if sort == "recent" else "score").desc_nulls_last()
    return rows.orderBy(order, "url").limit(min(limit, 500))


def count_by_verdict(listings: DataFrame) -> DataFrame:
    return listings.filter(F.col("verdict").isNotNull()).groupBy("verdict").agg(F.count("*").alias("n"))


def verdict_stats(listings: DataFrame) -> DataFrame:
    """One row with the number of each verdict, zero where there is none."""
    return listings.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def report(listings: DataFrame) -> DataFrame:
    """Per site and verdict: listings, mean score, and the three most frequent blocking reasons. One pass over the listings.

    Each listing gives a row of its own and one for each reason; the former have no reason and carry the score.
    """
    reasons = F.filter(F.coalesce("blocking_reasons", F.array()), lambda r: r.isNotNull())
    each = F.concat(F.array(F.lit(None).cast("string")), reasons)
    rows = listings.select("source_site", "verdict", "score", F.explode(each).alias("reason"))
    group = ["source_site", "verdict"]
    counted = rows.groupBy(*group, "reason").agg(F.count("*").alias("k"), F.avg("score").alias("mean_score"))
    most = Window.partitionBy(*group).orderBy(F.col("reason").isNull(), F.col("k").desc(), "reason")
    top = counted.withColumn("r", F.row_number().over(most)).filter("r <= 3 or reason is null")
    named = F.collect_list(F.when(F.col("reason").isNotNull() & (F.col("r") <= 3), F.struct("r", "reason", "k")))
    out = top.groupBy(*group).agg(
        F.max(F.when(F.col("reason").isNull(), F.col("k"))).alias("n"), F.max(F.when(F.col("reason").isNull(), F.col("mean_score"))).alias("mean_score"),
        F.transform(F.array_sort(named), lambda x: F.struct(x["reason"].alias("reason"), x["k"].alias("n"))).alias("named"),
    )
    return out.select(*group, "n", "mean_score", F.when(F.size("named") > 0, F.col("named")).alias("top_reasons"))


def listing_view(listings: DataFrame) -> DataFrame:
    """What a list of offers shows of each."""
    labels = F.create_map(*[F.lit(x) for pair in SITE_LABELS.items() for x in pair])
    price, size = F.col("price"), F.col("size")
    return listings.select(
        F.col("item_id").alias("id"), "url", "source_site",
        F.coalesce(F.try_element_at(labels, F.col("source_site")), F.lit("サイト")).alias("source_label"),
        F.coalesce(F.col("title_text"), F.lit("")).alias("title"),
        F.coalesce(F.nullif(price["buy_now_price_jpy"], F.lit(0)), price["current_price_jpy"]).alias("price_jpy"),
        "score", "verdict", "is_active", "needs_recheck", F.try_element_at("image_urls", F.lit(1)).alias("thumbnail"),
        F.col("status")["normalized_status"].alias("normalized_status"),
        F.col("style")["button_count"].alias("button_count"), size["jacket"]["shoulder_cm"]["value"].alias("jacket_shoulder_cm"),
        size["jacket"]["chest_width_cm"]["value"].alias("jacket_chest_cm"),
        size["pants"]["waist_flat_cm"]["value"].alias("pants_waist_cm"), F.col("reasons").alias("non_blocking_reasons"),
        "blocking_reasons", price["buy_now_price_jpy"].alias("buy_now_price_jpy"),
        price["listing_type"].alias("listing_type"), F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("retrieved_at"),
    )


# --- snapshots ----------------------------------------------------------------------------------------------


def write_snapshot(listings: DataFrame, path: str, version: int) -> None:
    """Write a whole snapshot beside the older ones, then the pointer that makes it the current one."""
    listings.write.mode("overwrite").parquet(f"{path}/version={version}")
    listings.sparkSession.range(1).select(F.lit(version).alias("version")).write.mode("append").json(f"{path}/pointer")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.schema("version long").json(f"{path}/pointer").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={version}")
