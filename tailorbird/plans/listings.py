"""Listings derived from the `part` table: their texts hold numbers that follow from the key alone.

The given tables hold no listings. Each part becomes one page's signals, so that every extractor and rule has
work that grows with the table, and the expected answer can be computed from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WIDE = "０１２３４５６７８９"


def _choose(k: Column, n: int, *texts) -> Column:
    out = None
    for i, text in enumerate(texts):
        value = text if isinstance(text, Column) else F.lit(text)
        out = F.when(k % n == i, value) if out is None else out.when(k % n == i, value)
    return out


def _say(label: str, number: Column, unit: str = "cm") -> Column:
    return F.concat(F.lit(label), number.cast("string"), F.lit(unit))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given table, which is one small file: its keys are dealt out over the cores before wide texts are made of them."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").repartition(spark.sparkContext.defaultParallelism)


def listing_signals(part: DataFrame, changed: bool = False) -> DataFrame:
    """url, the text buckets, image_urls and retrieved_at of a listing per part; `changed` loses some buy-now prices."""
    k = F.col("p_partkey")
    price = 5000 + k * 37 % 40000
    yen = lambda label, value: F.concat(F.lit(label), F.format_string("%,d", value), F.lit("円"))
    priced = _choose(
        k, 4, yen("現在 ", price), yen("即決 ", price), F.concat_ws(" ", yen("現在 ", price), yen("即決 ", price + 1000)),
        yen("販売価格：", price),
    )
    if changed:
        priced = F.when(k % 3 == 0, yen("現在 ", price)).otherwise(priced)
    chest = F.when(k % 13 == 0, F.lit(55)).otherwise(51 + k % 3)
    sleeve = F.when(k % 17 == 0, F.lit(58)).when(k % 19 == 0, F.lit(66)).otherwise(60 + k % 5)
    lines = [
        _say("肩幅：", F.when(k % 11 == 0, F.lit(40)).otherwise(43 + k % 3)),
        F.when(k % 5 == 0, _say("胸囲 ", 2 * chest)).otherwise(_say("身幅：", chest)), _say("袖丈＝", sleeve),
        _choose(k, 4, "", _say("ウエスト平置き ", 42 + k % 5), _say("ウエスト：", 40 + k % 30), _say("ウエスト周り ", 80 + k % 15)),
        _say("股下 約", F.when(k % 23 == 0, 66 + k % 8).otherwise(74 + k % 4)),
        _choose(k, 7, "素材：ウール100%", "ウール80% モヘア20%", "ポリエステル65% ウール35%", "コットン素材", "", "モヘア60% ウール40%", "表地：ウール 裏地：ポリエステル100%"),
        _choose(k, 4, "2つボタン シングル", "三つボタン", "ダブルブレスト 金ボタン", "1ボタン"), F.when(k % 6 == 0, "裾ダブル").otherwise("裾シングル"),
        _choose(k, 6, "美品 汚れなし 穴なし", "未使用", "ひどい汚れ", "穴あり", "やや使用感 シミあり", ""),
    ]
    text = F.concat_ws("\n", *lines)
    text = F.when(k % 3 == 0, F.translate(text, "0123456789", _WIDE)).otherwise(text)
    site = _choose(
        k, 3, "https://auctions.yahoo.co.jp/jp/auction/x", "https://jp.mercari.com/item/m",
        "https://paypayfleamarket.yahoo.co.jp/item/z",
    )
    return part.select(
        F.concat(site, k.cast("string")).alias("url"), F.concat(F.lit("紺スーツ 品番"), k.cast("string")).alias("title_text"),
        priced.alias("price_text"),
        _choose(k, 5, "残り 3時間", "出品中です", "落札済み", "終了しました", "販売中です").alias("status_text"), text.alias("description_text"),
        F.lit("").alias("all_text"),
        F.lit("").alias("specs_text"), F.lit("").alias("brand_text"), F.lit("メンズ スーツ").alias("category_text"),
        F.array(F.concat(F.lit("https://img/"), k.cast("string"))).alias("image_urls"),
        (F.lit("2024-06-01").cast("timestamp") - F.make_dt_interval(hours=(k % 240).cast("int"))).alias("retrieved_at"),
        k.alias("p_partkey"),
    )


#: The same numbers in SQL: one row per listing with what the extractors and rules should find.
EXPECTED_SQL = """
base AS (SELECT p_partkey AS k, 5000 + p_partkey * 37 % 40000 AS p FROM part),
parsed AS (
  SELECT k, p,
    CAST(CASE WHEN k % 11 = 0 THEN 40 ELSE 43 + k % 3 END AS DOUBLE) AS shoulder, CAST(CASE WHEN k % 13 = 0 THEN 55 ELSE 51 + k % 3 END AS DOUBLE) AS chest,
    CAST(CASE WHEN k % 17 = 0 THEN 58 WHEN k % 19 = 0 THEN 66 ELSE 60 + k % 5 END AS DOUBLE) AS sleeve,
    CASE WHEN k % 4 = 1 THEN CAST(42 + k % 5 AS DOUBLE) WHEN k % 4 = 2 AND 40 + k % 30 <= 60 THEN CAST(40 + k % 30 AS DOUBLE) END AS waist_flat,
    CASE WHEN k % 4 = 3 THEN CAST(80 + k % 15 AS DOUBLE) WHEN k % 4 = 2 AND 40 + k % 30 > 60 THEN CAST(40 + k % 30 AS DOUBLE) END AS waist_girth,
    CAST(CASE WHEN k % 23 = 0 THEN 66 + k % 8 ELSE 74 + k % 4 END AS DOUBLE) AS inseam, CASE WHEN k % 6 = 0 THEN 'double' ELSE 'single' END AS hem,
    CASE k % 4 WHEN 0 THEN 'auction' WHEN 1 THEN 'buy_now_only' WHEN 2 THEN 'auction' ELSE 'fixed_price' END AS listing_type,
    CASE WHEN k % 4 <> 1 THEN CAST(p AS INTEGER) END AS current_price, CASE k % 4 WHEN 1 THEN CAST(p AS INTEGER) WHEN 2 THEN CAST(p + 1000 AS INTEGER) END AS buy_now,
    CASE k % 5 WHEN 2 THEN 'sold' WHEN 3 THEN 'ended' ELSE 'active' END AS state,
    CASE k % 7 WHEN 0 THEN 'wool=100' WHEN 1 THEN 'wool=80,mohair=20' WHEN 2 THEN 'wool=35,polyester=65' WHEN 3 THEN 'cotton=100' WHEN 4 THEN '' WHEN 5 THEN 'wool=40,mohair=60' ELSE 'wool=100' END AS outer_fibers,
    CASE WHEN k % 7 = 6 THEN 'polyester=100' ELSE '' END AS lining_fibers,
    CASE WHEN k % 4 = 2 THEN 'double' WHEN k % 4 = 0 OR k % 6 <> 0 THEN 'single' END AS button_type,
    CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 3 THEN 1 END AS button_count, CASE WHEN k % 4 = 2 THEN 'gold' END AS button_color,
    CASE k % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'S' WHEN 4 THEN 'B' END AS grade,
    CASE k % 6 WHEN 0 THEN FALSE WHEN 2 THEN TRUE WHEN 4 THEN TRUE END AS has_stain, CASE k % 6 WHEN 0 THEN FALSE WHEN 3 THEN TRUE END AS has_hole
  FROM base
), ruled AS (
  SELECT *,
    list_filter([
      CASE WHEN k % 4 = 0 THEN '即決価格が設定されていないためNG (オークション形式)' END,
      CASE WHEN coalesce(buy_now, current_price) > 30000 THEN '価格 ' || format('{:,}', coalesce(buy_now, current_price)) || '円 が上限 30,000円 を超えています' END,
      CASE WHEN state <> 'active' THEN '販売状態が active でない: ' || state END,
      CASE WHEN shoulder < 43 OR shoulder > 45 THEN '肩幅 ' || shoulder || 'cm が範囲外 (43.0–45.0cm)' END,
      CASE WHEN chest < 51 OR chest > 53 THEN '身幅 ' || chest || 'cm が範囲外 (51.0–53.0cm)' END,
      CASE WHEN sleeve < 60 THEN '袖丈 ' || sleeve || 'cm が範囲外 (60.0–64.0cm)' END,
      CASE WHEN waist_flat < 42 OR waist_flat > 45 THEN 'ウエスト平置き ' || waist_flat || 'cm が範囲外 (42.0–45.0cm)'
           WHEN waist_girth < 84 OR waist_girth > 90 THEN 'ウエスト周り ' || waist_girth || 'cm が範囲外 (84.0–90.0cm)' END,
      CASE WHEN inseam <= 70 THEN '股下 ' || inseam || 'cm は絶対NG (70cm以下)' WHEN hem = 'double' AND inseam < 71 THEN '股下 ' || inseam || 'cm が最低値 71.0cm を下回っています (裾ダブル許容)'
           WHEN hem = 'single' AND inseam < 74 THEN '股下 ' || inseam || 'cm が最低値 74.0cm を下回っています' END,
      CASE WHEN k % 7 = 2 THEN 'NG素材: polyester (表地ポリエステルはNG)' WHEN k % 7 = 3 THEN 'NG素材: cotton (コットンはNG)' END,
      CASE WHEN button_type = 'double' THEN 'NG: ダブルブレスト' END, CASE WHEN button_count = 1 THEN 'NG: 1ボタンジャケット' END, CASE WHEN button_color = 'gold' THEN 'NG: 金ボタン' END,
      CASE WHEN k % 6 = 2 THEN 'NG: ひどい汚れあり' END, CASE WHEN has_hole THEN 'NG: 穴・破れあり' END
    ], lambda x: x IS NOT NULL) AS blocking,
    list_filter([
      CASE WHEN sleeve > 64 THEN '袖丈 ' || sleeve || 'cm が範囲外 (60.0–64.0cm)' END, CASE WHEN k % 4 = 0 THEN 'ウエストが不明' END, CASE WHEN k % 7 = 4 THEN '素材不明 (要レビュー)' END
    ], lambda x: x IS NOT NULL) AS notes,
    5 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS size_unknown,
    CASE k % 7 WHEN 4 THEN 2 WHEN 6 THEN 0 ELSE 1 END + CASE WHEN button_type IS NULL THEN 1 ELSE 0 END + 1 + CASE k % 6 WHEN 0 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 3 ELSE 2 END AS other_unknown
  FROM parsed
), decided AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(1.0::DOUBLE - 0.4::DOUBLE * len(blocking) - 0.05::DOUBLE * len(notes) - 0.03::DOUBLE * size_unknown
      + CASE k % 7 WHEN 5 THEN 0.15::DOUBLE WHEN 1 THEN 0.05::DOUBLE * 20 / 60 ELSE 0::DOUBLE END + CASE WHEN k % 7 IN (0, 1, 6) THEN 0.05::DOUBLE ELSE 0::DOUBLE END, 3))) AS score,
    CASE k % 3 WHEN 0 THEN 'https://auctions.yahoo.co.jp/jp/auction/x' WHEN 1 THEN 'https://jp.mercari.com/item/m' ELSE 'https://paypayfleamarket.yahoo.co.jp/item/z' END || k AS url,
    CASE k % 3 WHEN 0 THEN 'yahoo_auctions' WHEN 1 THEN 'mercari' ELSE 'paypay_flea_market' END AS source_site
  FROM ruled
), listed AS (
  SELECT *, CASE WHEN len(blocking) > 0 THEN 'NO_MATCH' WHEN size_unknown + other_unknown >= 6 OR score < 0.5 THEN 'REVIEW' ELSE 'MATCH' END AS verdict FROM decided
)
"""
