"""Captured pages and further listings derived from the `part` table, as in `listings`: all follows from the key.

`listing_captures` gives whole pages of four sites, with the JSON that each site embeds, and without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = F.col
BUCKETS = ("title_text", "price_text", "status_text", "description_text", "all_text", "specs_text", "brand_text", "category_text")


def choose(n: int, *values, by: Column | None = None) -> Column:
    """The value whose place is the key modulo n; null beyond the last."""
    k = F.col("p_partkey") if by is None else by
    out = F.lit(None)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(k % n == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _say(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def signals_of(part: DataFrame, **buckets: Column) -> DataFrame:
    """Signals with the given buckets, the others empty."""
    texts = [F.coalesce(buckets.get(b, F.lit("")), F.lit("")).alias(b) for b in BUCKETS]
    return part.select(
        F.col("p_partkey").alias("k"), _say("https://auctions.yahoo.co.jp/jp/auction/x", F.col("p_partkey")).alias("url"),
        *texts
    )


def listing_captures(part: DataFrame, changed: bool = False) -> DataFrame:
    """url, html and retrieved_at of a page per part; `changed` takes the buy-now price from some."""
    k = F.col("p_partkey")
    price, title, brand = 5000 + k * 37 % 30000, _say("紺スーツ 品番", k), _say("B", k % 7)
    closed, paid = k % 7 == 0, F.when(k % 2 == 0, "seller").otherwise("buyer")
    at_once = F.when((k % 4 == 3) | (F.lit(changed) & (k % 3 == 0)), 0).otherwise(price)
    first = _say("肩幅 ", F.when(k % 11 == 0, 40).otherwise(43 + k % 3), "cm 身幅 52cm 着丈 70cm 袖丈 62cm")
    second = _say(
        "ウエスト平置き 43cm 股上 25cm 股下 75cm 裾幅 ", F.when(k % 13 == 0, 17).otherwise(19), "cm ワタリ ",
        F.when(k % 17 == 0, 28).otherwise(30), "cm 総丈 100cm 裾シングル",
    )
    rest = [F.when(k % 5 != 4, "表地：ウール100% 裏地：ポリエステル100%"), F.lit("三つボタン シングル"), F.when(k % 5 < 3, "美品 汚れなし 穴なし")]
    text = F.concat_ws("\n", first, second, *rest)
    tagged = lambda tag, *lines: F.concat_ws("", *[F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")) for x in lines])
    name = lambda value: F.struct(F.lit(value).alias("name"))

    def nested(item: Column, *path: str) -> Column:
        for key in reversed(path):
            item = F.struct(item.alias(key))
        return F.to_json(item)

    auction = F.struct(
        title.alias("title"), _say("<p>", F.replace(text, F.lit("\n"), F.lit("<br>")), "</p>").alias("descriptionHtml"),
        price.alias("price"), at_once.alias("bidorbuy"), F.lit(0).alias("bids"),
        paid.alias("chargeForShipping"), F.when(closed, "close").otherwise("open").alias("status"),
        (k % 50 * 1800).alias("leftTime"), F.lit("良い").alias("conditionName"),
    )
    mercari = F.struct(
        _say("m", k).alias("id"), title.alias("name"), text.alias("description"), price.alias("price"),
        F.struct(F.when(k % 2 == 0, "出品者負担").otherwise("着払い").alias("name")).alias("shipping_payer"),
        F.when(closed, "sold_out").otherwise("on_sale").alias("status"),
        F.array(F.struct(F.struct(_say("L", k).alias("large")).alias("image_urls"))).alias("photos"),
        F.array(name("メンズ"), name("スーツ")).alias("categories"), F.struct(brand.alias("name")).alias("brand"),
        name("良い").alias("item_condition"),
    )
    flea = F.struct(
        title.alias("title"), text.alias("description"), price.alias("price"),
        F.when(closed, "SOLD").otherwise("OPEN").alias("status"), F.array(F.struct(_say("f", k).alias("url"))).alias("images"),
        F.array(name("メンズ"), name("スーツ")).alias("categoryList"), F.struct(brand.alias("name")).alias("brand"),
        F.struct(F.lit("良い").alias("text")).alias("condition"),
    )
    shop = F.struct(
        title.alias("name"), tagged("p", first, second).alias("freeSpace1"), F.concat_ws("\n", *rest).alias("freeSpace2"),
        brand.alias("brandName"), F.lit("M").alias("sizeName"),
        F.struct(price.alias("value")).alias("price"), F.when(closed, "outOfStock").otherwise("inStock").alias("availability"),
        F.array(F.struct(_say("s", k).alias("url"))).alias("images"),
        F.array(name("メンズ"), name("スーツ")).alias("categoryPath"), F.struct(F.lit("良い").alias("label")).alias("condition"),
    )
    data = choose(
        6,
        nested(auction, "props", "pageProps", "initialState", "item", "detail", "item"),
        F.when(
            k % 4 == 1, nested(mercari, "props", "pageProps", "item"),
        ).otherwise(nested(mercari, "props", "pageProps", "serverData", "item")),
        nested(flea, "props", "initialState", "itemsState", "items", "item"),
        nested(
            F.array(F.struct(F.struct(F.struct(F.struct(shop.alias("item")).alias("itemData")).alias("data")).alias("state"))),
            "props", "pageProps", "dehydratedState", "queries",
        ),
        F.lit(None),
        F.lit('{"props": oops'),
    )
    script = F.coalesce(_say('<script id="__NEXT_DATA__" type="application/json">', data, "</script>"), F.lit(""))
    picture = choose(
        6, "https://auctions.c.yimg.jp/i/", "https://other/", "https://other/", "https://other/",
        "https://static.mercdn.net/", "https://other/",
    )
    plain = F.when(
        k % 6 == 4,
        _say(
            '<span class="Price__x">¥', F.format_string("%,d", price), "</span>", tagged("p", first, second, *rest),
            "<p>送料込み</p>", F.when(closed, "<b>売り切れ</b>").otherwise(""),
        ),
    )
    html = _say(
        "<html><head><title>t</title></head><body><h1> ", title, " </h1>", F.coalesce(plain, F.lit("")),
        '<img alt="x" src="', picture, k, '.jpg">', script, "</body></html>",
    )
    site = choose(
        6, "https://auctions.yahoo.co.jp/jp/auction/x", "https://jp.mercari.com/item/m",
        "https://paypayfleamarket.yahoo.co.jp/item/z", "https://store.shopping.yahoo.co.jp/shop/",
        "https://jp.mercari.com/item/m", "https://auctions.yahoo.co.jp/jp/auction/x",
    )
    return part.select(
        _say(site, k).alias("url"), html.alias("html"),
        (F.lit("2024-06-01").cast("timestamp") - F.make_dt_interval(hours=(k % 240).cast("int"))).alias("retrieved_at"),
    )


def variant_captures(part: DataFrame) -> DataFrame:
    """Pages in the rarer forms of three sites: other places of pictures, prices, categories and states, and no data at all."""
    k, text = F.col("p_partkey"), "身幅 52cm 着丈 70cm"
    price, title = 5000 + k * 37 % 30000, _say("紺スーツ 品番", k)
    named = lambda key: ('"', key, '":"', title, '",')
    data = choose(
        6,
        _say(
            '{"props":{"pageProps":{"item":{"id":"m', k, '",', *named("name"), '"description":"', text, '","price":', price,
            ',"photos":[{"image_urls":{"medium":"M', k, '"}},{"image_urls":{"small":"S', k, '"}},{"image_urls":"U', k, '"}],',
            '"item_category":{"name":"スーツ","parent":{"name":"メンズ"}},"condition":{"name":"良い"},"status":"trading"}}}}',
        ),
        _say(
            '{"props":{"pageProps":{"serverData":{"item":{"id":"m', k, '",', *named("name"), '"description":"', text,
            '","price":0,"thumbnails":["T', k, '"],"status":"on_sale"}}}}}',
        ),
        _say(
            '{"props":{"initialState":{"itemsState":{"items":{"item":{', *named("title"), '"description":"', text, '","price":', price,
            ',"status":"OPEN","isPurchased":', (k % 4 == 2), "}}}}}}",
        ),
        _say(
            '{"props":{"pageProps":{"itemData":{"item":{', *named("title"), '"information":"', text, '","price":', price,
            ',"inStock":', (k % 2 == 1) & (k % 4 == 3), ',"sellerCategoryPathList":["紳士","スーツ"],"condition":"中古"}}}}}',
        ),
    )
    script = F.coalesce(_say('<script id="__NEXT_DATA__" type="application/json">', data, "</script>"), F.lit(""))
    html = _say(
        "<html><body><h1> ", title, " </h1><p>本文 ", k, '</p><p data-testid="price">¥', F.format_string("%,d", price), "</p>",
        F.when(k % 4 == 1, "<p>送料無料</p>").otherwise(""),
        '<img src="https://item-shopping.c.yimg.jp/i/', k, '.jpg"><img src="https://other/', k, '.jpg">', script, "</body></html>",
    )
    site = choose(
        6, "https://jp.mercari.com/item/m", "https://jp.mercari.com/item/m", "https://paypayfleamarket.yahoo.co.jp/item/z",
        "https://store.shopping.yahoo.co.jp/shop/", "https://store.shopping.yahoo.co.jp/shop/", "https://paypayfleamarket.yahoo.co.jp/item/z",
    )
    return part.select(_say(site, k).alias("url"), html.alias("html"), F.lit("2024-06-01").cast("timestamp").alias("retrieved_at"))


#: The same pages in SQL: what their signals should be, and what should be decided about them.
PAGES_SQL = r"""
base AS (SELECT p_partkey AS k, 5000 + p_partkey * 37 % 30000 AS p, p_partkey % 6 AS s, p_partkey % 7 = 0 AS closed, '紺スーツ 品番' || p_partkey AS title FROM part),
lines AS (
  SELECT *, CASE WHEN k % 4 = 3 THEN 0 ELSE p END AS at_once,
    '肩幅 ' || CASE WHEN k % 11 = 0 THEN 40 ELSE 43 + k % 3 END || 'cm 身幅 52cm 着丈 70cm 袖丈 62cm' AS l1,
    'ウエスト平置き 43cm 股上 25cm 股下 75cm 裾幅 ' || CASE WHEN k % 13 = 0 THEN 17 ELSE 19 END || 'cm ワタリ ' || CASE WHEN k % 17 = 0 THEN 28 ELSE 30 END || 'cm 総丈 100cm 裾シングル' AS l2,
    concat_ws(chr(10), CASE WHEN k % 5 <> 4 THEN '表地：ウール100% 裏地：ポリエステル100%' END, '三つボタン シングル', CASE WHEN k % 5 < 3 THEN '美品 汚れなし 穴なし' END) AS l3
  FROM base
), signals AS (
  SELECT k, s,
    CASE s WHEN 0 THEN 'https://auctions.yahoo.co.jp/jp/auction/x' WHEN 2 THEN 'https://paypayfleamarket.yahoo.co.jp/item/z' WHEN 3 THEN 'https://store.shopping.yahoo.co.jp/shop/'
      WHEN 5 THEN 'https://auctions.yahoo.co.jp/jp/auction/x' ELSE 'https://jp.mercari.com/item/m' END || k AS url,
    CASE s WHEN 2 THEN 'paypay_flea_market' WHEN 3 THEN 'yahoo_shopping' WHEN 1 THEN 'mercari' WHEN 4 THEN 'mercari' ELSE 'yahoo_auctions' END AS source_site,
    title AS title_text,
    CASE s WHEN 0 THEN concat_ws(chr(10), CASE WHEN at_once > 0 THEN '即決 ' || format('{:,}', at_once) || '円' ELSE '現在 ' || format('{:,}', p) || '円' END, CASE WHEN k % 2 = 0 THEN '送料込み' END)
      WHEN 1 THEN concat_ws(chr(10), '即決 ' || format('{:,}', p) || '円', CASE WHEN k % 2 = 0 THEN '送料込み' END)
      WHEN 4 THEN '即決 ' || format('{:,}', p) || '円' || chr(10) || '送料込み' WHEN 5 THEN '' ELSE '即決 ' || format('{:,}', p) || '円' END AS price_text,
    CASE WHEN s = 5 THEN '' WHEN closed THEN '終了' WHEN s <> 0 THEN '出品中' WHEN k % 50 < 2 THEN '残り' || k % 50 * 30 || '分' WHEN k % 50 < 48 THEN '残り' || k % 50 // 2 || '時間' ELSE '残り1日' END AS status_text,
    CASE WHEN s IN (0, 1, 2) THEN concat_ws(chr(10), l1, l2, l3) WHEN s = 3 THEN concat_ws(chr(10), l1, l2, l3, 'ブランド: B' || k % 7, 'サイズ: M') ELSE '' END AS description_text,
    CASE WHEN s IN (0, 1, 2) THEN concat_ws(chr(10), l1, l2, l3) WHEN s = 3 THEN concat_ws(chr(10), l1, l2, l3, 'ブランド: B' || k % 7, 'サイズ: M')
      WHEN s = 4 THEN concat_ws(chr(10), title, '¥' || format('{:,}', p), l1, l2, l3, '送料込み', CASE WHEN closed THEN '売り切れ' END) ELSE '' END AS all_text,
    CASE WHEN s < 4 THEN '商品の状態: 良い' ELSE '' END AS specs_text, CASE WHEN s IN (1, 2, 3) THEN 'B' || k % 7 ELSE '' END AS brand_text,
    CASE s WHEN 1 THEN 'メンズ > スーツ' WHEN 2 THEN 'メンズ スーツ' WHEN 3 THEN 'メンズ スーツ' ELSE '' END AS category_text,
    CASE s WHEN 0 THEN 'https://auctions.c.yimg.jp/i/' || k || '.jpg' WHEN 1 THEN 'L' || k WHEN 2 THEN 'f' || k WHEN 3 THEN 's' || k WHEN 4 THEN 'https://static.mercdn.net/' || k || '.jpg' ELSE '' END AS images
  FROM lines
), judged AS (
  SELECT k, s, CASE WHEN s = 5 THEN 2 ELSE
      CASE WHEN s = 0 AND at_once = 0 THEN 1 ELSE 0 END + CASE WHEN p > 30000 THEN 1 ELSE 0 END + CASE WHEN closed THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END
      + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END END AS n_blocking,
    CASE WHEN s = 5 THEN 6 WHEN k % 5 = 4 THEN 1 ELSE 0 END AS n_notes, CASE WHEN s = 5 THEN 11 ELSE 0 END AS u,
    CASE WHEN s = 5 THEN 8 ELSE 1 + CASE WHEN k % 5 = 4 THEN 2 ELSE 0 END + CASE WHEN k % 5 >= 3 THEN 3 ELSE 0 END END AS o,
    CASE WHEN s <> 5 AND k % 5 <> 4 THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS bonus, CASE WHEN s <> 5 THEN at_once END AS at_once, p, closed
  FROM lines
), page_verdicts AS (
  SELECT *, CASE WHEN n_blocking > 0 THEN 'NO_MATCH' WHEN u + o >= 6 OR score < 0.5 THEN 'REVIEW' ELSE 'MATCH' END AS verdict
  FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(1.0::DOUBLE - 0.4::DOUBLE * n_blocking - 0.05::DOUBLE * n_notes - 0.03::DOUBLE * u + bonus, 3))) AS score FROM judged)
)
"""
