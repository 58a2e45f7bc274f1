"""From captured pages to signals, one mapping per site, over the JSON in the page with the page's text as fallback.

JSON stays VARIANT: a path that is missing or of another type gives null instead of an error. The result has
the columns url, html's text buckets (empty texts where there is nothing), image_urls and retrieved_at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import elements
from ..functions.text import html_to_text
from ..operators.evidence import detect_site
from .captures import embedded_json

#: Buckets and pictures; `html` holds the fragments that make up the description and `more` lines behind them.
Signals = dict[str, Column | tuple[Column, ...]]
BUCKETS = ("title_text", "price_text", "status_text", "description_text", "all_text", "specs_text", "brand_text", "category_text")


def _text(item: Column, *paths: str) -> Column:
    """The first of the paths that holds a text or number that isn't empty."""
    return F.coalesce(*[F.nullif(F.try_variant_get(item, p, "string"), F.lit("")) for p in paths])


def _number(item: Column, *paths: str) -> Column:
    """The first of the paths that holds a number other than zero, as a long; else zero."""
    return F.coalesce(*[F.nullif(_text(item, p).try_cast("double").cast("long"), F.lit(0)) for p in paths], F.lit(0).cast("long"))


def _list(item: Column, *paths: str) -> Column:
    """The first of the paths that holds an array with elements."""
    arrays = [F.try_variant_get(item, p, "array<variant>") for p in paths]
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])


def _yen(label: str, value: Column) -> Column:
    return F.when(value > 0, F.format_string(f"{label} %,d円", value))


def locate_item(site: str, data: Column) -> Column:
    """The item in a site's page data."""
    if site == "yahoo_auctions":
        return F.try_variant_get(data, "$.props.pageProps.initialState.item.detail.item", "variant")
    if site == "mercari":
        items = [F.try_variant_get(data, f"$.props.pageProps.{p}", "variant") for p in ("item", "serverData.item")]
        return F.coalesce(*[F.when(_text(i, "$.id").isNotNull(), i) for i in items])
    if site == "paypay_flea_market":
        return F.try_variant_get(data, "$.props.initialState.itemsState.items.item", "variant")
    queries = F.try_variant_get(data, "$.props.pageProps.dehydratedState.queries", "array<variant>")
    items = F.filter(F.transform(queries, lambda q: F.try_variant_get(q, "$.state.data.itemData.item", "variant")), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(items, F.lit(1)), F.try_variant_get(data, "$.props.pageProps.itemData.item", "variant"))


def map_auction_item(item: Column) -> Signals:
    price, at_once, bids = _number(item, "$.price"), _number(item, "$.bidorbuy"), _number(item, "$.bids")
    state, left = _text(item, "$.status"), F.coalesce(_text(item, "$.leftTime").try_cast("double"), F.lit(0.0))
    whole = lambda seconds: F.floor(left / seconds).cast("string")
    remaining = F.when(left < 3600, F.concat(F.lit("残り"), whole(60), F.lit("分"))).when(
        left < 86400, F.concat(F.lit("残り"), whole(3600), F.lit("時間")),
    ).otherwise(
        F.concat(F.lit("残り"), whole(86400), F.lit("日"))
    )
    return {
        "title_text": _text(item, "$.title"), "html": (_text(item, "$.descriptionHtml", "$.description"),),
        "price_text": F.concat_ws(
            "\n", _yen("即決", at_once), F.when((bids > 0) | (at_once == 0), _yen("現在", price)),
            F.when(_text(item, "$.chargeForShipping") == "seller", "送料込み"),
        ),
        "status_text": F.when(state == "open", remaining).when(state == "close", "終了").otherwise(state),
        "specs_text": F.concat(F.lit("商品の状態: "), _text(item, "$.conditionName")),
    }


def map_mercari_item(item: Column) -> Signals:
    state, payer = F.lower(_text(item, "$.status")), _text(item, "$.shipping_payer.name")
    included = payer.contains("出品者") | payer.contains("込み")
    photo = lambda p: _text(p, "$.image_urls.large", "$.image_urls.medium", "$.image_urls.small", "$.image_urls", "$")
    images = F.filter(F.transform(_list(item, "$.photos", "$.thumbnails"), photo), lambda u: u.isNotNull() & ~u.startswith("{"))
    names = F.array_compact(F.transform(_list(item, "$.categories"), lambda c: _text(c, "$.name")))
    parents = F.array_compact(F.array(_text(item, "$.item_category.parent.name"), _text(item, "$.item_category.name")))
    price = _number(item, "$.price")
    return {
        "title_text": _text(item, "$.name"), "html": (_text(item, "$.description"),),
        "price_text": F.concat_ws("\n", _yen("即決", price), F.when((price > 0) & included, "送料込み")),
        "status_text": F.when(state == "on_sale", "出品中").when(state.isin("sold_out", "trading", "stop"), "終了").otherwise(state),
        "image_urls": images, "category_text": F.array_join(F.coalesce(names, parents), " > "), "brand_text": _text(item, "$.brand.name"),
        "specs_text": F.concat(F.lit("商品の状態: "), _text(item, "$.item_condition.name", "$.condition.name")),
    }


def map_flea_item(item: Column) -> Signals:
    state, bought = F.upper(_text(item, "$.status")), F.coalesce(_text(item, "$.isPurchased").try_cast("boolean"), F.lit(False))
    return {
        "title_text": _text(item, "$.title"), "html": (_text(item, "$.description"),), "price_text": _yen("即決", _number(item, "$.price")),
        "status_text": F.when(bought | state.isin("SOLD", "CLOSED", "CLOSE"), "終了").when(state == "OPEN", "出品中").otherwise(state),
        "image_urls": F.array_compact(F.transform(_list(item, "$.images"), lambda i: _text(i, "$.url"))),
        "category_text": F.array_join(F.array_compact(F.transform(_list(item, "$.categoryList"), lambda c: _text(c, "$.name"))), " "),
        "brand_text": _text(item, "$.brand.name"), "specs_text": F.concat(F.lit("商品の状態: "), _text(item, "$.condition.text")),
    }


def map_shopping_item(item: Column) -> Signals:
    labels = {"brandName": "ブランド", "colorName": "カラー", "sizeName": "サイズ", "materialDescription": "素材"}
    parts = [F.concat(F.lit(f"{label}: "), _text(item, f"$.{k}")) for k, label in labels.items()]
    there = F.lower(_text(item, "$.availability", "$.inStock"))
    scalar = lambda v: F.when(~v.startswith("{"), v)
    return {
        "title_text": _text(item, "$.name", "$.title"),
        "html": tuple(_text(item, f"$.{k}") for k in ("freeSpace1", "freeSpace2", "information")), "more": F.concat_ws("\n", *parts),
        "price_text": _yen("即決", _number(item, "$.price.value", "$.price.selling", "$.price")),
        "status_text": F.when(there.isin("false", "0", "outofstock"), "終了").otherwise("出品中"),
        "image_urls": F.array_compact(F.transform(_list(item, "$.images"), lambda i: _text(i, "$.url"))),
        "category_text": F.array_join(
            F.array_compact(
                F.transform(
                    _list(item, "$.categoryPath", "$.sellerCategoryPathList"),
                    lambda c: F.coalesce(_text(c, "$.name"), scalar(_text(c, "$"))),
                )
            ),
            " ",
        ),
        "brand_text": _text(item, "$.brandName", "$.brand.name"),
        "specs_text": F.concat(
            F.lit("商品の状態: "),
            F.coalesce(
                _text(item, "$.condition.label", "$.condition.text"), scalar(_text(item, "$.condition", "$.usedCondition")),
                _text(item, "$.usedCondition.label"),
            ),
        ),
    }


#: Where each site keeps its pictures.
IMAGE_HOSTS = {
    "mercari": "mercdn.net", "yahoo_shopping": "item-shopping.c.yimg.jp", "yahoo_auctions": "auctions.c.yimg.jp",
    "paypay_flea_market": "yimg.jp",
}

#: What is looked for on pages whose data don't say it: (selector, what to take).
FALLBACKS = {
    "heading": ("h1", "text"), "body": ("body", "text"), "prices": ("[data-testid=price]", "texts"),
    "amounts": ("[class*=rice]", "texts"), "images": ("img", "@src"),
}


def html_fallback_signals(site: str, page: Column) -> Signals:
    """What can be had from a page's elements, a struct of FALLBACKS, where its data don't say it."""
    one_line = F.nullif(F.trim(F.regexp_replace(page["heading"], r"(?U)\s+", " ")), F.lit(""))
    out = {"title_text": one_line, "image_urls": F.filter(page["images"], lambda u: u.contains(IMAGE_HOSTS[site]))}
    body = page["body"]
    if site == "yahoo_shopping":
        out |= {"description_text": body, "all_text": body}
    if site == "mercari":
        amounts = F.filter(page["amounts"], lambda t: t.rlike(r"[¥￥][^¥￥]*\d"))
        raw = F.coalesce(F.try_element_at(page["prices"], F.lit(1)), F.try_element_at(amounts, F.lit(1)))
        digits = F.regexp_replace(F.regexp_extract(F.regexp_replace(raw, r"[\s¥￥]", ""), r"([\d,]+)", 1), ",", "").try_cast("long")
        included = body.contains("送料込み") | body.contains("送料無料")
        out |= {
            "price_text": F.when(digits > 0, F.concat(_yen("即決", digits), F.when(included, "\n送料込み").otherwise(""))), "all_text": body,
            "status_text": F.when(body.contains("売り切れ") | F.upper(body).contains("SOLD OUT"), "終了").otherwise("出品中"),
        }
    return out


#: The mapping of each site; others can be added.
MAPPERS: dict[str, Callable[[Column], Signals]] = {
    "yahoo_auctions": map_auction_item,
    "mercari": map_mercari_item,
    "paypay_flea_market": map_flea_item,
    "yahoo_shopping": map_shopping_item,
}


def _by_site(values: dict[str, Column]) -> Column:
    """The value of a row's own site."""
    out = F.lit(None)
    for site, value in values.items():
        out = F.when(F.col("source_site") == site, value).otherwise(out)
    return out


def captures_to_signals(captures: DataFrame) -> DataFrame:
    """captures (url, html, retrieved_at) with source_site and all signals, in one pass over the pages.

    Each row goes through its own site's mapping only; texts of HTML leave the JVM once for all sites together.
    A page whose data hold an item keeps that item's texts, even empty ones, but for title, price and pictures.
    """
    rows = captures.select(
        "url", "html", "retrieved_at", detect_site(F.col("url")).alias("source_site"),
        embedded_json(F.col("html")).alias("_data"),
    )
    rows = rows.select(
        "url", "html", "retrieved_at", "source_site",
        _by_site({s: locate_item(s, F.col("_data")) for s in MAPPERS}).alias("_item"),
    )
    mapped = {site: mapper(F.col("_item")) for site, mapper in MAPPERS.items()}
    fragments = [
        _by_site(
            {s: m["html"][k] for s, m in mapped.items() if k < len(m["html"])}
        ) for k in range(max(len(m["html"]) for m in mapped.values()))
    ]
    # the page itself is only taken to pieces where its data may not say all
    titles = _by_site({s: F.coalesce(m["title_text"], F.lit("")) for s, m in mapped.items()})
    pictures = _by_site({s: F.size(F.coalesce(m.get("image_urls", F.lit(None)).cast("array<string>"), F.array())) for s, m in mapped.items()})
    needed = (F.col("source_site") == "mercari") | F.col("_item").isNull() | (titles == "") | (pictures == 0)
    rows = rows.select("*", *[f.alias(f"_html{k}") for k, f in enumerate(fragments)], F.when(needed, F.col("html")).alias("_page"))
    # what has no tag in a shop's fields is taken as it is
    tagged = lambda k: F.when(
        (F.col("source_site") != "yahoo_shopping") | F.col(f"_html{k}").contains("<"), F.col(f"_html{k}"),
    )
    texts = [F.coalesce(html_to_text(tagged(k)), F.col(f"_html{k}")).alias(f"_text{k}") for k in range(len(fragments))]
    rows = rows.select("url", "retrieved_at", "source_site", "_item", *texts, elements(F.col("_page"), FALLBACKS).alias("_page"))
    empty, none = F.lit(""), F.array().cast("array<string>")

    def values(site: str, name: str) -> Column:
        item, other = mapped[site], html_fallback_signals(site, F.col("_page")).get(name)
        if name in ("description_text", "all_text"):
            value = F.concat_ws(
                "\n", *[f"_text{k}" for k in range(len(item["html"]))],
                *([F.nullif(item["more"], empty)] if "more" in item else [])
            )
        else:
            value = item.get(name, F.lit(None))
        if name == "image_urls":
            value = F.coalesce(value.cast("array<string>"), none)
            return F.when(F.size(value) > 0, value).otherwise(other)
        value = F.coalesce(value, empty)
        if site == "yahoo_shopping" and name == "status_text":  # a guess without an item
            return F.when(F.col("_item").isNotNull(), value).otherwise(empty)
        if other is None:
            return value
        if site == "yahoo_shopping":
            return F.when(F.col("_item").isNotNull(), value).otherwise(F.coalesce(other, empty))
        return F.coalesce(F.nullif(value, empty), other, empty)

    return rows.select(
        "url", "source_site", "retrieved_at",
        *[_by_site({s: values(s, name) for s in MAPPERS}).alias(name) for name in (*BUCKETS, "image_urls")]
    )


#: Class or tag of each bucket on pages of the auction site.
SELECTORS = {
    "title_text": "h1.ProductTitle__text", "price_text": ".Price__value", "status_text": ".AuctionStatus",
    "description_text": ".ItemDescription",
    "specs_text": ".ProductDetail__section", "brand_text": ".Breadcrumb__link", "category_text": ".Breadcrumb",
}
IMAGES = ".ProductImage__image"


def selector_signals(html: Column, selectors: dict[str, str], images: str | None = None, rendered: bool = False) -> Signals:
    """The whole text of the first element of each selector, and with `images` the image_urls of all of that selector.

    All of them come from one pass over the page; `rendered` gives texts in the lines that a browser shows.
    """
    wanted = {name: (selector, "text") for name, selector in selectors.items()}
    found = elements(html, wanted | ({"image_urls": (images, "@src")} if images else {}), rendered)
    empty = {name: F.lit("") for name in selectors} | {"image_urls": F.array().cast("array<string>")}
    return {name: F.coalesce(found[name], empty[name]) for name in (*selectors, *(["image_urls"] if images else []))}
