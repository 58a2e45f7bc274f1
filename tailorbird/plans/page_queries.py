"""Registered queries over captured pages and over listings with competing, missing or tabular texts, with their SQL."""

from __future__ import annotations

import hashlib
from dataclasses import asdict

from pyspark.sql import functions as F

from ..config import RULES
from ..functions.html import elements
from ..functions.text import cm_to_mm, mm_to_cm
from ..operators import fill, frontier, rules, store, stored
from ..operators.evidence import build_package, own_packages, site_item_id
from ..sources.captures import outcome_log, read_captures, read_evidence_packages
from ..sources.scratch import shared_path
from ..sources.sites import IMAGES, SELECTORS, captures_to_signals, selector_signals
from ..streaming.decisions import stream_decisions
from .decisions import decide_captures, decide_signals, extract_signals, reparse
from .listings import EXPECTED_SQL, listing_signals, parts
from .pages import PAGES_SQL, choose, listing_captures, signals_of, variant_captures

def _k() -> F.Column:
    return F.col("p_partkey")


def _say(*parts) -> F.Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


# --- captured pages -----------------------------------------------------------------------------------------


def capture_signals(spark, sf_dir):
    """Pages of all sites, written as captures and read back."""
    path = shared_path(spark, "captures")
    listing_captures(parts(spark, sf_dir)).write.parquet(path)
    out = captures_to_signals(read_captures(spark, path))
    return out.drop("retrieved_at").withColumn("images", F.array_join("image_urls", " ")).drop("image_urls")


def capture_variants(spark, sf_dir):
    """Pages that name pictures, prices, categories or states in rarer ways, or hold no data."""
    out = captures_to_signals(variant_captures(parts(spark, sf_dir)))
    return out.select(
        "url", "source_site", "title_text", "price_text", "status_text", "all_text", "specs_text", "category_text",
        F.array_join("image_urls", " ").alias("images"),
    )


def unit_back(spark, sf_dir):
    """Millimetres as centimetres, and back again."""
    mm = F.col("p_size") * 5.0
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", mm_to_cm(mm).alias("cm"), cm_to_mm(mm_to_cm(mm)).alias("mm"))


def capture_decisions(spark, sf_dir):
    out = decide_captures(listing_captures(parts(spark, sf_dir)), distinct=False)
    return out.select("url", "verdict", "score", F.size("blocking_reasons").alias("n_blocking"), F.size("reasons").alias("n_notes"))


def capture_verdicts(spark, sf_dir):
    return store.verdict_stats(decide_captures(listing_captures(parts(spark, sf_dir)), distinct=False))


def repeated_captures(spark, sf_dir):
    """Every page twice, the second time without some of the buy-now prices, and pages without a URL: each is decided by itself."""
    part = parts(spark, sf_dir)
    later = listing_captures(part, changed=True).withColumn("retrieved_at", F.col("retrieved_at") + F.expr("interval 30 days"))
    nameless = listing_captures(part.filter(_k() % 6 == 5)).withColumn("url", F.lit(None).cast("string"))
    out = decide_captures(listing_captures(part).unionByName(later).unionByName(nameless))
    return out.select(
        "url", (F.col("retrieved_at") > F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("second"), "verdict",
        F.col("price")["buy_now_price_jpy"].alias("buy_now"),
    )


def recheck_matches(spark, sf_dir):
    """Stored matches looked at again after some lost their buy-now price."""
    part = parts(spark, sf_dir)
    stored = decide_captures(listing_captures(part), distinct=False).filter(F.col("verdict") == "MATCH").select("url", "verdict", "price")
    pages = listing_captures(part, changed=True)
    again = extract_signals(captures_to_signals(pages), ("status", "price"), distinct=False)
    return store.recheck_join(stored, again, pages.select("url")).select("url", "verdict", "is_active", "reason")


def page_selectors(spark, sf_dir):
    """Pages that hold no data, read by the classes of their elements."""
    html = _say(
        '<nav class="Breadcrumb"><a href="#" class="Breadcrumb__link">メンズ', _k() % 3,
        '</a></nav><h1 class="x ProductTitle__text">スーツ ', _k(), '</h1>',
        '<div class="Price"><span class="Price__label">現在価格</span><span class="Price__value">', _k(), "円</span></div>",
        F.when(_k() % 2 == 0, '<p class="AuctionStatus">出品中</p>').otherwise(""), '<section class="ItemDescription">\n肩幅：',
        _k() % 9, "cm<br>\n裾シングル &amp; 他\n</section>",
    )
    return parts(spark, sf_dir).select(_k().alias("k"), *[c.alias(n) for n, c in selector_signals(html, SELECTORS).items()])


def nested_selectors(spark, sf_dir):
    """Pages with nested, unclosed, unquoted and commented markup, read in the lines that a browser shows, with their pictures."""
    html = _say(
        "<!-- <h1 class=ProductTitle__text>no</h1> --><body><nav class='Breadcrumb x'><a href=# class=Breadcrumb__link>メンズ</a> &gt; <a class=Breadcrumb__link>スーツ</a></nav>",
        "<H1 CLASS=ProductTitle__text>スーツ <i>", _k(), "</i></H1><script>'<p class=Price__value>0円</p>'</script>",
        '<div class="Price"><span class="Price__value">現在 <b>', _k(), "</b>円</span><span class=Price__value>即決 9円</span></div>",
        F.when(_k() % 2 == 0, "<div class=AuctionStatus><span>出品中</span><div>残り <b>3日</b></div></div>").otherwise(""),
        "<div class=ProductDetail__section><table><tr><th>サイズ<td>", _k() % 50, "<tr><th>素材<td>ウール100%</table></div>",
        '<div class="a ItemDescription"><div>肩幅：', _k() % 9, "cm</div>身幅 <b>52cm</b><p>一<p>二<ul><li>股下<li>裾</ul></section>終わり</div>",
        "<img class=ProductImage__image src=//i/", _k(), ".jpg><img src=no.jpg><img src='//i/b.jpg?a=1&amp;b=2' class='y ProductImage__image'/>",
    )
    signals = selector_signals(html, SELECTORS, images=IMAGES, rendered=True)
    out = parts(spark, sf_dir).select(_k().alias("k"), *[c.alias(n) for n, c in signals.items()])
    return out.withColumn("image_urls", F.array_join("image_urls", " "))


def page_elements(spark, sf_dir):
    """What the given pages hold: heading, links, the text of their footer, and paragraphs."""
    wanted = {
        "title": ("head title", "text"), "heading": ("article h1", "text"), "links": ("nav li a[href]", "@href"), "names": ("nav li a", "texts"),
        "footer": ("footer", "text"), "paragraphs": ("article p", "texts"), "advert": ("div.ad", "text"),
    }
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", elements(F.col("html"), wanted, rendered=True).alias("e"))
    e = F.col("e")
    return pages.select(
        "page_id", e["title"].alias("title"), e["heading"].alias("heading"), F.array_join(e["links"], " ").alias("links"),
        F.array_join(e["names"], " ").alias("names"), e["footer"].alias("footer"), F.size(e["paragraphs"]).alias("n_paragraphs"), e["advert"].alias("advert"),
    )


def item_urls(spark, sf_dir):
    """The items that search pages of two sites link to."""
    html = _say(
        '<a href="https://jp.mercari.com/item/m', _k(), '?a=1">x</a><a href="/item/m', _k() + 1, '">y</a><a href="/item/m', _k(),
        '">z</a><a href="https://auctions.yahoo.co.jp/jp/auction/x', _k(),
        '?b">q</a><a href="https://other/item/m1">o</a><a href="https://page.auctions.yahoo.co.jp/jp/auction/y', _k(), '">p</a>',
    )
    pages = parts(spark, sf_dir).select(_k().alias("k"), html.alias("html"))
    both = frontier.extract_item_urls(pages, "mercari").unionByName(frontier.extract_item_urls(pages, "yahoo_auctions"))
    return both.select("k", "rank", "url", site_item_id(F.col("url")).alias("site_id"))


def item_url_round_trip(spark, sf_dir):
    url = frontier.build_item_url(_say("x", _k()))
    return parts(spark, sf_dir).select(
        _k().alias("k"), url.alias("url"), site_item_id(url).alias("site_id"),
        F.size(frontier.item_urls_in_text(_say("see ", url, "?a=1 or ", url))).alias("n"),
    )


# --- stored packages, logs, streams -------------------------------------------------------------------------


def stored_packages(spark, sf_dir):
    """Packages written as JSON, read back and decided anew; every tenth lost its blocks."""
    path = shared_path(spark, "packages")
    signals = build_package(listing_signals(parts(spark, sf_dir)))
    nested = own_packages(signals.withColumn("item_id", _k().cast("string")))
    nested.withColumn("evidence_blocks", F.when(F.col("item_id").cast("long") % 10 != 9, F.col("evidence_blocks"))).write.json(path)
    return reparse(read_evidence_packages(spark, path), distinct=False).select(F.col("item_id").cast("long").alias("k"), "verdict", "score", "error")


def broken_packages(spark, sf_dir):
    """Packages of which some lines are cut off: each gets an error of its own and keeps its text; the others are decided."""
    path = shared_path(spark, "packages")
    signals = build_package(listing_signals(parts(spark, sf_dir)))
    nested = own_packages(signals.withColumn("item_id", _k().cast("string")))
    line, k = F.to_json(F.struct(*nested.columns)), F.col("item_id").cast("long")
    nested.select(F.when(k % 10 == 3, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value")).write.text(path)
    out = reparse(read_evidence_packages(spark, path), distinct=False)
    return out.groupBy("error", "verdict").agg(F.count("*").alias("n"), F.count("broken").alias("texts"), F.count("score").alias("scores"))


def fill_passes(spark, sf_dir):
    """Which listings are asked about by their text, and which by their pictures once the answers about texts are in."""
    text = choose(
        5, "肩幅 44cm ウール100%", "肩幅 44cm 身幅 52cm 着丈 70cm 袖丈 62cm ウエスト平置き 43cm 股上 25cm 股下 75cm 裾幅 19cm ワタリ 30cm 裾シングル",
        "肩幅 44cm 身幅 52cm 着丈 70cm 袖丈 62cm ウエスト平置き 43cm 股上 25cm 股下 75cm 裾幅 19cm ワタリ 30cm 裾シングル ウール100%", "", "袖丈 62cm",
    )
    signals = signals_of(parts(spark, sf_dir), description_text=text, title_text=F.lit("紺のスーツ"))
    signals = signals.withColumn("image_urls", F.when(F.col("k") % 3 > 0, F.array(F.concat(F.lit("i"), F.col("k")))).otherwise(F.array()))
    path = shared_path(spark, "attributes")  # written, as three steps read them
    extract_signals(signals, ("size", "material"), distinct=False).write.parquet(path)
    found = spark.read.parquet(path)
    by_text = fill.ml_fill_requests(fill.ml_fill_candidates(found), keep=("k",))
    # half of the listings get an answer about their fibres, every fourth one about its sizes as well
    fibers = '"outer_fibers": [{"fiber": "wool", "percentage": 100}]'
    sizes = '"jacket_chest_width_cm": 52, "jacket_length_cm": 70, "pants_rise_cm": 25, "pants_inseam_cm": 75, "pants_thigh_cm": 30, "jacket_shoulder_cm": 44'
    told = F.when(F.col("k") % 4 == 0, f"{{{fibers}, {sizes}}}").when(F.col("k") % 2 == 0, f"{{{fibers}}}")
    answers = fill.ml_fill_candidates(found).select("item_id", F.lit("text").alias("pass"), told.alias("j"))
    answers = answers.filter("j is not null").select("item_id", "pass", F.parse_json("j").alias("result"))
    merged = fill.ml_fill_join(found, answers, passes=("text",))
    by_image = fill.ml_fill_requests(fill.ml_fill_candidates(merged, images=True), images=True, keep=("k",))
    return by_text.unionByName(by_image).select("k", "pass", "about", F.size(F.coalesce("images", F.array())).alias("n_images"))


def logged_outcomes(spark, sf_dir):
    """Outcomes of runs, appended to the log run by run and summed up from it."""
    path, k = shared_path(spark, "outcomes"), F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    actions = F.array(*[F.lit(a) for a in ("crawled", "status_rechecked", "skipped", "error")])
    rows = events.select(
        (F.col("user_id") % 2).alias("run_id"), F.concat(F.lit("u"), k).alias("url"),
        F.element_at(actions, (k % 4 + 1).cast("int")).alias("action"), F.when(k % 4 < 2, "REVIEW").alias("verdict"),
    )
    for run in (0, 1):
        outcome_log(rows.filter(F.col("run_id") == run), path)
    return frontier.batch_summary(spark.read.parquet(path)).select(
        "run_id", "total", "crawled", "status_rechecked", "skipped", "errors", "reviews",
    )


def streamed_listings(spark, sf_dir):
    """Captures that arrive as files, each twice, decided as a stream and folded to current listings."""
    source, changes, state = (shared_path(spark, n) for n in ("arriving", "changes", "stream-state"))
    pages = listing_captures(parts(spark, sf_dir))
    for _ in range(2):  # the same captures again, too soon to count
        pages.coalesce(1).write.mode("append").parquet(source)
    query = stream_decisions(read_captures(spark, source, stream=True), changes, state, once=True, within="30 days")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    out = store.fold_changes(spark.read.parquet(changes).drop("batch_id"))
    return out.select("url", "verdict", F.size("blocking_reasons").alias("n_blocking"), "is_active")


def _order_listings(spark, sf_dir):
    """A listing per order, retrieved in one of five days."""
    k = F.col("o_orderkey")
    hours = F.make_interval(hours=(k % 113).cast("int"))
    verdict = F.when(F.col("o_orderstatus") == "F", "NO_MATCH").otherwise("REVIEW")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        frontier.build_item_url(_say("o", k)).alias("url"), (F.lit("2024-06-01 00:00:00").cast("timestamp") + hours).alias("retrieved_at"),
        verdict.alias("verdict"), F.col("o_totalprice").alias("price"), k.alias("k"),
    )


def stored_lookups(spark, sf_dir):
    """One listing by its URL and one by its id, out of a store of all."""
    path = shared_path(spark, "store")
    stored.write_store(_order_listings(spark, sf_dir), path, buckets=8)
    by_url = stored.find_stored(spark, path, url="https://auctions.yahoo.co.jp/jp/auction/o33")
    by_id = stored.find_stored(spark, path, own_id=hashlib.sha256(b"https://auctions.yahoo.co.jp/jp/auction/o7").hexdigest())
    return by_url.unionByName(by_id).select("url", "item_id", "verdict", "price")


def stored_changes(spark, sf_dir):
    """A store after a batch of changes, in which listings also move to another day, and after a day was taken out."""
    path, listings = shared_path(spark, "store"), _order_listings(spark, sf_dir)
    stored.write_store(listings, path, buckets=8)
    late = F.when(F.col("k") % 2 == 0, F.col("retrieved_at")).otherwise(F.lit("2024-06-20 00:00:00").cast("timestamp"))
    batch = listings.filter(F.col("k") % 101 == 0).withColumns({"verdict": F.lit("MATCH"), "retrieved_at": late})
    stored.upsert_stored(spark, path, batch.unionByName(batch.withColumn("k", -F.col("k")).withColumn("url", F.concat("url", F.lit("n")))))
    gone = stored.delete_stored_day(spark, path, "2024-06-03")
    out = stored.read_store(spark, path).groupBy("day", "verdict").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))
    return out.withColumn("deleted", F.lit(gone).cast("long"))


def found_by_id(spark, sf_dir):
    return store.find_by_id(
        decide_signals(listing_signals(parts(spark, sf_dir)), distinct=False),
        "f8279f5c6d45126f7d242c99160193f5e89b84391a801f021e881dd53f0f3201",
    ).select("url", "verdict")


# --- texts that compete, are missing, or stand in tables ----------------------------------------------------


def listing_warnings(spark, sf_dir):
    return decide_signals(listing_signals(parts(spark, sf_dir)), distinct=False).select(_k().alias("k"), F.array_join("warnings", " | ").alias("warnings"))


def listing_size_tables(spark, sf_dir):
    signals = signals_of(
        parts(spark, sf_dir),
        title_text=F.concat(F.lit("紺 スーツ "), choose(5, "3XL", "LL", "M", "なし", "XS")),
        description_text=F.when(_k() % 6 == 5, "【Mサイズ】肩幅 43cm 袖丈 60cm").otherwise(
            "【 Mサイズ 】肩幅 43cm 袖丈 60cm【3XLサイズ】肩幅 46cm 袖丈 63cm [2XL] 肩幅 44cm 袖丈 61cm"
        ),
    )
    size = F.col("size")
    out = extract_signals(signals, ("size",), distinct=False)
    return out.select(
        "k", size["jacket"]["shoulder_cm"]["value"].alias("shoulder"), size["jacket"]["sleeve_cm"]["value"].alias("sleeve"),
        F.array_join(size["warnings"], " | ").alias("warnings"),
    )


def listing_shipping(spark, sf_dir):
    amount = _say("即決 ", F.format_string("%,d", 5000 + _k()), "円")
    text = choose(
        6, F.concat(amount, _say(" 送料 ", 500 + _k() % 500, "円")), F.concat(amount, F.lit(" 送料込み")),
        F.concat(amount, F.lit(" 送料無料")), amount, "要相談", _say("販売価格：", _k(), "円"),
    )
    price = F.col("price")
    join = lambda f: F.array_join(price[f], " | ").alias(f)
    return extract_signals(signals_of(parts(spark, sf_dir), description_text=text), ("price",), distinct=False).select(
        "k", price["listing_type"].alias("listing_type"), price["shipping_price_jpy"].alias("shipping"),
        price["shipping_included"].alias("included"), join("evidence"), join("unknown_fields"), join("warnings"),
        price["confidence"].alias("confidence"),
    )


def listing_status_fallback(spark, sf_dir):
    """States that only titles or descriptions tell, or nothing does."""
    signals = signals_of(
        parts(spark, sf_dir), title_text=choose(5, "スーツ SOLD OUT", "紺のスーツ", "紺のスーツ", "紺のスーツ", "紺のスーツ"),
        description_text=choose(5, "出品中です", "落札済みです", "オークション終了", "残り 3日", "よい品です"),
        status_text=F.when(_k() % 9 == 8, "お取り置き").otherwise(""),
    )
    s = F.col("status")
    return extract_signals(signals, ("status",), distinct=False).select(
        "k", s["normalized_status"].alias("state"), s["raw_status"].alias("raw"), s["confidence"].alias("confidence"),
        F.array_join(s["warnings"], " | ").alias("warnings"),
    )


def listing_priorities(spark, sf_dir):
    """Sources that say different things: the order of the extractor decides, then the place."""
    signals = signals_of(
        parts(spark, sf_dir),
        title_text=F.concat(F.lit("肩幅 45cm ダブルスーツ ウール 穴あり"), F.when(_k() % 4 == 0, " 1ボタン").otherwise("")),
        specs_text=F.when(_k() % 3 == 0, "肩幅 43cm モヘア100% ジャンク").otherwise(""),
        description_text=F.when(_k() % 2 == 0, "肩幅 44cm シングル 美品\n肩幅 40cm 綿70% ナイロン30% 穴なし").otherwise("よい品です"),
        all_text=F.lit("肩幅 50cm 三つボタン ひどい汚れ"),
    )
    shoulder, style, condition = F.col("size")["jacket"]["shoulder_cm"], F.col("style"), F.col("condition")
    out = extract_signals(signals, ("size", "material", "style", "condition"), distinct=False)
    fibers = F.array_join(
        F.transform(F.col("material")["outer_fibers"], lambda f: F.concat(f["fiber"], F.lit("="), f["percentage"].cast("string"))),
        ",",
    )
    return out.select(
        "k", shoulder["value"].alias("shoulder"), shoulder["unit"].alias("unit"), shoulder["evidence"].alias("evidence"),
        shoulder["source"].alias("source"), shoulder["confidence"].alias("confidence"),
        fibers.alias("fibers"), style["button_type"].alias("button_type"), style["button_count"].alias("button_count"),
        style["confidence"].alias("style_confidence"), condition["grade"].alias("grade"),
        condition["has_hole"].alias("has_hole"), condition["has_stain"].alias("has_stain"),
        condition["confidence"].alias("condition_confidence"),
    )


def listing_pants(spark, sf_dir):
    """All measures of trousers, with the reasons that they give."""
    text = _say(
        "股上 ", 18 + _k() % 25, "cm 股下 ", 68 + _k() % 9, "cm 裾幅 ", 15 + _k() % 6, "cm ワタリ ", 25 + _k() % 9, "cm 総丈 ",
        95 + _k() % 50, "cm 着丈 ", 55 + _k() % 40, "cm",
    )
    size = F.col("size")
    value = lambda part, field, name: size[part][field]["value"].alias(name)
    out = decide_signals(signals_of(parts(spark, sf_dir), description_text=text), distinct=False)
    return out.select(
        "k", value("pants", "rise_cm", "rise"), value("pants", "hem_width_cm", "hem_width"), value("pants", "thigh_cm", "thigh"),
        value("pants", "total_length_cm", "total_length"),
        value("jacket", "length_cm", "length"),
        F.array_join(F.filter("blocking_reasons", lambda r: r.rlike("^(股下|裾幅|ワタリ)")), " | ").alias("blocking"),
    )


def custom_rules(spark, sf_dir):
    """Listings under thresholds that come from a table: the price limit is the mean price of all parts."""
    part = parts(spark, sf_dir)
    limit = part.agg(F.floor(F.avg(5000 + _k() * 37 % 40000)).cast("double")).first()[0]
    frame = rules.rules_frame(spark)
    own = rules.rules_from_frame(frame.withColumn("lo", F.when(F.col("rule") == "max_price", F.lit(limit)).otherwise(F.col("lo"))))
    out = decide_signals(listing_signals(part), own, distinct=False)
    return out.select(
        _k().alias("k"), F.exists("blocking_reasons", lambda r: r.startswith("価格 ")).alias("too_dear"),
        F.lit(len(asdict(RULES))).alias("n_rules"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        capture_signals, capture_variants, unit_back, capture_decisions, capture_verdicts, repeated_captures, recheck_matches, page_selectors, nested_selectors,
        page_elements, item_urls, item_url_round_trip, stored_packages, broken_packages, fill_passes, logged_outcomes, streamed_listings,
        stored_lookups, stored_changes, found_by_id, listing_warnings, listing_size_tables, listing_shipping, listing_status_fallback, listing_priorities,
        listing_pants, custom_rules,
    )
}


def _paged(select: str) -> str:
    return f"WITH {PAGES_SQL} {select}"


def _listed(select: str) -> str:
    return f"WITH {EXPECTED_SQL} {select}"


def _decoded(*names: str) -> str:
    """Texts of markup without its entities, whose semicolon may be cut off, white space in runs as one space."""
    signs = {"&copy": "©", "&middot": "·", "&quot": '"', "&lt": "<", "&gt": ">", "&amp": "&"}
    plain = "".join(f".regexp_replace('{k};?', '{v}', 'g')" for k, v in signs.items())
    return ", ".join(f"{n}{plain}.regexp_replace('[ \\t\\n]+', ' ', 'g').trim() AS {n}" for n in names)


_ORDERS_SQL = """
WITH listed AS (
  SELECT 'https://auctions.yahoo.co.jp/jp/auction/o' || o_orderkey AS url, TIMESTAMP '2024-06-01 00:00:00' + to_hours(CAST(o_orderkey % 113 AS INTEGER)) AS seen,
    CASE WHEN o_orderstatus = 'F' THEN 'NO_MATCH' ELSE 'REVIEW' END AS verdict, o_totalprice AS price, o_orderkey AS k FROM orders
)"""

ORACLE_SQL = {
    "stored_lookups": _ORDERS_SQL + " SELECT url, sha256(url) AS item_id, verdict, price FROM listed WHERE k IN (7, 33)",
    "stored_changes": _ORDERS_SQL
    + """
, changed AS (SELECT url, CASE WHEN k % 2 = 0 THEN seen ELSE TIMESTAMP '2024-06-20 00:00:00' END AS seen, 'MATCH' AS verdict, k FROM listed WHERE k % 101 = 0),
merged AS (
  SELECT url, seen, verdict, k FROM listed WHERE k % 101 <> 0 UNION ALL SELECT url, seen, verdict, k FROM changed
  UNION ALL SELECT url || 'n', seen, verdict, -k FROM changed
), dated AS (SELECT strftime(seen + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, verdict, k FROM merged)
SELECT day, verdict, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys, (SELECT count(*) FROM dated WHERE day = '2024-06-03') AS deleted
FROM dated WHERE day <> '2024-06-03' GROUP BY day, verdict""",
    "capture_signals": _paged(
        "SELECT url, source_site, title_text, price_text, status_text, description_text, all_text, specs_text, brand_text, category_text, images FROM signals"
    ),
    "capture_variants": """
WITH v AS (
  SELECT p_partkey AS k, p_partkey % 6 AS s, '紺スーツ 品番' || p_partkey AS title, format('{:,}', 5000 + p_partkey * 37 % 30000) AS p, '身幅 52cm 着丈 70cm' AS line,
    'https://item-shopping.c.yimg.jp/i/' || p_partkey || '.jpg' AS shown, CASE WHEN p_partkey % 4 = 1 THEN '送料無料' END AS free FROM part
)
SELECT CASE WHEN s < 2 THEN 'https://jp.mercari.com/item/m' WHEN s IN (2, 5) THEN 'https://paypayfleamarket.yahoo.co.jp/item/z' ELSE 'https://store.shopping.yahoo.co.jp/shop/' END || k AS url,
  CASE WHEN s < 2 THEN 'mercari' WHEN s IN (2, 5) THEN 'paypay_flea_market' ELSE 'yahoo_shopping' END AS source_site, title AS title_text,
  CASE WHEN s < 4 THEN concat_ws(chr(10), '即決 ' || p || '円', CASE WHEN s = 1 AND free IS NOT NULL THEN '送料込み' END) ELSE '' END AS price_text,
  CASE s WHEN 0 THEN '終了' WHEN 1 THEN '出品中' WHEN 2 THEN CASE WHEN k % 4 = 2 THEN '終了' ELSE '出品中' END WHEN 3 THEN CASE WHEN k % 4 = 3 THEN '出品中' ELSE '終了' END ELSE '' END AS status_text,
  CASE WHEN s < 4 THEN line WHEN s = 4 THEN concat_ws(chr(10), title, '本文 ' || k, '¥' || p, free) ELSE '' END AS all_text,
  CASE s WHEN 0 THEN '商品の状態: 良い' WHEN 3 THEN '商品の状態: 中古' ELSE '' END AS specs_text,
  CASE s WHEN 0 THEN 'メンズ > スーツ' WHEN 3 THEN '紳士 スーツ' ELSE '' END AS category_text,
  CASE s WHEN 0 THEN 'M' || k || ' S' || k || ' U' || k WHEN 1 THEN 'T' || k ELSE shown END AS images
FROM v""",
    "unit_back": "SELECT p_partkey, p_size * 0.5::DOUBLE AS cm, p_size * 5.0::DOUBLE AS mm FROM part",
    "capture_decisions": _paged("SELECT url, verdict, score, n_blocking, n_notes FROM page_verdicts JOIN signals USING (k)"),
    "capture_verdicts": _paged(
        "SELECT count(*) FILTER (WHERE verdict = 'MATCH') AS MATCH, count(*) FILTER (WHERE verdict = 'REVIEW') AS REVIEW, count(*) FILTER (WHERE verdict = 'NO_MATCH') AS NO_MATCH FROM page_verdicts"
    ),
    "repeated_captures": _paged("""
, v AS (SELECT url, k, page_verdicts.s AS s, verdict, CASE WHEN page_verdicts.s = 5 THEN NULL WHEN page_verdicts.s = 0 THEN nullif(at_once, 0) ELSE p END AS buy_now FROM page_verdicts JOIN signals USING (k))
SELECT url, FALSE AS second, verdict, CAST(buy_now AS INTEGER) AS buy_now FROM v
UNION ALL SELECT url, TRUE, CASE WHEN s = 0 AND k % 3 = 0 THEN 'NO_MATCH' ELSE verdict END, CAST(CASE WHEN s = 0 AND k % 3 = 0 THEN NULL ELSE buy_now END AS INTEGER) FROM v
UNION ALL SELECT NULL, FALSE, 'NO_MATCH', NULL FROM v WHERE s = 5"""),
    "recheck_matches": _paged("""
SELECT url, CASE WHEN lost THEN 'NO_MATCH' ELSE verdict END AS verdict, TRUE AS is_active, CASE WHEN lost THEN '即決価格が削除されました (ステータス再確認時に検出)' END AS reason
FROM (SELECT url, verdict, page_verdicts.s = 0 AND k % 3 = 0 AS lost FROM page_verdicts JOIN signals USING (k) WHERE verdict = 'MATCH')"""),
    "page_selectors": """
SELECT p_partkey AS k, 'スーツ ' || p_partkey AS title_text, p_partkey || '円' AS price_text, CASE WHEN p_partkey % 2 = 0 THEN '出品中' ELSE '' END AS status_text,
  '肩幅：' || p_partkey % 9 || 'cm' || chr(10) || '裾シングル & 他' AS description_text, '' AS specs_text, 'メンズ' || p_partkey % 3 AS brand_text, 'メンズ' || p_partkey % 3 AS category_text FROM part""",
    "nested_selectors": """
SELECT p_partkey AS k, 'スーツ ' || p_partkey AS title_text, '現在 ' || p_partkey || '円' AS price_text, CASE WHEN p_partkey % 2 = 0 THEN '出品中' || chr(10) || '残り 3日' ELSE '' END AS status_text,
  concat_ws(chr(10), '肩幅：' || p_partkey % 9 || 'cm', '身幅 52cm', '一', '二', '股下', '裾', '終わり') AS description_text,
  'サイズ' || chr(9) || p_partkey % 50 || chr(10) || '素材' || chr(9) || 'ウール100%' AS specs_text, 'メンズ' AS brand_text, 'メンズ > スーツ' AS category_text,
  '//i/' || p_partkey || '.jpg //i/b.jpg?a=1&b=2' AS image_urls FROM part""",
    "page_elements": rf"""
WITH p AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>.*</article>') AS article, regexp_extract(html, '(?s)<nav>.*</nav>') AS nav FROM pages),
t AS (
  SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(article, '(?s)<h1>(.*?)</h1>', 1) AS heading,
    array_to_string(regexp_extract_all(nav, '<a href="([^"]*)"', 1), ' ') AS links, array_to_string(regexp_extract_all(nav, '<a [^>]*>([^<]*)</a>', 1), ' ') AS names,
    regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS footer, CAST(len(regexp_extract_all(article, '<p>')) AS INTEGER) AS n_paragraphs,
    regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS advert FROM p
)
SELECT page_id, n_paragraphs, {_decoded("title", "heading", "links", "names", "footer", "advert")} FROM t""",
    "item_urls": """
WITH r AS (
  SELECT p_partkey AS k, unnest([0, 1, 0, 1]) AS rank, unnest(['m' || p_partkey, 'm' || (p_partkey + 1), 'x' || p_partkey, 'y' || p_partkey]) AS site_id FROM part
)
SELECT k, rank, CASE site_id[1] WHEN 'm' THEN 'https://jp.mercari.com/item/' WHEN 'x' THEN 'https://auctions.yahoo.co.jp/jp/auction/' ELSE 'https://page.auctions.yahoo.co.jp/jp/auction/' END || site_id AS url, site_id FROM r""",
    "item_url_round_trip": "SELECT p_partkey AS k, 'https://auctions.yahoo.co.jp/jp/auction/x' || p_partkey AS url, 'x' || p_partkey AS site_id, 1 AS n FROM part",
    "stored_packages": _listed(
        "SELECT k, CASE WHEN k % 10 <> 9 THEN verdict END AS verdict, CASE WHEN k % 10 <> 9 THEN score END AS score, CASE WHEN k % 10 = 9 THEN 'no evidence' END AS error FROM listed"
    ),
    "broken_packages": _listed("""
SELECT CASE WHEN k % 10 = 3 THEN 'broken record' END AS error, CASE WHEN k % 10 <> 3 THEN verdict END AS verdict, count(*) AS n,
  count(*) FILTER (WHERE k % 10 = 3) AS texts, count(*) FILTER (WHERE k % 10 <> 3) AS scores FROM listed GROUP BY 1, 2"""),
    "fill_passes": """
WITH t AS (SELECT p_partkey AS k, p_partkey % 5 AS c, p_partkey % 3 > 0 AS pictured, p_partkey % 2 = 0 AS filled, p_partkey % 4 = 0 AS sized FROM part)
SELECT k, 'text' AS pass, 'size' AS about, 0 AS n_images FROM t WHERE c IN (0, 1, 4)
UNION ALL SELECT k, 'text', 'material', 0 FROM t WHERE c IN (1, 4)
UNION ALL SELECT k, 'image', 'size', 1 FROM t WHERE c IN (0, 4) AND pictured AND NOT sized
UNION ALL SELECT k, 'image', 'material', 1 FROM t WHERE c IN (1, 4) AND pictured AND NOT filled""",
    "logged_outcomes": """
SELECT user_id % 2 AS run_id, count(*) AS total, count(*) FILTER (WHERE event_id % 4 = 0) AS crawled, count(*) FILTER (WHERE event_id % 4 = 1) AS status_rechecked, count(*) FILTER (WHERE event_id % 4 = 2) AS skipped,
  count(*) FILTER (WHERE event_id % 4 = 3) AS errors, count(*) FILTER (WHERE event_id % 4 < 2) AS reviews FROM events GROUP BY user_id % 2""",
    "streamed_listings": _paged("SELECT url, verdict, n_blocking, TRUE AS is_active FROM page_verdicts JOIN signals USING (k)"),
    "found_by_id": _listed(
        "SELECT url, verdict FROM listed WHERE sha256(url) = 'f8279f5c6d45126f7d242c99160193f5e89b84391a801f021e881dd53f0f3201'"
    ),
    "listing_warnings": _listed("""
SELECT k, array_to_string(list_filter([
  CASE WHEN k % 5 = 0 THEN '胸囲 ' || 2 * chest || 'cm → 身幅 ' || chest || 'cm に換算して判定' END,
  CASE WHEN k % 4 = 2 THEN 'ウエスト ' || CAST(40 + k % 30 AS DOUBLE) || 'cm: ' || CASE WHEN 40 + k % 30 <= 60 THEN '平置きと仮定' ELSE '周囲と仮定' END || ' (明示なし)' END,
  CASE WHEN k % 7 = 4 THEN '表地素材を特定できませんでした' END,
  CASE k % 6 WHEN 2 THEN 'ひどい汚れの記述あり' WHEN 4 THEN '汚れの記述あり' END, CASE WHEN k % 6 = 3 THEN '穴・破れの記述あり' END
], lambda x: x IS NOT NULL), ' | ') AS warnings FROM listed"""),
    "listing_size_tables": """
WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '3XL' WHEN 1 THEN '2XL' WHEN 2 THEN 'M' WHEN 3 THEN '3XL' ELSE 'XS' END AS size, p_partkey % 6 = 5 AS single FROM part)
SELECT k, CAST(CASE WHEN single THEN 43 WHEN size = '3XL' THEN 46 WHEN size = '2XL' THEN 44 WHEN size = 'M' THEN 43 END AS DOUBLE) AS shoulder,
  CAST(CASE WHEN single THEN 60 WHEN size = '3XL' THEN 63 WHEN size = '2XL' THEN 61 WHEN size = 'M' THEN 60 END AS DOUBLE) AS sleeve,
  CASE WHEN single THEN '' ELSE 'サイズ表を検出: ''' || size || ''' 行のみを使用して判定しました' END AS warnings FROM t""",
    "listing_shipping": """
WITH t AS (SELECT p_partkey AS k, p_partkey % 6 AS c, 5000 + p_partkey AS p, 500 + p_partkey % 500 AS s FROM part)
SELECT k, CASE WHEN c < 4 THEN 'buy_now_only' WHEN c = 5 THEN 'fixed_price' END AS listing_type, CAST(CASE c WHEN 0 THEN s WHEN 1 THEN 0 WHEN 2 THEN 0 END AS INTEGER) AS shipping, CASE WHEN c IN (1, 2) THEN TRUE END AS included,
  concat_ws(' | ', CASE WHEN c < 4 THEN '即決: ' || p || '円' END, CASE c WHEN 0 THEN '送料: ' || s || '円' WHEN 1 THEN '送料込み' WHEN 2 THEN '送料込み' END, CASE WHEN c = 5 THEN '販売価格: ' || k || '円' END) AS evidence,
  concat_ws(' | ', CASE WHEN c = 4 THEN 'listing_type' END, CASE WHEN c < 5 THEN 'current_price_jpy' END, CASE WHEN c = 4 THEN 'buy_now_price_jpy' END, CASE WHEN c > 2 THEN 'shipping_price_jpy' END) AS unknown_fields,
  CASE WHEN c = 4 THEN 'listing_type を特定できませんでした' ELSE '' END AS warnings, CASE WHEN c = 4 THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM t""",
    "listing_status_fallback": """
WITH t AS (SELECT p_partkey AS k, p_partkey % 5 AS c, p_partkey % 9 = 8 AS odd FROM part)
SELECT k, CASE c WHEN 0 THEN 'sold' WHEN 1 THEN 'sold' WHEN 2 THEN 'ended' WHEN 3 THEN 'active' ELSE 'unknown' END AS state,
  CASE c WHEN 0 THEN 'SOLD OUT' WHEN 1 THEN '落札済み' WHEN 2 THEN '終了' WHEN 3 THEN '残り 3日' ELSE CASE WHEN odd THEN 'お取り置き' ELSE '紺のスーツ' || chr(10) || 'よい品です' END END AS raw,
  CASE c WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.75::DOUBLE WHEN 3 THEN 0.75::DOUBLE ELSE 0.3::DOUBLE END AS confidence,
  CASE WHEN c = 4 THEN '販売状態を特定できませんでした' ELSE '' END AS warnings FROM t""",
    "listing_priorities": """
WITH t AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS specs, p_partkey % 2 = 0 AS described, p_partkey % 4 = 0 AS one FROM part)
SELECT k, CAST(CASE WHEN specs THEN 43 WHEN described THEN 44 ELSE 45 END AS DOUBLE) AS shoulder, 'cm' AS unit, CASE WHEN specs THEN '肩幅 43cm' WHEN described THEN '肩幅 44cm' ELSE '肩幅 45cm' END AS evidence,
  CASE WHEN specs THEN 'specs' WHEN described THEN 'description' ELSE 'title' END AS source, CASE WHEN specs THEN 0.855::DOUBLE WHEN described THEN 0.765::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
  CASE WHEN specs THEN 'mohair=100' WHEN described THEN 'cotton=70,nylon=30' ELSE 'wool=100' END AS fibers, 'double' AS button_type, CASE WHEN one THEN 1 ELSE 3 END AS button_count, 0.9::DOUBLE AS style_confidence,
  CASE WHEN described THEN 'A' WHEN specs THEN 'D' END AS grade, CASE WHEN described THEN FALSE ELSE TRUE END AS has_hole, TRUE AS has_stain,
  CASE WHEN described THEN 0.722::DOUBLE ELSE 0.9::DOUBLE END AS condition_confidence FROM t""",
    "listing_pants": """
WITH t AS (SELECT p_partkey AS k, 18 + p_partkey % 25 AS rise, 68 + p_partkey % 9 AS inseam, 15 + p_partkey % 6 AS hem, 25 + p_partkey % 9 AS thigh, 95 + p_partkey % 50 AS total, 55 + p_partkey % 40 AS len FROM part)
SELECT k, CAST(CASE WHEN rise BETWEEN 20 AND 40 THEN rise END AS DOUBLE) AS rise, CAST(hem AS DOUBLE) AS hem_width, CAST(thigh AS DOUBLE) AS thigh, CAST(CASE WHEN total BETWEEN 85 AND 130 THEN total END AS DOUBLE) AS total_length,
  CAST(CASE WHEN len BETWEEN 60 AND 90 THEN len END AS DOUBLE) AS length,
  concat_ws(' | ', CASE WHEN inseam <= 70 THEN '股下 ' || inseam || '.0cm は絶対NG (70cm以下)' WHEN inseam < 74 THEN '股下 ' || inseam || '.0cm が最低値 74.0cm を下回っています' END,
    CASE WHEN hem < 18 THEN '裾幅 ' || hem || '.0cm が下限 18.0cm を下回っています' END, CASE WHEN thigh < 29 THEN 'ワタリ ' || thigh || '.0cm が下限 29.0cm を下回っています' END) AS blocking FROM t""",
    "custom_rules": _listed(
        """
SELECT k, coalesce(coalesce(buy_now, current_price) > (SELECT floor(avg(5000 + p_partkey * 37 % 40000)) FROM part), FALSE) AS too_dear, 15 AS n_rules FROM listed"""
    ),
}
