"""The registered queries over the given tables, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as E
from ..operators import fill, frontier, rules, store
from ..operators.extract import extract
from .decisions import decide_signals, extract_signals, reparse
from .listings import EXPECTED_SQL, listing_signals, parts

#: The moment that routing and views take for now.
NOW = "2024-06-02 00:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_package(listing_signals(parts(spark, sf_dir)))


def _attributes(spark: SparkSession, sf_dir: str, *which: str) -> DataFrame:
    """Every listing with its key k and the named attributes."""
    return extract_signals(listing_signals(parts(spark, sf_dir)).withColumnRenamed("p_partkey", "k"), which, distinct=False)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with its decision."""
    return decide_signals(listing_signals(parts(spark, sf_dir)), distinct=False).withColumnRenamed("p_partkey", "k")


# --- documents and pages ------------------------------------------------------------------------------------


def doc_clean_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", X.norm_ws(X.norm_colon(X.strip_tags(F.col("text")))).alias("clean"))


def doc_blocks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    lines = docs.select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    ).select("doc_id", "pos", F.trim("line").alias("text"))
    return E.drop_noise(lines.filter(F.col("text") != "")).select("doc_id", "pos", "text")


def doc_dedup_evidence(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").filter(F.col("source").isNotNull() & F.col("text").isNotNull())
    rows = docs.select(
        F.col("source").alias("item_id"), F.col("doc_id").alias("pos"), "text",
        ((F.col("doc_id") % 7).cast("double") / 10).alias("confidence"),
    )
    return E.dedup_evidence(rows).select(F.col("item_id").alias("source"), F.col("pos").alias("doc_id"), "confidence")


def page_item_urls(spark, sf_dir):
    return frontier.extract_item_urls(
        _table(spark, sf_dir, "pages").select("page_id", "html"), site=None,
    ).select("page_id", F.col("rank").cast("long").alias("rank"), "url")


def page_site_route(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", E.detect_site(F.col("url")).alias("site"))


# --- frontier -----------------------------------------------------------------------------------------------


def frontier_build(spark, sf_dir):
    queries = _table(spark, sf_dir, "customer").select(F.concat(F.lit("suit "), F.lower("c_name")).alias("query"))
    return frontier.build_frontier(queries, max_pages=3).select("query", "source", "page", "search_url")


def frontier_dedup(spark, sf_dir):
    """Orders as search results: every customer's pages hold the URLs of the order's totals."""
    orders = _table(spark, sf_dir, "orders")
    pages = orders.select(
        F.concat(F.lit("q"), (F.col("o_custkey") % 50).cast("string")).alias("query"), F.col("o_orderpriority").alias("source"),
        (F.col("o_orderkey") % 20 + 1).cast("int").alias("page"),
        F.when(F.col("o_orderkey") % 97 == 0, F.array().cast("array<string>")).otherwise(
            F.array(
                F.concat(F.lit("u"), (F.col("o_orderkey") % 5000).cast("string")),
                F.concat(F.lit("u"), (F.col("o_orderkey") % 4999).cast("string")),
            )
        ).alias("urls"),
    )
    return frontier.dedup_frontier(pages).select("query", "source", "page", F.col("rank").cast("int").alias("rank"), "url")


def _routed(spark, sf_dir) -> DataFrame:
    """Parts looked for, against a store that orders made: every third key is stored."""
    wanted = _table(spark, sf_dir, "part").select(
        F.lit("q").alias("query"), F.lit("s").alias("source"), (F.col("p_partkey") % 12 + 1).alias("page"),
        F.col("p_partkey").alias("rank"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"),
    )
    k = F.col("o_orderkey")
    stored = _table(spark, sf_dir, "orders").filter(k % 3 == 0).select(
        F.concat(F.lit("u"), k.cast("string")).alias("url"),
        F.when(k % 5 == 0, "MATCH").when(k % 5 < 3, "REVIEW").otherwise("NO_MATCH").alias("verdict"),
        (k % 5).between(1, 2).alias("needs_recheck"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval(hours=(k % 150).cast("int"))).alias("retrieved_at"),
    )
    return frontier.frontier_join_store(wanted, stored).withColumn(
        "action", frontier.route_action(F.col("stored"), F.lit(NOW).cast("timestamp"), 3),
    )


def route_actions(spark, sf_dir):
    return _routed(spark, sf_dir).select("url", "action")


def target_limit(spark, sf_dir):
    return frontier.target_limit(_routed(spark, sf_dir), target_new=50, max_pages=10).select("url", "page", "action")


def frontier_not_seen(spark, sf_dir):
    """Parts whose key no order of the first half of a five-day cycle of keys has."""
    k = F.col("o_orderkey")
    seen = _table(spark, sf_dir, "orders").filter(k % 5 < 3).select(F.concat(F.lit("u"), k.cast("string")).alias("url"))
    return frontier.not_in_seen(_routed(spark, sf_dir), seen).select("url")


def batch_summary(spark, sf_dir):
    """Events as outcomes of runs: a run per user."""
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id")
    outcomes = e.select(
        F.col("user_id").alias("run_id"),
        F.element_at(
            F.array(F.lit("crawled"), F.lit("status_rechecked"), F.lit("skipped"), F.lit("error")), (k % 4 + 1).cast("int"),
        ).alias("action"),
        F.when(k % 4 < 2, F.element_at(F.array(*[F.lit(v) for v in rules.VERDICTS]), (k % 3 + 1).cast("int"))).alias("verdict"),
    )
    out = frontier.batch_summary(outcomes)
    return out.select(
        "run_id", "total", "crawled", "status_rechecked", "skipped", "errors", "matches", "reviews", "no_matches",
        F.col("verdicts")["REVIEW"].alias("reviews_in_map"),
    )


# --- units --------------------------------------------------------------------------------------------------


def unit_parse(spark, sf_dir):
    p, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    raw = F.when(
        k % 3 == 0, F.concat((F.col("p_size") * 10).cast("string"), F.lit(" mm")),
    ).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5ＣＭ")))
    cm = X.parse_cm(X.nfkc(raw))
    return p.select(
        "p_partkey", cm.alias("cm"), X.cm_to_mm(cm).alias("mm"),
        X.parse_jpy(F.concat(F.format_string("  %,d", k * 1000), F.lit(" 円"))).alias("jpy"),
        X.plausible("pants_rise_cm", cm).alias("plausible"),
    )


def fiber_aliases(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("毛", "WOOL", "ポリ", "Cotton", "カシミヤ", "人絹", "Denim")])
    return _table(spark, sf_dir, "part").select(
        "p_partkey", X.alias_lookup(F.element_at(words, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("fiber"),
    )


# --- listings -----------------------------------------------------------------------------------------------


def listing_evidence(spark, sf_dir):
    signals = _signals(spark, sf_dir).withColumn("item_id", F.col("p_partkey").cast("string"))
    blocks = E.clean_blocks(E.signals_to_evidence(signals))
    return blocks.groupBy(F.col("item_id").cast("long").alias("k"), "source").agg(
        F.count("*").alias("n"), F.max("confidence").alias("confidence"),
    )


def listing_sizes(spark, sf_dir):
    size = F.col("size")
    value = lambda part, f: size[part][f]["value"]
    return _attributes(spark, sf_dir, "size").select(
        "k", value("jacket", "shoulder_cm").alias("shoulder"), value("jacket", "chest_width_cm").alias("chest"),
        value("jacket", "sleeve_cm").alias("sleeve"), value("pants", "waist_flat_cm").alias("waist_flat"),
        value("pants", "waist_circumference_cm").alias("waist_girth"), value("pants", "inseam_cm").alias("inseam"),
        value("pants", "hem_finish").alias("hem"), F.size(size["unknown_fields"]).alias("size_unknown"),
        size["confidence"].alias("confidence"),
    )


def listing_prices(spark, sf_dir):
    price = F.col("price")
    return _attributes(spark, sf_dir, "price").select(
        "k", price["listing_type"].alias("listing_type"), price["current_price_jpy"].alias("current_price"),
        price["buy_now_price_jpy"].alias("buy_now"), price["confidence"].alias("confidence"),
    )


def listing_status(spark, sf_dir):
    return _attributes(spark, sf_dir, "status").select(
        "k", F.col("status")["normalized_status"].alias("state"), F.col("status")["confidence"].alias("confidence"),
    )


def _said(fibers) -> F.Column:
    return F.array_join(F.transform(fibers, lambda f: F.concat(f["fiber"], F.lit("="), f["percentage"].cast("string"))), ",")


def listing_fibers(spark, sf_dir):
    m = F.col("material")
    return _attributes(spark, sf_dir, "material").select(
        "k", _said(m["outer_fibers"]).alias("outer_fibers"), _said(m["lining_fibers"]).alias("lining_fibers"),
    )


def listing_style(spark, sf_dir):
    s = F.col("style")
    return _attributes(spark, sf_dir, "style").select(
        "k", s["button_type"].alias("button_type"), s["button_count"].alias("button_count"),
        s["button_color"].alias("button_color"),
    )


def listing_condition(spark, sf_dir):
    c = F.col("condition")
    return _attributes(spark, sf_dir, "condition").select(
        "k", c["grade"].alias("grade"), c["has_stain"].alias("has_stain"), c["has_hole"].alias("has_hole"),
    )


def listing_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select(
        "k", "url", "source_site", "verdict", "score", "needs_llm_review", "needs_human_review", "needs_recheck",
    )


def listing_reasons(spark, sf_dir):
    return _decided(spark, sf_dir).select(
        "k", F.array_join("blocking_reasons", " | ").alias("blocking"), F.array_join("reasons", " | ").alias("notes"),
    )


def reparse_packages(spark, sf_dir):
    """Packages stored as nested, raw blocks and decided anew."""
    signals = _signals(spark, sf_dir).withColumn("item_id", F.col("p_partkey").cast("string"))
    packages = E.nest_evidence(E.signals_to_evidence(signals))
    return reparse(packages, distinct=False).select(F.col("item_id").cast("long").alias("k"), "verdict", "score")


def listing_view(spark, sf_dir):
    out = store.listing_view(_decided(spark, sf_dir).withColumn("is_active", F.lit(True)))
    return out.select("url", "source_label", "title", "price_jpy", "thumbnail", "jacket_chest_cm", "pants_waist_cm", "retrieved_at")


def verdict_counts(spark, sf_dir):
    return store.count_by_verdict(_decided(spark, sf_dir))


def verdict_stats(spark, sf_dir):
    return store.verdict_stats(_decided(spark, sf_dir))


def top_listings(spark, sf_dir):
    return store.top_listings(_decided(spark, sf_dir), sort="score", limit=100).select("url", "verdict", "score")


def recent_listings(spark, sf_dir):
    return store.top_listings(_decided(spark, sf_dir), "NO_MATCH", sort="recent", limit=200).select("url", "verdict")


def site_report(spark, sf_dir):
    out = store.report(_decided(spark, sf_dir))
    return out.select(
        "source_site", "verdict", "n", F.round("mean_score", 6).alias("mean_score"),
        F.array_join(
            F.transform("top_reasons", lambda r: F.concat(r["reason"], F.lit("="), r["n"].cast("string"))), " | ",
        ).alias("top_reasons"),
    )


# --- store --------------------------------------------------------------------------------------------------


def latest_record(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("seq"), "event_type", "value")
    return store.latest_per_url(rows)


def recheck_downgrade(spark, sf_dir):
    """Listings looked at again after every third lost its buy-now price."""
    stored = _decided(spark, sf_dir).select("url", "verdict", "price")
    pages = listing_signals(parts(spark, sf_dir), changed=True)
    again = extract_signals(pages, ("status", "price"), distinct=False)
    return store.recheck_join(stored, again, pages.select("url")).select("url", "verdict", "is_active", "reason")


def store_fold(spark, sf_dir):
    """Decisions upserted; then some listings got a status, a manual verdict, or were deleted."""
    decided = _decided(spark, sf_dir).select("url", "k", "verdict", "blocking_reasons", "needs_recheck", "status")
    part, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    urls = listing_signals(part).select("url", "p_partkey")
    seq = lambda n: F.lit(n).cast("long")
    state = F.struct(
        F.lit("ended").alias("normalized_status"), F.lit("終了").alias("raw_status"), F.lit("終了").alias("evidence"),
        F.lit(0.9).alias("confidence"), F.array().cast("array<string>").alias("warnings"),
    )
    told = urls.filter(k % 4 == 0).select("url", F.lit(False).alias("is_active"), state.alias("status"))
    log = (
        store.upsert_changes(decided, seq(1))
        .unionByName(store.status_changes(told, seq(2)), allowMissingColumns=True)
        .unionByName(store.mark_ng(urls.filter(k % 5 == 0), seq(3)), allowMissingColumns=True)
        .unionByName(store.mark_ok(urls.filter(k % 10 == 0), seq(4)), allowMissingColumns=True)
        .unionByName(store.delete_changes(urls.filter(k % 11 == 0), seq(5)), allowMissingColumns=True)
    )
    out = store.fold_changes(log)
    return out.select(
        "url", "verdict", F.size("blocking_reasons").alias("n_blocking"), "needs_recheck",
        F.col("status")["normalized_status"].alias("state"), "is_active", "manual_override",
    )


def store_upsert(spark, sf_dir):
    """A snapshot of orders whose even ones are replaced."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_totalprice").alias("score"))
    return store.upsert_listings(orders, orders.filter(F.col("url") % 2 == 0).withColumn("score", F.col("score") * 2))


def active_matches(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("url"),
        F.when(F.col("o_orderstatus") == "F", "MATCH").otherwise("REVIEW").alias("verdict"),
        (F.col("o_orderkey") % 2 == 0).alias("is_active"),
    )
    return store.active_matches(rows).select("url")


def jst_day_delete(spark, sf_dir):
    """The events that are left once those of a day in Japan are deleted."""
    events = _table(spark, sf_dir, "events")
    return store.delete_jst_day(events, "2024-01-02", "ts").select("event_id")


def find_listing(spark, sf_dir):
    return store.find_by_url(_decided(spark, sf_dir), "https://jp.mercari.com/item/m7").select("url", "verdict", "score")


# --- external fills -----------------------------------------------------------------------------------------


def fill_candidates(spark, sf_dir):
    asked = fill.ml_fill_requests(fill.ml_fill_candidates(_attributes(spark, sf_dir, "size", "material")), keep=("k",))
    return asked.select("k", "about", F.col("prompt").contains("null").alias("asks"))


def fill_merge(spark, sf_dir):
    """Every listing gets a result with a length, a rise that is sometimes absurd, a waist, and fibres."""
    rows = _attributes(spark, sf_dir, "size", "material")
    k = F.col("k")
    result = F.to_json(
        F.struct(
            (60 + k % 31).alias("jacket_length_cm"), (15 + k % 31).cast("string").alias("pants_rise_cm"),
            (50 + k % 30).alias("pants_waist_flat_cm"), F.lit(1.0).alias("jacket_shoulder_cm"),
            F.array(F.struct(F.lit("silk").alias("fiber"), F.lit(100).alias("percentage"))).alias("outer_fibers"),
        )
    )
    items = _signals(spark, sf_dir).withColumnRenamed("p_partkey", "k")
    results = items.select("item_id", F.lit("text").alias("pass"), F.parse_json(result).alias("result"))
    out = fill.ml_fill_join(rows, results)
    size, value = F.col("size"), lambda part, f: F.col("size")[part][f]["value"]
    return out.select(
        "k", value("jacket", "shoulder_cm").alias("shoulder"), value("jacket", "length_cm").alias("length"),
        value("pants", "rise_cm").alias("rise"), value("pants", "waist_flat_cm").alias("waist_flat"),
        value("pants", "waist_circumference_cm").alias("waist_girth"), F.size(size["unknown_fields"]).alias("size_unknown"),
        _said(F.col("material")["outer_fibers"]).alias("outer_fibers"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        doc_clean_text, doc_blocks, doc_dedup_evidence, page_item_urls, page_site_route, frontier_build, frontier_dedup,
        route_actions, target_limit, frontier_not_seen, batch_summary, unit_parse,
        fiber_aliases, listing_evidence, listing_sizes, listing_prices, listing_status, listing_fibers, listing_style,
        listing_condition, listing_decisions, listing_reasons, reparse_packages,
        listing_view, verdict_counts, verdict_stats, top_listings, recent_listings, site_report, latest_record, recheck_downgrade,
        store_fold, store_upsert, active_matches, jst_day_delete,
        find_listing, fill_candidates, fill_merge,
    )
}


def _listed(select: str) -> str:
    return f"WITH {EXPECTED_SQL} {select}"


_FIBERS_LEFT = "CASE WHEN k % 7 = 4 THEN 'silk=100' ELSE outer_fibers END"

ORACLE_SQL = {
    "doc_clean_text": r"SELECT doc_id, trim(regexp_replace(translate(regexp_replace(text, '<[^>]+>', ' ', 'g'), '：／', ':/'), '\s+', ' ', 'g')) AS clean FROM documents",
    "doc_blocks": r"""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, text FROM (
  SELECT doc_id, unnest(range(len(parts))) AS pos, trim(unnest(parts)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
) WHERE length(text) >= 3 AND NOT regexp_matches(text, '^\d+$')""",
    "doc_dedup_evidence": """
SELECT source, doc_id, confidence FROM (
  SELECT source, doc_id, CAST(doc_id % 7 AS DOUBLE) / 10 AS confidence, row_number() OVER (PARTITION BY source, text ORDER BY doc_id % 7 DESC, doc_id) AS r
  FROM documents WHERE source IS NOT NULL AND text IS NOT NULL
) WHERE r = 1""",
    "page_item_urls": r"""
WITH links AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=["'']([^"'']*)["'']', 1) AS l FROM pages),
rows AS (SELECT page_id, unnest(range(len(l))) AS i, string_split(unnest(l), '?')[1] AS url FROM links),
firsts AS (SELECT page_id, url, min(i) AS i FROM rows GROUP BY page_id, url)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS rank, url FROM firsts""",
    "page_site_route": """
SELECT page_id, CASE WHEN url LIKE '%mercari.com%' THEN 'mercari' WHEN url LIKE '%store.shopping.yahoo.co.jp%' THEN 'yahoo_shopping'
  WHEN url LIKE '%paypayfleamarket.yahoo.co.jp%' THEN 'paypay_flea_market' ELSE 'yahoo_auctions' END AS site FROM pages""",
    "frontier_build": """
WITH q AS (SELECT 'suit ' || lower(c_name) AS query FROM customer), p AS (SELECT query, CAST(unnest(range(1, 4)) AS INTEGER) AS page FROM q)
SELECT query, 'yahoo_auctions' AS source, page, 'https://auctions.yahoo.co.jp/search/search?p=' || replace(replace(query, ' ', '+'), '#', '%23') || '&b=' || ((page - 1) * 50 + 1) || '&n=50&s1=new&o1=d&auccat=23176&max=30000' AS search_url FROM p
UNION ALL SELECT query, 'mercari', page, 'https://jp.mercari.com/search?keyword=' || replace(replace(query, ' ', '+'), '#', '%23') || '&status=on_sale&sort=SORT_CREATED_TIME&order=ORDER_DESC&price_max=30000' || CASE WHEN page > 1 THEN '&page_token=v1%3A' || page ELSE '' END FROM p""",
    "frontier_dedup": """
WITH pages AS (
  SELECT 'q' || (o_custkey % 50) AS query, o_orderpriority AS source, CAST(o_orderkey % 20 + 1 AS INTEGER) AS page,
    CASE WHEN o_orderkey % 97 = 0 THEN [] ELSE ['u' || (o_orderkey % 5000), 'u' || (o_orderkey % 4999)] END AS urls FROM orders
), ends AS (SELECT query, source, min(page) FILTER (WHERE len(urls) = 0) AS e FROM pages GROUP BY query, source),
rows AS (SELECT p.query, p.source, page, unnest([0, 1]) AS rank, unnest(urls) AS url FROM pages p JOIN ends USING (query, source) WHERE len(urls) > 0 AND (e IS NULL OR page < e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source, page, rank, query) AS r FROM rows)
SELECT query, source, page, CAST(rank AS INTEGER) AS rank, url FROM ranked WHERE r = 1""",
    "route_actions": """
SELECT 'u' || p_partkey AS url, CASE WHEN s.o_orderkey IS NULL THEN 'full_crawl' WHEN s.o_orderkey % 5 = 0 THEN 'status_recheck'
  WHEN s.o_orderkey % 5 IN (3, 4) AND s.o_orderkey % 150 < 72 THEN 'skip' ELSE 'full_crawl' END AS action
FROM part LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) s ON s.o_orderkey = p_partkey""",
    "target_limit": """
WITH r AS (SELECT p_partkey AS k, CASE WHEN s.o_orderkey IS NULL THEN 'full_crawl' WHEN s.o_orderkey % 5 = 0 THEN 'status_recheck'
  WHEN s.o_orderkey % 5 IN (3, 4) AND s.o_orderkey % 150 < 72 THEN 'skip' ELSE 'full_crawl' END AS action
FROM part LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) s ON s.o_orderkey = p_partkey)
SELECT 'u' || k AS url, k % 12 + 1 AS page, action FROM r WHERE action <> 'skip' AND k % 12 + 1 <= 10 ORDER BY k % 12 + 1, k LIMIT 50""",
    "frontier_not_seen": "SELECT 'u' || p_partkey AS url FROM part WHERE p_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 < 3)",
    "batch_summary": """
WITH o AS (SELECT user_id AS run_id, ['crawled', 'status_rechecked', 'skipped', 'error'][event_id % 4 + 1] AS action,
  CASE WHEN event_id % 4 < 2 THEN ['MATCH', 'REVIEW', 'NO_MATCH'][event_id % 3 + 1] END AS verdict FROM events)
SELECT run_id, count(*) AS total, count(*) FILTER (WHERE action = 'crawled') AS crawled, count(*) FILTER (WHERE action = 'status_rechecked') AS status_rechecked, count(*) FILTER (WHERE action = 'skipped') AS skipped,
  count(*) FILTER (WHERE action = 'error') AS errors, count(*) FILTER (WHERE verdict = 'MATCH') AS matches, count(*) FILTER (WHERE verdict = 'REVIEW') AS reviews, count(*) FILTER (WHERE verdict = 'NO_MATCH') AS no_matches,
  nullif(count(*) FILTER (WHERE verdict = 'REVIEW'), 0) AS reviews_in_map FROM o GROUP BY run_id""",
    "unit_parse": """
SELECT p_partkey, cm, cm * 10.0::DOUBLE AS mm, CAST(p_partkey * 1000 AS INTEGER) AS jpy, cm BETWEEN 20 AND 40 AS plausible
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_size + 0.5::DOUBLE END AS cm FROM part)""",
    "fiber_aliases": "SELECT p_partkey, ['wool', 'wool', 'polyester', 'cotton', 'cashmere', 'rayon', 'denim'][p_partkey % 7 + 1] AS fiber FROM part",
    "listing_evidence": """
WITH b AS (SELECT p_partkey AS k FROM part)
SELECT k, 'title' AS source, 1 AS n, 1.0::DOUBLE AS confidence FROM b UNION ALL SELECT k, 'price', 1, 1.0::DOUBLE FROM b UNION ALL SELECT k, 'status', 1, 1.0::DOUBLE FROM b
UNION ALL SELECT k, 'category', 1, 0.8::DOUBLE FROM b
UNION ALL SELECT k, 'description', 6 + CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 7 <> 4 THEN 1 ELSE 0 END + CASE WHEN k % 6 <> 5 THEN 1 ELSE 0 END, 0.85::DOUBLE FROM b""",
    "listing_sizes": _listed(
        "SELECT k, shoulder, chest, sleeve, waist_flat, waist_girth, inseam, hem, size_unknown, 1.0::DOUBLE AS confidence FROM listed"
    ),
    "listing_prices": _listed("SELECT k, listing_type, current_price, buy_now, 0.9::DOUBLE AS confidence FROM listed"),
    "listing_status": _listed("SELECT k, state, CASE WHEN state = 'sold' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM listed"),
    "listing_fibers": _listed("SELECT k, outer_fibers, lining_fibers FROM listed"),
    "listing_style": _listed("SELECT k, button_type, button_count, button_color FROM listed"),
    "listing_condition": _listed("SELECT k, grade, has_stain, has_hole FROM listed"),
    "listing_decisions": _listed(
        "SELECT k, url, source_site, verdict, score, size_unknown > 3 AS needs_llm_review, verdict = 'REVIEW' AS needs_human_review, verdict = 'REVIEW' AS needs_recheck FROM listed"
    ),
    "listing_reasons": _listed(
        "SELECT k, array_to_string(blocking, ' | ') AS blocking, array_to_string(notes, ' | ') AS notes FROM listed"
    ),
    "reparse_packages": _listed("SELECT k, verdict, score FROM listed"),
    "listing_view": _listed("""
SELECT url, CASE k % 3 WHEN 0 THEN 'ヤフオク' WHEN 1 THEN 'メルカリ' ELSE 'PayPayフリマ' END AS source_label, '紺スーツ 品番' || k AS title, coalesce(buy_now, current_price) AS price_jpy, 'https://img/' || k AS thumbnail,
  chest AS jacket_chest_cm, waist_flat AS pants_waist_cm, strftime(TIMESTAMP '2024-06-01' - to_hours(CAST(k % 240 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS retrieved_at FROM listed"""),
    "verdict_counts": _listed("SELECT verdict, count(*) AS n FROM listed GROUP BY verdict"),
    "verdict_stats": _listed(
        "SELECT count(*) FILTER (WHERE verdict = 'MATCH') AS MATCH, count(*) FILTER (WHERE verdict = 'REVIEW') AS REVIEW, count(*) FILTER (WHERE verdict = 'NO_MATCH') AS NO_MATCH FROM listed"
    ),
    "top_listings": _listed("SELECT url, verdict, score FROM listed ORDER BY score DESC, url LIMIT 100"),
    "recent_listings": _listed("SELECT url, verdict FROM listed WHERE verdict = 'NO_MATCH' ORDER BY k % 240, url LIMIT 200"),
    "site_report": _listed("""
, totals AS (SELECT source_site, verdict, count(*) AS n, round(avg(score), 6) AS mean_score FROM listed GROUP BY ALL),
counted AS (SELECT source_site, verdict, reason, count(*) AS k FROM (SELECT source_site, verdict, unnest(blocking) AS reason FROM listed) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_site, verdict ORDER BY k DESC, reason) AS r FROM counted),
top AS (SELECT source_site, verdict, string_agg(reason || '=' || k, ' | ' ORDER BY r) AS top_reasons FROM ranked WHERE r <= 3 GROUP BY ALL)
SELECT totals.source_site, totals.verdict, n, mean_score, top_reasons FROM totals LEFT JOIN top USING (source_site, verdict)"""),
    "latest_record": "SELECT user_id AS url, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "recheck_downgrade": _listed("""
SELECT url, CASE WHEN lost THEN 'NO_MATCH' ELSE verdict END AS verdict, state = 'active' AS is_active, CASE WHEN lost THEN '即決価格が削除されました (ステータス再確認時に検出)' END AS reason
FROM (SELECT *, k % 3 = 0 AND buy_now IS NOT NULL AS lost FROM listed)"""),
    "store_fold": _listed("""
SELECT url, CASE WHEN k % 10 = 0 THEN 'MATCH' WHEN k % 5 = 0 THEN 'NO_MATCH' ELSE verdict END AS verdict, CAST(CASE WHEN k % 10 = 0 THEN 0 ELSE len(blocking) + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END END AS INTEGER) AS n_blocking,
  CASE WHEN k % 5 = 0 THEN FALSE ELSE verdict = 'REVIEW' END AS needs_recheck, CASE WHEN k % 4 = 0 THEN 'ended' ELSE state END AS state, k % 4 <> 0 AS is_active, CASE WHEN k % 10 = 0 THEN '手動OK' END AS manual_override
FROM listed WHERE k % 11 <> 0"""),
    "store_upsert": "SELECT o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS score FROM orders",
    "active_matches": "SELECT o_orderkey AS url FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0",
    "jst_day_delete": "SELECT event_id FROM events WHERE ts IS NULL OR NOT (ts >= TIMESTAMP '2024-01-01 15:00:00' AND ts < TIMESTAMP '2024-01-02 15:00:00')",
    "find_listing": _listed("SELECT url, verdict, score FROM listed WHERE url = 'https://jp.mercari.com/item/m7'"),
    "fill_candidates": _listed(
        "SELECT k, 'size' AS about, TRUE AS asks FROM listed UNION ALL SELECT k, 'material', TRUE FROM listed WHERE k % 7 = 4"
    ),
    "fill_merge": _listed(f"""
, f AS (SELECT *, CAST(60 + k % 31 AS DOUBLE) AS l, CAST(15 + k % 31 AS DOUBLE) AS r, CAST(50 + k % 30 AS DOUBLE) AS w FROM listed)
SELECT k, shoulder, l AS length, CASE WHEN r BETWEEN 20 AND 40 THEN r END AS rise, coalesce(waist_flat, CASE WHEN w <= 60 THEN w END) AS waist_flat,
  coalesce(waist_girth, CASE WHEN waist_flat IS NULL AND w > 60 THEN w END) AS waist_girth,
  CAST(size_unknown - 1 - CASE WHEN r BETWEEN 20 AND 40 THEN 1 ELSE 0 END - CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS size_unknown, {_FIBERS_LEFT} AS outer_fibers
FROM f"""),
}
