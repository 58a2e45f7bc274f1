"""Which URLs to look at: search pages, the URLs found on them, and what to do with each.

A frontier has query, source, page, rank and url; null URLs are never part of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.html import elements
from .stored import bitmap, maybe_in

#: The sort orders of the two sites that are searched, and the first category of one of them.
AUCTION_SORTS = {"new": ("new", "d"), "score": ("score", "d"), "price_asc": ("cbids", "a"), "price_desc": ("cbids", "d")}
MERCARI_SORTS = {"new": "SORT_CREATED_TIME", "score": "SORT_SCORE", "price_asc": "SORT_PRICE_ASC", "price_desc": "SORT_PRICE_DESC"}
CATEGORY = "23176"
ITEM_URL = r"https?://(?:page\.)?auctions\.yahoo\.co\.jp/(?:jp/)?auction/[a-zA-Z0-9]+"
MERCARI_ITEM = r"(?:https?://jp\.mercari\.com|^)/item/(m\w+)"


def _encode(text: Column) -> Column:
    """A query as in a form: spaces as +, the signs * and ~ as the reference of this format has them."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\*", "%2A"), "%7E", "~")


def auction_search_url(
    query: Column, page: Column, sort: str = "new", max_price: int | None = 30_000, min_price: int | None = None,
    category: str | None = CATEGORY,
) -> Column:
    s1, o1 = AUCTION_SORTS.get(sort, AUCTION_SORTS["new"])
    parts = [
        F.concat(F.lit("p="), _encode(query)), F.concat(F.lit("b="), ((page - 1) * 50 + 1).cast("string")),
        F.lit(f"n=50&s1={s1}&o1={o1}"),
    ]
    parts += [F.lit(f"{k}={v}") for k, v in (("auccat", category or None), ("min", min_price), ("max", max_price)) if v is not None]
    return F.concat(F.lit("https://auctions.yahoo.co.jp/search/search?"), F.concat_ws("&", *parts))


def mercari_search_url(query: Column, page: Column, sort: str = "new", max_price: int | None = 30_000) -> Column:
    order = MERCARI_SORTS.get(sort, MERCARI_SORTS["new"])
    parts = [F.concat(F.lit("keyword="), _encode(query)), F.lit(f"status=on_sale&sort={order}&order=ORDER_DESC")]
    if max_price is not None:
        parts.append(F.lit(f"price_max={max_price}"))
    parts.append(F.when(page > 1, F.concat(F.lit("page_token=v1%3A"), page.cast("string"))))
    return F.concat(F.lit("https://jp.mercari.com/search?"), F.concat_ws("&", *parts))


SEARCHES = {"yahoo_auctions": auction_search_url, "mercari": mercari_search_url}


def build_frontier(
    queries: DataFrame, max_pages: int = 10, sources: tuple[str, ...] = tuple(SEARCHES), sort: str = "new",
    max_price: int | None = 30_000,
) -> DataFrame:
    """query, source, page and search_url of the first pages of every query on every source."""
    pages = queries.select("query", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"), F.lit(max_pages).alias("n"))
    pages = pages.select("query", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    url = F.lit(None).cast("string")
    for source in sources:
        url = F.when(
            F.col("source") == source, SEARCHES[source](F.col("query"), F.col("page"), sort=sort, max_price=max_price),
        ).otherwise(url)
    return pages.withColumn("search_url", url)


def build_item_url(item_id: Column) -> Column:
    return F.concat(F.lit("https://auctions.yahoo.co.jp/jp/auction/"), item_id)


def item_urls_in_text(text: Column, pattern: str = ITEM_URL) -> Column:
    """The item URLs in a text, without their queries, each once in the order of their first occurrence."""
    urls = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(urls, lambda u: F.split(u, r"\?")[0]))


def item_urls_in_html(html: Column, site: str | None = "yahoo_auctions") -> Column:
    """The item URLs that a page's anchors point at; of any kind where no site is given."""
    links = elements(html, {"links": ("a", "@href")})["links"]
    if site == "mercari":
        ids = F.transform(links, lambda u: F.nullif(F.regexp_extract(u, MERCARI_ITEM, 1), F.lit("")))
        return F.array_distinct(F.transform(F.array_compact(ids), lambda i: F.concat(F.lit("https://jp.mercari.com/item/"), i)))
    if site:
        links = F.filter(links, lambda u: u.rlike(ITEM_URL))
    return F.array_distinct(F.transform(links, lambda u: F.split(u, r"\?")[0]))


def extract_item_urls(pages: DataFrame, site: str | None = "yahoo_auctions") -> DataFrame:
    """pages (html and any others) with one row per item URL and its rank from 0; html is dropped."""
    rest = [c for c in pages.columns if c != "html"]
    return pages.select(*rest, F.posexplode(item_urls_in_html(F.col("html"), site)).alias("rank", "url"))


def dedup_frontier(found: DataFrame) -> DataFrame:
    """Each URL once: at its first place by source, page and rank.

    found has a row for each page with an array of urls. A source ends at its first page without any.
    """
    end = Window.partitionBy("query", "source")
    first_empty = F.min(F.when(F.size("urls") <= 0, F.col("page"))).over(end)
    kept = found.withColumn("_end", first_empty).filter(F.col("_end").isNull() | (F.col("page") < F.col("_end")))
    rows = kept.select("query", "source", "page", F.posexplode("urls").alias("rank", "url")).filter(F.col("url").isNotNull())
    best = F.min(F.struct("source", "page", "rank", "query")).alias("b")
    return rows.groupBy("url").agg(best).select("b.query", "b.source", "b.page", "b.rank", "url")


def not_in_seen(frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """frontier without the URLs that were seen; most of these never leave their place, by a bitmap of the frontier's URLs."""
    known = maybe_in(seen.select("url"), "url", bitmap(frontier, "url"))
    return frontier.join(known.hint("merge"), "url", "left_anti")


def frontier_join_store(frontier: DataFrame, listings: DataFrame) -> DataFrame:
    """frontier with what the store knows of each URL, under `stored`; null for URLs that it doesn't have.

    Listings that aren't in the frontier stay out of the shuffle, by a bitmap of its URLs.
    """
    known = listings.select("url", F.struct("verdict", "needs_recheck", "retrieved_at").alias("stored"))
    return frontier.join(maybe_in(known, "url", bitmap(frontier, "url")).hint("merge"), "url", "left")


def route_action(stored: Column, now: Column, recrawl_after_days: int = 3) -> Column:
    """skip, status_recheck or full_crawl."""
    age = F.unix_timestamp(now) - F.unix_timestamp(stored["retrieved_at"])
    settled = ~F.coalesce(stored["needs_recheck"], F.lit(False))
    fresh = F.lit(True) if recrawl_after_days <= 0 else F.coalesce(age < recrawl_after_days * 86400, F.lit(False))
    return F.when(stored.isNull(), "full_crawl").when(
        stored["verdict"] == "MATCH", "status_recheck",
    ).when(settled & fresh, "skip").otherwise("full_crawl")


def target_limit(routed: DataFrame, target_new: int = 50, max_pages: int = 10) -> DataFrame:
    """The first `target_new` URLs that call for action, of the first pages; the others stay in the frontier."""
    wanted = routed.filter((F.col("action") != "skip") & (F.col("page") <= max_pages))
    return wanted.orderBy("page", "source", "rank", "url").limit(target_new)


def target_per_run(routed: DataFrame, target_new: int | Column = 50, max_pages: int = 10) -> DataFrame:
    """Per run the first URLs that call for action, as many as it wants, by page, source and rank; the others stay in the frontier.

    routed has run_id, source, page, rank, url and action. A run's source ends at its first page without results, which is a
    row whose url is null. `target_new` may be a column that is the same in all rows of a run; null wants nothing. Ranks that
    are equal are told apart by url. Null runs and sources are like any others.

    A running count over all rows isn't needed: pages are counted first, their offsets are sums over one row a page, and only
    the pages that begin before the target are read again. With a fixed target no task sends on more of a page than that.
    """
    page = ["run_id", "source", "page"]
    rows = routed.filter(F.col("page") <= max_pages).select(
        *page, "rank", "url", "action", F.lit(target_new).cast("long").alias("target"), F.struct("*").alias("whole"),
    )
    wanted = F.col("url").isNotNull() & ~F.col("action").eqNullSafe("skip")
    counts = rows.groupBy(*page).agg(F.count_if(wanted).alias("n"), F.max("target").alias("target"), F.bool_or(F.col("url").isNull()).alias("empty"))
    source = Window.partitionBy("run_id", "source")
    counts = counts.withColumn("end", F.min(F.when(F.col("empty"), F.col("page"))).over(source))
    counts = counts.filter(F.col("end").isNull() | (F.col("page") < F.col("end")))
    run = Window.partitionBy("run_id").orderBy("page", "source")
    counts = counts.withColumns({
        "before": F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "target": F.max("target").over(Window.partitionBy("run_id")),
    })
    begun = counts.filter((F.col("before") < F.col("target")) & (F.col("n") > 0))
    begun = begun.select(*[F.col(c).alias(f"_{c}") for c in page], (F.col("target") - F.col("before")).alias("room"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in page]
    placed = rows.filter(wanted).join(begun.hint("merge"), same).withColumn(
        "place", F.row_number().over(Window.partitionBy(*page).orderBy("rank", "url")),
    )
    if not isinstance(target_new, Column):
        placed = placed.filter(F.col("place") <= target_new)
    return placed.filter(F.col("place") <= F.col("room")).select("whole.*")


#: What is counted of the outcomes of a run.
COUNTERS = {
    "crawled": ("action", "crawled"), "status_rechecked": ("action", "status_rechecked"), "skipped": ("action", "skipped"), "errors": ("action", "error"),
    "matches": ("verdict", "MATCH"), "reviews": ("verdict", "REVIEW"), "no_matches": ("verdict", "NO_MATCH"),
}


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Per run: URLs, their actions, and how many got each verdict, also as a map. One pass: runs are summed up from their verdicts."""
    counted = [F.count_if(F.col(c).eqNullSafe(v)).alias(name) for name, (c, v) in COUNTERS.items()]
    parts = outcomes.groupBy("run_id", "verdict").agg(F.count("*").alias("total"), *counted)
    named = F.collect_list(F.when(F.col("verdict").isNotNull(), F.struct("verdict", F.col("total").alias("count"))))
    runs = parts.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("total", *COUNTERS)], F.array_sort(named).alias("_named"))
    verdicts = F.when(F.size("_named") > 0, F.map_from_entries("_named"))
    return runs.select("run_id", "total", *COUNTERS, verdicts.alias("verdicts"))


def observed_outcomes(outcomes: DataFrame, observation: Observation | str) -> DataFrame:
    """outcomes as they are; while a job or a stream runs over them, the same counters come out of the observation.

    An Observation gives them once its job is done; under a name they are part of a stream's progress.
    """
    counted = [F.count_if(F.col(c).eqNullSafe(v)).alias(name) for name, (c, v) in COUNTERS.items()]
    return outcomes.observe(observation, F.count(F.lit(1)).alias("total"), *counted)
