"""Registered queries about runs: many rule sets at once, targets of many runs, and a stream's changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontier, rules
from ..operators.rules import merge_attributes
from ..sources.scratch import shared_path
from ..streaming.current import LISTING, current_changes, stream_changes
from .decisions import extract_signals
from .listings import EXPECTED_SQL, listing_signals, parts


def rule_sets(spark, sf_dir):
    """Verdicts of all listings under a rule set for each nation: its own limit of the price, of shoulders and of unknowns."""
    k = F.col("n_nationkey")
    rule = lambda name, lo: F.struct(F.lit(name).alias("rule"), lo.cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    own = F.inline(F.array(rule("max_price", 8000 + k * 1500), rule("shoulder", 43 + k % 3), rule("many_unknowns", 6 + k % 4)))
    sets = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("rule_set"), own)
    found = merge_attributes(extract_signals(listing_signals(parts(spark, sf_dir)), distinct=False))
    return rules.decide_rule_sets(found, sets).groupBy("rule_set", "verdict").agg(F.count("*").alias("n"))


def run_targets(spark, sf_dir):
    """Events as results of searches, a run for each user: every run takes as many URLs as it wants, over its pages."""
    k, user = F.col("event_id"), F.col("user_id")
    routed = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        user.alias("run_id"), F.concat(F.lit("s"), k % 2).alias("source"), (k % 7 + 1).alias("page"), (k % 11).alias("rank"),
        F.when(k % 101 > 0, F.concat(F.lit("u"), k)).alias("url"),
        F.when(F.col("event_type") == "click", "skip").otherwise("full_crawl").alias("action"), (5 + user % 40).alias("wants"),
    )
    return frontier.target_per_run(routed, F.col("wants"), max_pages=6).select("run_id", "source", "page", "rank", "url")


def listing_changes(spark, sf_dir):
    """Lines of orders as captures of a listing for each order: a stream that is run, stopped, and run again over the later ones."""
    number, at = F.col("l_linenumber"), F.col("l_shipdate").cast("timestamp")
    flag = F.col("l_returnflag")
    captures = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("url"), F.timestamp_micros(F.unix_micros(at) + number * 1_000_000 + F.col("l_partkey")).alias("retrieved_at"),
        F.when(flag == "A", "MATCH").when(flag == "N", "REVIEW").otherwise("NO_MATCH").alias("verdict"),
        F.when(flag == "A", 1.0).otherwise(0.5).alias("score"), (F.col("l_partkey") % 2 * 1000).alias("price"),
        F.when(F.col("l_linestatus") == "F", "sold").otherwise("active").alias("status"), number,
    )
    source, changes, state = (shared_path(spark, n) for n in ("captured", "listing-changes", "listing-state"))
    for part in (number <= 2, number > 2):
        captures.filter(part).drop("l_linenumber").write.mode("append").parquet(source)
        stream = spark.readStream.schema(captures.drop("l_linenumber").schema).parquet(source)
        query = stream_changes(current_changes(stream, keep_days=36_500, late="36500 days"), changes, state, once=True)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return spark.read.parquet(changes).select("url", "change", "retrieved_at", *LISTING, "previous_verdict", "previous_price")


QUERIES = {f.__name__: f for f in (rule_sets, run_targets, listing_changes)}

ORACLE_SQL = {
    "rule_sets": f"""
WITH {EXPECTED_SQL}, tried AS (
  SELECT n_name AS rule_set, size_unknown + other_unknown >= 6 + n_nationkey % 4 AS unsure,
    len(blocking) - CAST(coalesce(coalesce(buy_now, current_price) > 30000, FALSE) AS INTEGER) - CAST(shoulder < 43 OR shoulder > 45 AS INTEGER)
      + CAST(coalesce(coalesce(buy_now, current_price) > 8000 + n_nationkey * 1500, FALSE) AS INTEGER) + CAST(shoulder < 43 + n_nationkey % 3 OR shoulder > 45 AS INTEGER) AS n_blocking
  FROM listed CROSS JOIN nation
)
SELECT rule_set, CASE WHEN n_blocking > 0 THEN 'NO_MATCH' WHEN unsure THEN 'REVIEW' ELSE 'MATCH' END AS verdict, count(*) AS n FROM tried GROUP BY ALL""",
    "run_targets": """
WITH r AS (
  SELECT user_id AS run_id, 's' || event_id % 2 AS source, event_id % 7 + 1 AS page, event_id % 11 AS rank,
    CASE WHEN event_id % 101 > 0 THEN 'u' || event_id END AS url, event_type = 'click' AS skipped, 5 + user_id % 40 AS wants
  FROM events WHERE event_id % 7 + 1 <= 6
), ended AS (SELECT *, min(CASE WHEN url IS NULL THEN page END) OVER (PARTITION BY run_id, source) AS last_page FROM r),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY page, source, rank, url) AS place FROM ended
  WHERE url IS NOT NULL AND NOT coalesce(skipped, FALSE) AND (last_page IS NULL OR page < last_page)
)
SELECT run_id, source, page, rank, url FROM placed WHERE place <= wants""",
    "listing_changes": """
WITH c AS (
  SELECT 'o' || l_orderkey AS url, CAST(l_shipdate AS TIMESTAMP) + to_seconds(l_linenumber) + to_microseconds(l_partkey) AS retrieved_at,
    CASE l_returnflag WHEN 'A' THEN 'MATCH' WHEN 'N' THEN 'REVIEW' ELSE 'NO_MATCH' END AS verdict, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score,
    l_partkey % 2 * 1000 AS price, CASE l_linestatus WHEN 'F' THEN 'sold' ELSE 'active' END AS status, l_linenumber > 2 AS later
  FROM lineitem
), newest AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY url, later ORDER BY retrieved_at DESC) = 1),
a AS (SELECT * FROM newest WHERE NOT later), b AS (SELECT * FROM newest WHERE later)
SELECT url, 'new' AS change, retrieved_at, verdict, score, price, status, CAST(NULL AS VARCHAR) AS previous_verdict, CAST(NULL AS BIGINT) AS previous_price FROM a
UNION ALL
SELECT b.url, CASE WHEN a.url IS NULL THEN 'new' ELSE 'changed' END, b.retrieved_at, b.verdict, b.score, b.price, b.status, a.verdict, a.price
FROM b LEFT JOIN a USING (url)
WHERE a.url IS NULL OR (b.retrieved_at > a.retrieved_at AND (a.verdict, a.score, a.price, a.status) <> (b.verdict, b.score, b.price, b.status))""",
}
