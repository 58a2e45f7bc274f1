"""Reading captured pages and stored packages, as tables or as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = "url string, html string, retrieved_at timestamp"
SIGNALS = (
    "url string, title_text string, price_text string, status_text string, description_text string, all_text string, "
    "specs_text string, brand_text string, category_text string, image_urls array<string>, retrieved_at timestamp"
)
BLOCK = "source string, text string, block_type string, confidence double, metadata map<string,string>"
PACKAGE = (
    f"item_id string, url string, source_site string, retrieved_at timestamp, page_signals struct<{SIGNALS.replace(' ', ':').replace(',:', ',')}>, "
    f"evidence_blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>"
)


def read_captures(spark: SparkSession, path: str, kind: str = "parquet", stream: bool = False) -> DataFrame:
    """Captures (url, html, retrieved_at) from Parquet or JSON; or from whole text files, whose paths become URLs."""
    reader = spark.readStream if stream else spark.read
    if kind == "text":
        return reader.option("wholetext", True).text(path).select(
            F.input_file_name().alias("url"), F.col("value").alias("html"),
            F.lit(None).cast("timestamp").alias("retrieved_at"),
        )
    return reader.schema(CAPTURE).format(kind).load(path)


BROKEN = "broken"


def read_evidence_packages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Stored packages from JSON; fields that are missing are null. A record that is no JSON keeps its text under `broken`, which is null for others."""
    reader = spark.read.schema(f"{PACKAGE}, {BROKEN} string").option("columnNameOfCorruptRecord", BROKEN)
    return reader.option("mode", "PERMISSIVE").option("multiLine", multi_line).json(path)


def quarantine(packages: DataFrame, path: str) -> DataFrame:
    """packages without broken records, whose texts are appended as lines under `path`, to be mended and read again."""
    packages.filter(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("value"), F.col("item_id")).select("value").write.mode("append").text(path)
    return packages.filter(F.col(BROKEN).isNull()).drop(BROKEN)


def outcome_log(outcomes: DataFrame, path: str) -> None:
    """Append one row per URL and run to the log."""
    outcomes.write.mode("append").parquet(path)


def embedded_json(html: Column, script_id: str = "__NEXT_DATA__") -> Column:
    """The JSON in a page's script of this id as VARIANT; null without the script or if it is no JSON."""
    body = F.regexp_extract(html, rf"""(?is)<script\b[^>]*\bid=["']?{script_id}["']?[^>]*>(.*?)</script>""", 1)
    return F.try_parse_json(F.nullif(F.trim(body), F.lit("")))
