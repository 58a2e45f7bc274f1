"""Whole runs: captures or stored packages in, decided listings out, as one lazy plan without a shuffle.

Every row is decided within itself by what it holds, so a page that was captured twice gives two decisions. Rows alike in
every column count once; finding them deals out all rows, so say distinct=False where the source has none. A row without
usable evidence, as one whose url and texts are null, gets an error and no decision. Other columns pass; those with the
name of a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RULES, Rules
from ..operators.evidence import build_package, clean_blocks, clean_own_blocks, distinct_rows, page_blocks, stored_blocks
from ..operators.extract import EXTRACTORS, extract, fold_blocks
from ..operators.rules import DECIDED, decide, merge_attributes
from ..sources.captures import BROKEN
from ..sources.sites import captures_to_signals


def decide_evidence(evidence: DataFrame, rules: Rules = RULES, normalized: bool = False) -> DataFrame:
    """item_id, the six attributes and the decision of each item of long evidence."""
    return decide(merge_attributes(extract(clean_blocks(evidence), normalized=normalized)), rules)


def extract_rows(rows: DataFrame, blocks: Column, which: tuple[str, ...] = tuple(EXTRACTORS), distinct: bool = True) -> DataFrame:
    """rows with the named attributes of each; n_blocks says how many blocks of evidence there were."""
    kept = [c for c in rows.columns if c.lower() not in {*EXTRACTORS, "n_blocks"}]
    rows = distinct_rows(rows) if distinct else rows
    carried = rows.select(*[F.col(c).alias(f"carried_{i}") for i, c in enumerate(kept)], blocks.alias("blocks"))
    found = fold_blocks(clean_own_blocks(carried, F.col("blocks")), which)
    return found.select(*[F.col(f"carried_{i}").alias(c) for i, c in enumerate(kept)], *which, "n_blocks")


def _decide_rows(rows: DataFrame, blocks: Column, rules: Rules, distinct: bool) -> DataFrame:
    rows = rows.drop(*DECIDED, "error")
    whole = decide(merge_attributes(extract_rows(rows, blocks, distinct=distinct)), rules)
    none = F.col("n_blocks") == 0
    made = {c: F.when(~none, F.col(c)) for c in (*EXTRACTORS, *DECIDED)}
    kept = [c for c in whole.columns if c not in made and c != "n_blocks"]
    return whole.select(*kept, *[v.alias(c) for c, v in made.items()], F.when(none, "no evidence").alias("error"))


def extract_signals(signals: DataFrame, which: tuple[str, ...] = tuple(EXTRACTORS), distinct: bool = True) -> DataFrame:
    """signals (url and text buckets) with item_id, source_site and the named attributes."""
    return extract_rows(build_package(signals), page_blocks(), which, distinct)


def decide_signals(signals: DataFrame, rules: Rules = RULES, distinct: bool = True) -> DataFrame:
    """signals (url and text buckets) with the decision of each; a page without any evidence gets an error instead."""
    return _decide_rows(build_package(signals), page_blocks(), rules, distinct)


def _once(rows: DataFrame, moments: Column) -> DataFrame:
    """Rows alike but for retrieved_at as one, with all their moments; moments is an array of them, each in a struct.

    Rows without a url stay apart by their moments, so that no group grows beyond the captures of one page.
    """
    alike = [c for c in rows.columns if c != "retrieved_at"]
    apart = F.when(F.col("url").isNull(), F.col("retrieved_at"))
    out = rows.groupBy(*alike, apart.alias("_apart")).agg(F.array_distinct(F.flatten(F.collect_set(moments))).alias("retrieved_at"))
    return out.select(*rows.columns)


def decide_captures(captures: DataFrame, rules: Rules = RULES, distinct: bool = True) -> DataFrame:
    """captures (url, html, retrieved_at) with the decision of each. What a page says and what is decided of it doesn't
    depend on when it was captured, so with `distinct` that is found once for all captures of a page that are alike."""
    if not distinct:
        return decide_signals(captures_to_signals(captures), rules, False)
    pages = _once(captures.select("url", "html", "retrieved_at"), F.array(F.struct("retrieved_at")))
    decided = decide_signals(_once(captures_to_signals(pages), F.col("retrieved_at")), rules, False)
    each = decided.withColumn("retrieved_at", F.explode("retrieved_at"))
    return each.withColumn("retrieved_at", F.col("retrieved_at")["retrieved_at"])


def reparse(packages: DataFrame, rules: Rules = RULES, distinct: bool = True) -> DataFrame:
    """Stored packages decided anew, for when rules change. Each row has its own error instead of a decision: one without usable
    evidence, or one whose text was broken, which stays under `broken`."""
    decided = _decide_rows(packages, stored_blocks(), rules, distinct).drop("evidence_blocks", "page_signals")
    if BROKEN not in packages.columns:
        return decided
    return decided.withColumn("error", F.when(F.col(BROKEN).isNotNull(), "broken record").otherwise(F.col("error")))
