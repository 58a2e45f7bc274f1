"""The same decisions over captures that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import RULES, Rules
from ..operators.store import sequence_number, upsert_changes
from ..plans.decisions import decide_captures


def stream_dedup(captures: DataFrame, within: str = "1 day") -> DataFrame:
    """Each URL once within a time; rows later than the watermark are dropped."""
    return captures.withWatermark("retrieved_at", within).dropDuplicatesWithinWatermark(["url"])


def stream_decisions(
    captures: DataFrame, changes: str, checkpoint: str, rules: Rules = RULES, once: bool = False, within: str = "1 day",
) -> StreamingQuery:
    """Decide every micro-batch of captures and write its changes under `changes`; fold_changes makes listings of them.

    A URL counts once within a time. Rows without a URL, which no store can hold, or without a time, which can't be
    told from earlier ones, are left out. A batch's changes go to a
    folder of its own that a repeated batch overwrites, and their numbers come from the batch, so a restart after a
    failure changes nothing. As a URL stands once in a batch, its number is unique.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        if rows.isEmpty():  # as in batches that only clear old state
            return
        upsert_changes(
            decide_captures(rows, rules, distinct=False), sequence_number(batch_id, F.lit(0)),
        ).write.mode("overwrite").parquet(f"{changes}/batch_id={batch_id}")

    once_each = stream_dedup(captures.filter(F.col("url").isNotNull() & F.col("retrieved_at").isNotNull()), within)
    writer = once_each.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
