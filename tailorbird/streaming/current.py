"""Listings as they stand now, kept as state of a stream: only what changes comes out.

The state holds one small entry for each URL, whatever the number of its captures, many in a row. It lies in RocksDB, so it may be
larger than an executor's memory, and its change log lies in the query's checkpoint folder, so it survives lost executors and restarts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a listing is as far as a change goes.
LISTING = {"verdict": "string", "score": "double", "price": "long", "status": "string"}

_KIND = ", ".join(f"{k} {v}" for k, v in LISTING.items())
_CHANGE = "url string, change string, at long, listing string, before string"


class _Current:
    """The newest listings of a bucket of URLs: url -> (at, digest, listing). One that isn't seen for `keep_ms` is gone and forgotten."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def __call__(self, key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        newest: dict[str, list] = {}  # of this batch, a chunk at a time, however many rows there are
        for chunk in () if state.hasTimedOut else chunks:
            for url, *row in zip(*[chunk[c].tolist() for c in ("url", "at", "digest", "listing")]):
                if url not in newest or row[:2] > newest[url][:2]:
                    newest[url] = row
        out = []
        for url, row in newest.items():
            old = held.get(url)
            if old is not None and row[:2] <= old[:2]:
                continue
            held[url] = row
            if old is None or old[1] != row[1]:
                out.append((url, "new" if old is None else "changed", row[0], row[2], None if old is None else old[2]))
        now = state.getCurrentWatermarkMs()
        for url in [u for u, row in held.items() if row[0] // 1000 + self.keep_ms <= now]:
            at, _, listing = held.pop(url)
            out.append((url, "gone", at, listing, listing))
        if held:
            state.update((json.dumps(held, ensure_ascii=False),))
            state.setTimeoutTimestamp(min(row[0] for row in held.values()) // 1000 + self.keep_ms)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["url", "change", "at", "listing", "before"])


def listing_state(decided: DataFrame) -> DataFrame:
    """url, retrieved_at and the columns of LISTING of decided captures."""
    price, status = F.col("price"), F.col("status")
    paid = F.coalesce(F.nullif(price["buy_now_price_jpy"], F.lit(0)), price["current_price_jpy"])
    return decided.select("url", "retrieved_at", "verdict", "score", paid.cast("long").alias("price"), status["normalized_status"].alias("status"))


def current_changes(listings: DataFrame, keep_days: int = 30, late: str = "1 day", buckets: int = 2**14) -> DataFrame:
    """The changes of a stream of listings: url, change (new, changed or gone), retrieved_at, LISTING and what was before.

    listings has url, retrieved_at and LISTING, in any order within a batch. The capture with the latest time counts, of equal
    times the one with the larger hash, so an older capture that arrives later changes nothing; one that is the same as before
    only lengthens a listing's life. A listing is gone once the watermark is `keep_days` past its last capture; seen again, it is new.
    Rows without a url or a time are left out; rows later than the watermark are dropped and counted in the progress of
    the query (numRowsDroppedByWatermark). Other columns don't pass.

    URLs lie in `buckets` rows of the state by a hash, a number that stays with a checkpoint: a row costs Python a call, so a
    row for each URL takes many times as long; with some hundreds in a row, what a batch rewrites stays small.
    """
    at = F.unix_micros("retrieved_at")
    rows = listings.filter(F.col("url").isNotNull() & F.col("retrieved_at").isNotNull()).withWatermark("retrieved_at", late)
    whole = F.struct(*[F.col(k).cast(v).alias(k) for k, v in LISTING.items()])
    rows = rows.select(
        "url", "retrieved_at", at.alias("at"), F.xxhash64(*LISTING).alias("digest"), F.to_json(whole).alias("listing"), F.pmod(F.xxhash64("url"), F.lit(buckets)).alias("bucket")
    )
    changes = rows.groupBy("bucket").applyInPandasWithState(_Current(keep_days * 86_400_000), _CHANGE, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    when: Column = F.timestamp_micros("at")
    told = changes.select("url", "change", when.alias("retrieved_at"), F.from_json("listing", _KIND).alias("now"), F.from_json("before", _KIND).alias("before"))
    previous = [F.col("before")[k].alias(f"previous_{k}") for k in ("verdict", "price")]
    return told.select("url", "change", "retrieved_at", "now.*", *previous)


def stream_changes(changes: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the changes to Parquet files under `path`, each once. The query keeps its state in RocksDB."""
    conf = changes.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)
