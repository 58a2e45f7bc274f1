"""The stored layout against plain tables, its pruning and what a change touches; bitmaps of a few URLs against plain joins."""

import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tailorbird.operators import frontier, stored
from tailorbird.operators.stored import bitmap, maybe_in

ROW = "url string, retrieved_at timestamp, verdict string, needs_recheck boolean, extra int"
DATA = "/root/testdata/sf0.001"


def made(spark, rows):
    frame = spark.createDataFrame(rows, "url string, at string, verdict string, extra int")
    return frame.select("url", F.col("at").cast("timestamp").alias("retrieved_at"), "verdict", F.lit(False).alias("needs_recheck"), "extra")


def held(spark, path):
    rows = stored.read_store(spark, path).collect()
    return {r["url"]: (str(r["retrieved_at"]), r["verdict"], r["extra"], r["day"]) for r in rows}, len(rows)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "listings").rglob("*.parquet")}


def test_look_ups_read_one_bucket(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"u{i}", f"2024-06-0{1 + i % 3} 12:00:00", "REVIEW", i) for i in range(300)] + [(None, None, "MATCH", 0), ("timeless", None, "MATCH", 1)]
    stored.write_store(made(spark, rows), path, buckets=4)
    got = stored.find_stored(spark, path, url="u7")
    assert [(r["url"], r["extra"]) for r in got.collect()] == [("u7", 7)]
    own_id = got.first()["item_id"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else plans leave filters out
    got = stored.find_stored(spark, path, url="u7")
    by_id = stored.find_stored(spark, path, own_id=own_id)
    assert [r["url"] for r in by_id.collect()] == ["u7"] and not stored.find_stored(spark, path, url="none").collect()
    for found in (got, by_id):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d", plan) and f"EqualTo(item_id,{own_id[:8]}" in plan and "Exchange" not in plan
        read = found._jdf.queryExecution().toRdd().getNumPartitions()
        assert read <= 4  # the files of one bucket, a day each
    assert "EqualTo(url,u7)" in got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    data = next(iter(files(path)))
    assert duckdb.sql(f"SELECT bool_and(bloom_filter_offset IS NOT NULL) FROM parquet_metadata('{data}') WHERE path_in_schema IN ('url', 'item_id')").fetchall() == [(True,)]


def test_a_small_batch_touches_few_files(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = {f"u{i}": (f"2024-06-0{1 + i % 3} 12:00:00", "REVIEW", i) for i in range(400)}
    stored.write_store(made(spark, [(u, *r) for u, r in rows.items()]), path, buckets=8)
    before = files(path)
    assert len(before) == 24
    change = {"u3": ("2024-06-01 12:00:00", "MATCH", -1), "new": ("2024-07-01 16:00:00", "MATCH", -2), "u4": ("2024-06-09 00:00:00", "MATCH", -3)}
    written, dropped = stored.upsert_stored(spark, path, made(spark, [(u, *r) for u, r in change.items()] + [(None, None, None, 5)]))
    after = files(path)
    assert written <= 5 and not dropped and len(before.keys() & after.keys()) >= 24 - 4
    assert all(before[f] == after[f] for f in before.keys() & after.keys())  # others aren't even opened for writing
    rows |= change
    now, n = held(spark, path)
    assert n == len(rows) and {u: r[:3] for u, r in now.items()} == rows
    assert now["new"][3] == "2024-07-02" and now["u4"][3] == "2024-06-09"  # days are Japan's
    # the same batch again changes nothing
    stored.upsert_stored(spark, path, made(spark, [(u, *r) for u, r in change.items()]))
    assert held(spark, path) == (now, n)
    assert stored.upsert_stored(spark, path, made(spark, [(None, None, None, 5)])) == (0, 0)


def test_partitions_without_rows_fall_away_and_days_are_deleted(spark, tmp_path):
    path = str(tmp_path / "store")
    stored.write_store(made(spark, [("a", "2024-06-01 14:59:59", "X", 1), ("b", "2024-06-01 15:00:00", "X", 2), ("c", None, "X", 3)]), path, buckets=1)
    assert {d.name for d in Path(path, "listings/bucket=0").iterdir() if d.is_dir()} == {"day=2024-06-01", "day=2024-06-02", "day=none"}
    assert stored.upsert_stored(spark, path, made(spark, [("a", "2024-06-02 10:00:00", "Y", 4)])) == (1, 1)
    assert {u: r[2] for u, r in held(spark, path)[0].items()} == {"a": 4, "b": 2, "c": 3}
    assert stored.delete_stored_day(spark, path, "2024-06-02") == 2 and stored.delete_stored_day(spark, path, "2024-06-02") == 0
    assert set(held(spark, path)[0]) == {"c"}


def test_of_rows_with_one_url_the_last_stays(spark, tmp_path):
    rows = [("a", "2024-06-01 00:00:00", "old", 1), ("a", "2024-06-03 00:00:00", "new", 2), ("a", None, "never", 3), ("a", "2024-06-03 00:00:00", "new", 2)]
    for k, order in enumerate((rows, rows[::-1])):
        stored.write_store(made(spark, order).repartition(2), str(tmp_path / str(k)), buckets=2)
        assert held(spark, str(tmp_path / str(k))) == ({"a": ("2024-06-03 00:00:00", "new", 2, "2024-06-03")}, 1)


def test_many_random_batches(spark, tmp_path):
    r, path, want = random.Random(2), str(tmp_path / "store"), {}
    batch = lambda n: {f"u{r.randint(0, 40)}": (f"2024-06-0{r.randint(1, 4)} 00:00:00", r.choice("XYZ"), r.randint(0, 99)) for _ in range(n)}
    first = batch(30)
    stored.write_store(made(spark, [(u, *x) for u, x in first.items()]), path, buckets=3)
    want |= first
    for _ in range(3):
        more = batch(6)
        stored.upsert_stored(spark, path, made(spark, [(u, *x) for u, x in more.items()]))
        want |= more
        assert {u: x[:3] for u, x in held(spark, path)[0].items()} == want


def test_few_urls_against_many(spark):
    many = spark.range(50_000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("MATCH").alias("verdict"), F.lit(False).alias("needs_recheck"), F.current_timestamp().alias("retrieved_at"))
    few = spark.createDataFrame([(f"u{i * 977}",) for i in range(60)] + [("new",), (None,)], "url string")
    left = maybe_in(many, "url", bitmap(few, "url"))
    assert 52 <= left.count() <= 70 and left.columns == many.columns  # 52 are there; others are let through by chance
    joined = frontier.frontier_join_store(few, many).collect()
    assert len(joined) == 62 and sum(r["stored"] is not None for r in joined) == 52
    assert {r["url"] for r in frontier.not_in_seen(few, many).collect()} == {f"u{i * 977}" for i in range(52, 60)} | {"new", None}
    assert maybe_in(many, "url", bitmap(few.limit(0), "url")).count() == 0
    plan = frontier.not_in_seen(few, many)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("getbit")  # what is dealt out has gone through the bitmap


@pytest.mark.parametrize("name", ["stored_lookups", "stored_changes"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{DATA}/orders.parquet'")
    got = __spark_entry__.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*names).collect())
