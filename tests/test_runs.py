"""Many rule sets at once, targets of many runs, and changes out of a stream's state."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__
from tailorbird.config import RULES
from tailorbird.operators import frontier, rules
from tailorbird.plans.decisions import decide_signals, extract_signals
from tailorbird.plans.listings import listing_signals
from tailorbird.streaming.current import current_changes, stream_changes

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rule_sets", "run_targets", "listing_changes"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("part", "nation", "events", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = __spark_entry__.queries()[name](spark, DATA)
    names = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    got = found.select(*names).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got) and got


def test_each_rule_set_decides_as_it_does_alone(spark):
    signals = listing_signals(spark.read.parquet(f"{DATA}/part.parquet").limit(60))
    odd = [
        ("strict", "max_price", 9000.0, None), ("strict", "shoulder", 44.0, None), ("strict", "chest", None, 52.0), ("strict", "no such rule", 1.0, 2.0),
        ("loose", "max_price", 90000.0, None), ("loose", "inseam", 60.0, None), ("loose", "inseam_never", 50.0, None), (None, "least_score", 0.99, None),
    ]
    sets = spark.createDataFrame(odd, "rule_set string, rule string, lo double, hi double").unionByName(
        rules.rules_frame(spark).withColumn("rule_set", F.lit("usual"))
    )
    attributes = rules.merge_attributes(extract_signals(signals.withColumn("rule_set", F.lit("a caller's")), distinct=False))
    shown = ("url", "verdict", "score", "blocking_reasons", "reasons", "needs_recheck")
    together = rules.decide_rule_sets(attributes, sets)
    got = together.select("rule_set", *shown).collect()
    alone = {
        "strict": replace(RULES, max_price=9000, shoulder=(44.0, 45.0), chest=(51.0, 52.0)), "usual": RULES,
        "loose": replace(RULES, max_price=90000, inseam=60.0, inseam_never=50.0), None: replace(RULES, least_score=0.99),
    }
    assert {r["rule_set"] for r in got} == set(alone)
    for name, own in alone.items():
        want = decide_signals(signals, own, distinct=False).select(*shown).collect()
        assert sorted(repr(tuple(r)) for r in want) == sorted(repr(tuple(r)[1:]) for r in got if r["rule_set"] == name)
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rules.decide_rule_sets(attributes, sets.limit(0)).count() == 0
    with pytest.raises(PySparkException, match="rule sets"):
        rules.decide_rule_sets(attributes, sets, most=3).count()


def test_targets_equal_going_page_by_page(spark):
    r = random.Random(5)
    rows = [
        (r.choice([1, 1, 1, 2, 3, None]), r.choice(["a", "b"]), r.randint(1, 9), r.randint(0, 3), None if r.random() < 0.02 else f"u{i}", r.choice(["skip", "full_crawl", "status_recheck", None]))
        for i in range(600)
    ]
    routed = spark.createDataFrame(rows, "run_id int, source string, page int, rank int, url string, action string").withColumns({"room": F.lit("x"), "whole": F.lit("y")})
    wants = {1: 40, 2: 1000, 3: 0, None: 7}

    def plain(target):
        out = []
        for run in wants:
            left, ended = target[run], set()
            for page in range(1, 9):
                for source in ("a", "b"):
                    here = [x for x in rows if x[:3] == (run, source, page)]
                    if any(x[4] is None for x in here):
                        ended.add(source)
                    if source in ended:
                        continue
                    taken = sorted((x for x in here if x[5] != "skip"), key=lambda x: (x[3], x[4]))[:left]
                    left -= len(taken)
                    out += taken
        return out

    own = F.when(F.col("run_id").isNull(), 7).otherwise(F.element_at(F.create_map(*[F.lit(x) for k, v in wants.items() if k for x in (k, v)]), F.col("run_id")))
    for target, want in ((own, wants), (25, dict.fromkeys(wants, 25)), (0, dict.fromkeys(wants, 0))):
        got = frontier.target_per_run(routed, target, max_pages=8).drop("room", "whole").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(want)))
    assert frontier.target_per_run(routed.limit(0)).count() == 0


def test_state_of_a_stream(spark, tmp_path):
    day = lambda n: datetime(2024, 6, 1) + timedelta(days=n)
    batches = [
        [("u", day(0), "REVIEW", 1), ("u", day(1), "MATCH", 2), ("v", day(1), "REVIEW", 3), (None, day(1), "MATCH", 1), ("w", None, "MATCH", 1)],
        [("u", day(0), "NO_MATCH", 9), ("u", day(2), "MATCH", 2), ("v", day(3), "REVIEW", 4), ("v", day(3), "REVIEW", 4)],  # late, same, changed
        [("x", day(20), None, None)],  # moves the watermark past u and v
        [("v", day(21), "REVIEW", 4), ("u", day(1), "MATCH", 7)],  # again, and later than the watermark
    ]
    told, dropped = [], 0
    kind = "url string, retrieved_at timestamp, verdict string, price long"
    for rows in batches:
        data = spark.createDataFrame(rows, kind).withColumns({"score": F.lit(0.5), "status": F.lit("active"), "at": F.lit("a caller's")})
        data.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
        query = stream_changes(current_changes(stream, keep_days=5, late="3 days"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        assert query.awaitTermination(240) and query.exception() is None
        dropped += sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
        out = spark.read.parquet(str(tmp_path / "out")).collect()
        told.append(sorted((r["url"], r["change"], r["retrieved_at"], r["verdict"], r["price"], r["previous_verdict"], r["previous_price"]) for r in out))
    first = [("u", "new", day(1), "MATCH", 2, None, None), ("v", "new", day(1), "REVIEW", 3, None, None)]
    assert told[0] == first
    assert told[1] == sorted([*first, ("v", "changed", day(3), "REVIEW", 4, "REVIEW", 3)])
    gone = [("u", "gone", day(2), "MATCH", 2, "MATCH", 2), ("v", "gone", day(3), "REVIEW", 4, "REVIEW", 4)]
    assert told[2] == sorted([*told[1], ("x", "new", day(20), None, None, None, None), *gone])
    assert told[3] == sorted([*told[2], ("v", "new", day(21), "REVIEW", 4, None, None)]) and dropped == 1
    assert "stateStore" not in str(spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""))


def test_many_urls_share_a_row_of_the_state(spark, tmp_path):
    """A call of Python for each URL took minutes on the lines of sf0.1; what comes out is the same whatever the number of rows."""
    r, day = random.Random(9), lambda n: datetime(2024, 6, 1) + timedelta(days=n)
    big = 2**60 + 1  # no double holds it
    current, want, rows = {}, [], []
    for batch in range(3):
        made = [(f"u{r.randrange(150)}", day(batch) + timedelta(seconds=i), r.choice(["MATCH", "REVIEW", None]), r.choice([0.1, 1e-7, None]), r.choice([big, None]), "active") for i in range(400)]
        rows.append(made)
        newest = {x[0]: x for x in made}
        for url, x in newest.items():
            old = current.get(url)
            if old is None or old[2:] != x[2:]:
                want.append((url, "new" if old is None else "changed", *x[1:], *(old[2:5:2] if old else (None, None))))
            current[url] = x
    kind = "url string, retrieved_at timestamp, verdict string, score double, price long, status string"
    for made in rows:
        r.shuffle(made)
        spark.createDataFrame(made, kind).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        query = stream_changes(current_changes(stream, late="9 days", buckets=4), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        assert query.awaitTermination(240) and query.exception() is None
        assert query.recentProgress[0].stateOperators[0].numRowsTotal == 4
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
