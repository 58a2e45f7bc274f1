"""Site mappers, frontier, store, fills, streaming, and the whole way from a page to a decision."""

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tailorbird.config import SIGNALS
from tailorbird.operators import evidence, fill, frontier, rules, store
from tailorbird.operators.evidence import build_package, nest_evidence, own_packages, signals_to_evidence
from tailorbird.plans.decisions import decide_captures, reparse
from tailorbird.plans.listings import listing_signals
from tailorbird.sources import captures as C
from tailorbird.sources.sites import captures_to_signals, selector_signals
from tailorbird.streaming.decisions import stream_decisions

SUIT = "肩幅 44cm 身幅 52cm 袖丈 62cm\nウエスト平置き 43cm 股下 76cm 裾幅 19cm ワタリ 31cm 股上 25cm 総丈 100cm 着丈 72cm 裾シングル\n表地：ウール100% 裏地：ポリエステル100%\n三つボタン シングル 美品 汚れなし 穴なし"


def page(data):
    return f'<html><body><h1>見出し</h1><script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script></body></html>'


def captures(spark):
    auction = {
        "title": "スーツ", "descriptionHtml": "<p>" + SUIT.replace("\n", "<br>") + "</p>", "price": 9000, "bidorbuy": 15000,
        "bids": 1, "chargeForShipping": "seller", "status": "open", "leftTime": 7300, "conditionName": "良い",
    }
    mercari = {
        "id": "m1", "name": "スーツ", "description": SUIT, "price": 12000, "shipping_payer": {"name": "送料込み(出品者負担)"},
        "status": "on_sale", "photos": [{"image_urls": {"large": "L"}}, "P"], "categories": [{"name": "A"}, {"name": "B"}],
        "brand": {"name": "X"},
    }
    flea = {
        "title": "スーツ", "description": SUIT, "price": 8000, "status": "OPEN", "isPurchased": True,
        "images": [{"url": "u1"}, {}], "categoryList": [{"name": "A"}],
    }
    shop = {
        "name": "スーツ", "freeSpace1": "<p>肩幅 44cm</p>", "brandName": "B", "materialDescription": "ウール100%",
        "price": {"value": 20000}, "availability": "outOfStock", "images": [{"url": "s"}], "condition": {"label": "良い"},
    }
    rows = [
        (
            "https://auctions.yahoo.co.jp/jp/auction/x1",
            page({"props": {"pageProps": {"initialState": {"item": {"detail": {"item": auction}}}}}}),
        ),
        ("https://jp.mercari.com/item/m1", page({"props": {"pageProps": {"serverData": {"item": mercari}}}})),
        ("https://paypayfleamarket.yahoo.co.jp/item/z1", page({"props": {"initialState": {"itemsState": {"items": {"item": flea}}}}})),
        (
            "https://store.shopping.yahoo.co.jp/s/1.html",
            page({"props": {"pageProps": {"dehydratedState": {"queries": [{}, {"state": {"data": {"itemData": {"item": shop}}}}]}}}}),
        ),
        (
            "https://jp.mercari.com/item/m2",
            '<body><h1>無地</h1><span class="Price__x">¥6,699</span> 送料込み <img src="https://static.mercdn.net/1.jpg"> 売り切れ</body>',
        ),
        ("https://auctions.yahoo.co.jp/jp/auction/broken", '<script id="__NEXT_DATA__">{oops</script>'),
        ("https://store.shopping.yahoo.co.jp/s/2.html", None),
    ]
    return spark.createDataFrame(rows, "url string, html string").withColumn("retrieved_at", F.lit("2024-06-01").cast("timestamp"))


def test_signals_of_every_site(spark):
    got = {r["url"].rsplit("/", 1)[1]: r for r in captures_to_signals(captures(spark)).collect()}
    assert len(got) == 7
    assert got["x1"]["price_text"] == "即決 15,000円\n現在 9,000円\n送料込み" and got["x1"]["status_text"] == "残り2時間" and got["x1"]["specs_text"] == "商品の状態: 良い"
    assert got["x1"]["description_text"] == SUIT
    assert got["m1"]["price_text"] == "即決 12,000円\n送料込み" and got["m1"]["image_urls"] == ["L", "P"] and got["m1"]["category_text"] == "A > B" and got["m1"]["brand_text"] == "X"
    assert got["z1"]["status_text"] == "終了" and got["z1"]["image_urls"] == ["u1"]
    assert got["1.html"]["description_text"] == "肩幅 44cm\nブランド: B\n素材: ウール100%" and got["1.html"]["status_text"] == "終了" and got["1.html"]["specs_text"] == "商品の状態: 良い"
    assert got["m2"]["title_text"] == "無地" and got["m2"]["price_text"] == "即決 6,699円\n送料込み" and got["m2"]["status_text"] == "終了" and got["m2"]["image_urls"] == ["https://static.mercdn.net/1.jpg"]
    assert got["broken"]["title_text"] == "" and got["2.html"]["all_text"] == ""


def test_captures_to_decisions(spark):
    got = {r["url"].rsplit("/", 1)[1]: r for r in decide_captures(captures(spark)).collect()}
    assert got["x1"]["verdict"] == "MATCH" and got["x1"]["score"] == 1.0 and got["m1"]["verdict"] == "MATCH"
    assert got["z1"]["verdict"] == "NO_MATCH" and got["2.html"]["verdict"] is None and got["2.html"]["error"] == "no evidence"


def test_reparse_and_nested_packages(spark, tmp_path):
    block = lambda source, text, c: {"source": source, "text": text, "block_type": source, "confidence": c, "metadata": {}}
    package = {
        "item_id": "p", "url": "u", "source_site": "s",
        "evidence_blocks": [block("title", "紺 スーツ", 1.0), block("price", "即決価格：15,000円", 1.0), block("status", "出品中です", 1.0)],
    }
    package["evidence_blocks"] += [block("description", t, 0.85) for t in SUIT.split("\n")]
    (tmp_path / "p.json").write_text(
        json.dumps(package, ensure_ascii=False) + "\n" + json.dumps({"item_id": "q", "url": "v"}), encoding="utf-8",
    )
    got = {r["item_id"]: r for r in reparse(C.read_evidence_packages(spark, str(tmp_path))).collect()}
    assert got["p"]["verdict"] == "MATCH" and got["p"]["error"] is None and got["q"]["error"] == "no evidence"


def test_selectors(spark):
    html = '<div class="a Price b"><b>現在</b> 5円</div><h1 class="T">題</h1><ul><li class="X">無</li></ul>'
    d = spark.createDataFrame([(html,)], "h string")
    assert tuple(
        d.select(*[c.alias(k) for k, c in selector_signals(F.col("h"), {"p": ".Price", "t": "h1.T", "n": ".None"}).items()]).first()
    ) == ("現在\n5円", "題", "")


def test_evidence(spark):
    d = spark.createDataFrame(
        [
            ("a", 0, "title", "t", "同じ文", 1.0), ("a", 1, "all_text", "t", "同じ文", 0.6), ("a", 2, "specs", "t", "12345", 0.9),
            ("a", 3, "specs", "t", "短い", 0.9),
        ],
        "item_id string, pos int, source string, block_type string, text string, confidence double",
    )
    kept = evidence.clean_blocks(d.withColumn("metadata", F.create_map().cast("map<string,string>"))).collect()
    assert [(r["pos"], r["source"]) for r in kept] == [(0, "title")]
    assert spark.range(1).select(evidence.site_item_id(F.lit("https://auctions.yahoo.co.jp/jp/auction/x12?a=1"))).first()[0] == "x12"


def test_rules_recheck_and_goldens(spark):
    none = spark.createDataFrame([(["価格を取得できませんでした"],), ([],), (["x"],)], "r array<string>")
    assert [r[0] for r in none.select(rules.needs_recheck(F.lit("NO_MATCH"), F.col("r"))).collect()] == [True, True, False]


def test_rules_as_a_table(spark):
    frame = rules.rules_frame(spark)
    assert rules.rules_from_frame(frame) == rules.RULES
    changed = rules.rules_from_frame(frame.withColumn("lo", F.when(F.col("rule") == "max_price", 9.0).otherwise(F.col("lo"))))
    assert changed.max_price == 9 and changed.chest == (51.0, 53.0)


def test_store_changes(spark):
    payload = "struct<verdict:string,blocking_reasons:array<string>,needs_recheck:boolean,status:struct<normalized_status:string,raw_status:string,evidence:string,confidence:double,warnings:array<string>>>"
    up = spark.createDataFrame([("u", 1, "REVIEW"), ("v", 1, "MATCH"), ("u", 5, "MATCH")], "url string, seq long, verdict string")
    log = store.upsert_changes(
        up.select(
            "url", "seq",
            F.struct(
                "verdict", F.array(F.lit("b")).alias("blocking_reasons"), F.lit(True).alias("needs_recheck"),
                F.lit(None).alias("status"),
            ).cast(payload).alias("p"),
        ).select("url", "seq", "p.*"),
        F.col("seq"),
    )
    log = log.withColumn("payload", F.col("payload").dropFields("seq"))
    urls = spark.createDataFrame([("u",)], "url string")
    log = log.unionByName(
        store.mark_ng(urls, F.lit(6).cast("long"), F.lit("手動")), allowMissingColumns=True,
    ).unionByName(store.mark_ng(urls, F.lit(7).cast("long"), F.lit("手動")), allowMissingColumns=True)
    twice = log.unionByName(log)
    for changes in (log, twice, twice.repartition(5)):
        got = {r["url"]: r for r in store.fold_changes(changes).collect()}
        assert got["u"]["verdict"] == "NO_MATCH" and got["u"]["blocking_reasons"] == ["手動", "b"] and got["u"]["needs_recheck"] is False and got["v"]["verdict"] == "MATCH" and got["v"]["is_active"]
    gone = log.unionByName(store.delete_changes(urls, F.lit(9).cast("long")), allowMissingColumns=True)
    assert [r["url"] for r in store.fold_changes(gone).collect()] == ["v"]


def test_snapshots(spark, tmp_path):
    for version, n in ((1, 3), (2, 5)):
        store.write_snapshot(spark.range(n), str(tmp_path), version)
    assert store.read_snapshot(spark, str(tmp_path)).count() == 5


def test_frontier(spark):
    html = '<a href="https://jp.mercari.com/item/m1?x=1">a</a><a href="/item/m2">b</a><a href="/item/m1">c</a><a href="https://auctions.yahoo.co.jp/jp/auction/q1?z">d</a>'
    d = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert [
        r["url"] for r in frontier.extract_item_urls(d, "mercari").collect()
    ] == ["https://jp.mercari.com/item/m1", "https://jp.mercari.com/item/m2"]
    assert [r["url"] for r in frontier.extract_item_urls(d).collect()] == ["https://auctions.yahoo.co.jp/jp/auction/q1"]
    q = frontier.build_frontier(spark.createDataFrame([("紺 スーツ",)], "query string"), max_pages=2).collect()
    assert q[1]["search_url"].startswith(
        "https://auctions.yahoo.co.jp/search/search?p=%E7%B4%BA+%E3%82%B9%E3%83%BC%E3%83%84&b=51&n=50&s1=new&o1=d&auccat=23176&max=30000"
    )


def test_fill_flat_waist_that_is_a_girth(spark):
    rows = [("a", 0, "description", "スーツの説明", 1.0)]
    from tailorbird.operators.extract import extract

    attributes = extract(
        spark.createDataFrame(rows, "item_id string, pos int, source string, text string, confidence double"),
        ("size", "material"),
    )
    results = spark.createDataFrame(
        [
            (
                "a", "text",
                '{"pants_waist_flat_cm": 74, "jacket_shoulder_cm": 44.0, "pants_inseam_cm": "x", "pants_rise_cm": 500, "pants_thigh_cm": null}',
            )
        ],
        "item_id string, pass string, j string",
    )
    got = fill.ml_fill_join(attributes, results.select("item_id", "pass", F.parse_json("j").alias("result"))).first()["size"]
    assert got["pants"]["waist_circumference_cm"]["value"] == 74.0 and got["pants"]["waist_flat_cm"] is None and got["jacket"]["shoulder_cm"]["source"] == "llm_gemini"
    assert "pants_waist_flat_cm" not in got["unknown_fields"] and "pants_inseam_cm" in got["unknown_fields"]
    assert got["warnings"] == ["パンツ股上 500.0cm は妥当範囲外 (20.0–40.0cm)"]


def test_stream(spark, tmp_path):
    source, changes = str(tmp_path / "in"), str(tmp_path / "changes")
    captures(spark).coalesce(1).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        query = stream_decisions(C.read_captures(spark, source, stream=True), changes, str(tmp_path / "cp"), once=True)
        assert query.awaitTermination(240)
    log = spark.read.parquet(changes)
    assert log.count() == 7 and log.filter(F.col("payload.verdict") == "MATCH").count() == 2


def test_counters_of_a_run_while_it_runs(spark, tmp_path):
    rows = [("crawled", "MATCH"), ("crawled", "REVIEW"), ("skipped", None), ("error", None), ("status_rechecked", "NO_MATCH"), ("crawled", None)]
    outcomes = spark.createDataFrame([(f"u{i}", 1 + i % 2, *r) for i, r in enumerate(rows)], "url string, run_id int, action string, verdict string")
    want = {"total": 6, "crawled": 3, "status_rechecked": 1, "skipped": 1, "errors": 1, "matches": 1, "reviews": 1, "no_matches": 1}
    seen = Observation("run")
    frontier.observed_outcomes(outcomes, seen).write.parquet(str(tmp_path / "in"))
    assert seen.get == want
    stream = frontier.observed_outcomes(spark.readStream.schema(outcomes.schema).parquet(str(tmp_path / "in")), "run")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    told = [p.observedMetrics["run"].asDict() for p in query.recentProgress if "run" in p.observedMetrics]
    assert {k: sum(t[k] for t in told) for k in want} == want
    summary = {r["run_id"]: r for r in frontier.batch_summary(outcomes).collect()}
    assert summary[1]["verdicts"] == {"MATCH": 1, "NO_MATCH": 1} and summary[2]["verdicts"] == {"REVIEW": 1} and summary[1]["total"] == 3
    plan = frontier.batch_summary(outcomes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and frontier.batch_summary(outcomes.filter("verdict is null")).first()["verdicts"] is None


def test_report_decides_once(spark):
    rows = [("a", "X", 1.0, ["p", "q"]), ("a", "X", 0.5, ["q", "q"]), ("a", "X", None, None), ("a", "Y", 0.25, []), (None, None, 1.0, ["r", "s", "t", "u"])]
    listings = spark.createDataFrame(rows, "source_site string, verdict string, score double, blocking_reasons array<string>")
    got = {(r["source_site"], r["verdict"]): (r["n"], r["mean_score"], r["top_reasons"]) for r in store.report(listings).collect()}
    assert got["a", "X"] == (3, 0.75, [("q", 3), ("p", 1)]) and got["a", "Y"] == (1, 0.25, None)
    assert got[None, None] == (1, 1.0, [("r", 1), ("s", 1), ("t", 1)])
    assert "Join" not in store.report(listings)._jdf.queryExecution().executedPlan().toString()


def test_broken_records_keep_their_text_and_can_be_mended(spark, tmp_path):
    good = json.dumps({"item_id": "p", "url": "u", "evidence_blocks": [{"source": "title", "text": "紺 スーツ", "block_type": "title", "confidence": 1.0}]}, ensure_ascii=False)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/p.json").write_text("\n".join([good, good[:40], '{"item_id": "q"}', "oops"]), encoding="utf-8")
    packages = C.read_evidence_packages(spark, str(tmp_path / "in"))
    got = {(r["item_id"], r["broken"]): (r["error"], r["verdict"]) for r in reparse(packages).collect()}
    assert got["p", None] == (None, "NO_MATCH") and got["q", None] == ("no evidence", None)
    broken = {text: found for (_, text), found in got.items() if text}
    assert broken == {good[:40]: ("broken record", None), "oops": ("broken record", None)}
    left = C.quarantine(packages.cache(), str(tmp_path / "bad"))
    assert left.count() == 2 and {r[0] for r in spark.read.text(str(tmp_path / "bad")).collect()} == {good[:40], "oops"}


def test_each_question_by_pictures_has_its_own_gate(spark):
    def row(unknown, fibers, text, images):
        known = ["pants_rise_cm", "pants_thigh_cm", "jacket_length_cm", "pants_inseam_cm", "jacket_sleeve_cm", "jacket_shoulder_cm", "pants_hem_width_cm"][:unknown]
        return (f"{unknown}{fibers}{text}{images}", {"unknown_fields": known}, {"outer_fibers": [{"fiber": "wool", "percentage": 100}] * fibers}, text, "", ["i"] * images)

    rows = [row(u, f, t, i) for u in (1, 5, 6) for f in (0, 1) for t in ("", "t") for i in (0, 5)]
    kind = "item_id string, size struct<unknown_fields:array<string>>, material struct<outer_fibers:array<struct<fiber:string,percentage:int>>>, specs_text string, description_text string, image_urls array<string>"
    attributes = spark.createDataFrame(rows, kind)
    asked = fill.ml_fill_requests(fill.ml_fill_candidates(attributes, images=True), images=True).collect()
    assert {(r["item_id"], r["about"]) for r in asked} == {("10t5", "material"), ("50t5", "material"), ("60t5", "material"), ("60t5", "size"), ("61t5", "size")}
    assert all(len(r["images"]) == 4 for r in asked)


def test_a_filled_result_is_parsed_once_a_pass(spark):
    from tailorbird.operators.extract import extract

    rows = [("a", 0, "description", "肩幅 44cm", 1.0)]
    attributes = extract(
        spark.createDataFrame(rows, "item_id string, pos int, source string, text string, confidence double"), ("size", "material"),
    )
    results = spark.createDataFrame([("a", "text", '{"pants_rise_cm": 25}')], "item_id string, pass string, j string")
    out = fill.ml_fill_join(attributes, results.select("item_id", "pass", F.parse_json("j").alias("result")), passes=("text",))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson(text#") == 1
    assert out.first()["size"]["pants"]["rise_cm"]["value"] == 25.0


def test_packages_are_made_within_their_rows(spark):
    """Packages were dealt out block by block and gathered again, and their blocks made twice."""
    signals = build_package(listing_signals(spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(40)))
    k = F.col("p_partkey")
    odd = signals.withColumns(
        {
            "title_text": F.when(k % 3 == 0, "ＡＢ <b>袖丈</b>：６０cm").when(k % 3 == 1, F.col("title_text")),
            "description_text": F.when(k % 4 == 0, F.concat(F.lit("<br>\n \n一 \x00 二\n"), F.col("description_text"))).when(k % 4 == 1, F.col("description_text")),
        }
    )
    got = own_packages(odd)
    gathered = nest_evidence(signals_to_evidence(odd))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, gathered.select(*got.columns).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan and plan.count("(?U)\\S") == 1
    nothing = odd.select("item_id", *[F.lit(None).cast("string").alias(c) for _, c, _, _ in SIGNALS])
    assert {tuple(r["evidence_blocks"]) for r in own_packages(nothing).collect()} == {()}
