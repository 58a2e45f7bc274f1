"""Examples of every extractor as rows of one job each; quirks of the domain by name."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tailorbird.functions import text as X
from tailorbird.operators.extract import extract

BLOCK = "item_id string, pos int, source string, text string, confidence double"


def run(spark, which, cases):
    """cases: id -> blocks of (source, text)"""
    rows = [(i, k, s, t, 1.0) for i, blocks in cases.items() for k, (s, t) in enumerate(blocks)]
    out = extract(spark.createDataFrame(rows, BLOCK).repartition(3), (which,))
    return {r["item_id"]: r[which].asDict(True) for r in out.collect()}


def one(text, source="description"):
    return [(source, text)]


def test_normalisers(spark):
    d = spark.createDataFrame(
        [("ｽｰﾂ４４．５㎝：ｶﾞ", "  hello　　world\n", "<b>a</b>／b", "25mm", "  1,234,567 円  ", "シングル")],
        "a string, b string, c string, d string, e string, f string",
    )
    r = d.select(
        X.nfkc("a"), X.norm_ja(F.col("b")), X.clean_text(F.col("c")), X.parse_cm(F.col("d")), X.parse_jpy(F.col("e")),
        X.nfkc("f"),
    ).first()
    assert tuple(r) == ("スーツ44.5cm:ガ", "hello world", "a /b", 2.5, 1234567, "シングル")


def test_normalisers_nulls_and_html(spark):
    d = spark.createDataFrame([(None,), ("",), ("<p>一<br>二</p><script>x</script>",)], "h string")
    assert [r[0] for r in d.select(X.html_to_text("h")).collect()] == [None, "", "一\n二"]
    assert [r[0] for r in d.select(X.clean_text(F.col("h"))).collect()][:2] == [None, ""]


def test_sizes(spark):
    got = run(
        spark, "size",
        {
            "full": one("肩幅：４４．５ｃｍ 身幅 52 着丈=72cm 袖丈 約61センチ"), "girth": one("ウエスト：86cm"), "flat": one("ウエスト：43cm"),
            "measured": one("ウエスト実寸約86センチ"), "absurd": one("肩幅：200cm"),
            "halved": one("胸囲 104cm"), "priority": [("description", "肩幅 44cm"), ("specs", "肩幅 45cm")], "hem": one("裾ダブル 股下 72cm"),
            "none": one("よいスーツ"),
            "table": [("title", "スーツ 3XL"), ("description", "【 Mサイズ 】肩幅 43cm【3XLサイズ】肩幅 46cm")],
            "ll": [("title", "スーツ LL"), ("description", "【Mサイズ】肩幅 43cm【2XLサイズ】肩幅 46cm")],
            "missing_row": [("title", "スーツ XS"), ("description", "【Mサイズ】肩幅 43cm【Lサイズ】肩幅 46cm")],
        },
    )
    jacket = {k: {f: m and m["value"] for f, m in v["jacket"].items()} for k, v in got.items()}
    pants = {k: {f: m and m["value"] for f, m in v["pants"].items()} for k, v in got.items()}
    assert jacket["full"] == {"shoulder_cm": 44.5, "chest_width_cm": 52.0, "length_cm": 72.0, "sleeve_cm": 61.0}
    assert pants["girth"]["waist_circumference_cm"] == 86.0 and pants["flat"]["waist_flat_cm"] == 43.0 and pants["measured"]["waist_circumference_cm"] == 86.0
    assert got["flat"]["warnings"] == ["ウエスト 43.0cm: 平置きと仮定 (明示なし)"]
    assert jacket["absurd"]["shoulder_cm"] is None and got["absurd"]["warnings"] == ["ジャケット肩幅 200.0cm は妥当範囲外 (36.0–55.0cm)"]
    assert jacket["halved"]["chest_width_cm"] == 52.0 and got["halved"]["warnings"] == ["胸囲 104.0cm → 身幅 52.0cm に換算して判定"]
    assert jacket["priority"]["shoulder_cm"] == 45.0 and pants["hem"]["hem_finish"] == "double"
    assert len(got["none"]["unknown_fields"]) == 11 and got["none"]["confidence"] == 0.0
    # a size table is cut to the size on sale; XXL and LL are the row called 2XL; without its row nothing is left
    assert jacket["table"]["shoulder_cm"] == 46.0 and jacket["ll"]["shoulder_cm"] == 46.0 and jacket["missing_row"]["shoulder_cm"] is None


@pytest.mark.parametrize("order", [1, 2])
def test_row_order_does_not_matter(spark, order):
    rows = [("a", 0, "specs", "肩幅 44cm", 0.9), ("a", 1, "specs", "肩幅 45cm", 0.95), ("a", 2, "title", "肩幅 43cm", 1.0)]
    got = extract(spark.createDataFrame(rows[::-1] if order == 2 else rows, BLOCK).repartition(order), ("size",)).first()["size"]
    assert got["jacket"]["shoulder_cm"]["value"] == 44.0 and got["jacket"]["shoulder_cm"]["confidence"] == 0.81


def test_prices(spark):
    got = run(
        spark, "price",
        {
            "both": one("現在 8,500円\n即決 15,000円", "price"), "now": one("即決 20,000円", "price"), "fixed": one("販売価格：18,000円"),
            "wide": one("現在 １５，０００円", "price"), "free": one("送料込み 即決 900円", "price"),
            "bare": one("12,800円", "price"), "won": one("落札価格 9,000円"), "none": one("要相談", "price"),
            "fixed_block": one("販売価格：18,000円", "price"),
        },
    )
    brief = {k: (v["listing_type"], v["current_price_jpy"], v["buy_now_price_jpy"]) for k, v in got.items()}
    assert brief == {
        "both": ("auction", 8500, 15000), "now": ("buy_now_only", None, 20000), "fixed": ("fixed_price", 18000, 18000),
        "wide": ("auction", 15000, None), "free": ("buy_now_only", None, 900),
        "bare": ("auction", 12800, None), "won": ("auction", 9000, None), "none": (None, None, None),
        "fixed_block": ("fixed_price", 18000, None),
    }
    assert got["free"]["shipping_included"] is True and got["free"]["shipping_price_jpy"] == 0 and got["none"]["confidence"] == 0.3


def test_status(spark):
    got = run(
        spark, "status",
        {
            "sold": one("落札済み", "status"), "ended": one("終了", "status"), "active": one("残り 5時間で終了します", "status"),
            "unknown": one("", "status"), "content": one("売り切れました"),
            "first": [("status", "出品中"), ("description", "SOLD OUT")],
        },
    )
    assert {k: (v["normalized_status"], v["confidence"]) for k, v in got.items()} == {
        "sold": ("sold", 0.95), "ended": ("ended", 0.9), "active": ("active", 0.9), "unknown": ("unknown", 0.3),
        "content": ("sold", 0.8), "first": ("active", 0.9),
    }


def test_materials(spark):
    got = run(
        spark, "material",
        {
            "both": one("表地：モヘア60% ウール40%"), "inferred": one("ウール"), "lining": one("裏地：ポリエステル100%"),
            "reversed": one("裏地：キュプラ ポリエステル100% 表地：ウール70% 綿30%"),
            "later": [("description", "ウール混のスーツ"), ("description", "ウール60% ポリエステル40%")], "twice": one("ウール混 ウール60% シルク40%"),
            "none": one("スーツ"), "shoulder": one("肩毛"),
        },
    )
    brief = {k: ([(f["fiber"], f["percentage"]) for f in v["outer_fibers"]], [(f["fiber"], f["percentage"]) for f in v["lining_fibers"]]) for k, v in got.items()}
    assert brief["both"] == ([("wool", 40), ("mohair", 60)], []) and brief["inferred"] == ([("wool", 100)], []) and brief["lining"] == ([], [("polyester", 100)])
    assert brief["reversed"] == ([("wool", 70), ("cotton", 30)], [("polyester", 100)]) and brief["later"] == ([("wool", 60), ("polyester", 40)], [])
    assert brief["twice"] == ([("wool", 60), ("silk", 40)], []) and brief["none"] == ([], [])
    assert got["inferred"]["confidence"] == 0.3 and got["none"]["unknown_fields"] == ["outer_fibers", "lining_fibers"]


def test_style(spark):
    got = run(spark, "style", {"three": one("三つボタン"), "two": one("2B シングル"), "cjk": one("2Bスーツ"), "gold": one("金ボタン ダブルブレスト"), "hem": one("裾ダブル"), "spaced_hem": one("裾 ダブル")})
    assert {k: (v["button_type"], v["button_count"], v["button_color"]) for k, v in got.items()} == {
        "three": (None, 3, None), "two": ("single", 2, None), "cjk": (None, None, None), "gold": ("double", None, "gold"), "hem": (None, None, None), "spaced_hem": ("double", None, None),
    }


def test_condition(spark):
    got = run(
        spark, "condition",
        {"s": one("未使用品です"), "clean": one("目立った汚れはありません"), "severe": one("ひどい汚れ"), "torn": one("破れあり"), "polite": one("汚れはございません"), "none": one("")},
    )
    assert {k: (v["grade"], v["has_stain"], v["has_hole"]) for k, v in got.items()} == {
        "s": ("S", None, None), "clean": (None, False, None), "severe": (None, True, None), "torn": (None, None, True), "polite": (None, True, None), "none": (None, None, None),
    }
    assert got["severe"]["warnings"] == ["ひどい汚れの記述あり"]


@pytest.mark.parametrize("name", ["verdict_counts", "verdict_stats", "capture_verdicts", "recent_listings"])
def test_a_filter_on_the_verdict_stays_above_the_extraction(spark, name):
    """Below it, texts would be made and normalised a second time, all in the task that reads the one small file."""
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition") :]
    assert "Filter" not in below.replace("Filter isnotnull(p_partkey", "") and "ArrowEvalPython" not in below
