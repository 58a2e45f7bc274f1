"""Purchase rules over extracted attributes: reasons, score, verdict and what follows from them.

All are columns over a row with the six attribute structs, so they become part of the projection that follows
the extraction. A missing attribute struct counts as one without values.
"""

from __future__ import annotations

from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RULES, Rules
from .extract import EXTRACTORS, once

#: The texts of reasons.
NO_BUY_NOW = "即決価格が設定されていないためNG (オークション形式)"
NO_PRICE = "価格を取得できませんでした"
UNKNOWN = {"shoulder": "肩幅が不明", "chest": "身幅が不明", "sleeve": "袖丈が不明", "waist": "ウエストが不明", "inseam": "股下が不明", "material": "素材不明 (要レビュー)"}
NG_FIBERS = {
    "polyester": "NG素材: polyester (表地ポリエステルはNG)",
    "polyurethane": "NG素材: polyurethane (ポリウレタンはNG)",
    "cotton": "NG素材: cotton (コットンはNG)",
}
NG_STYLE = {"double": "NG: ダブルブレスト", "one": "NG: 1ボタンジャケット", "gold": "NG: 金ボタン", "silver": "NG: 銀ボタン"}
SEVERE_STAIN = "NG: ひどい汚れあり"
HOLE = "NG: 穴・破れあり"
LOST_BUY_NOW = "即決価格が削除されました (ステータス再確認時に検出)"
VERDICTS = ("MATCH", "REVIEW", "NO_MATCH")

#: The columns that `decide` adds.
DECIDED = (
    "blocking_reasons", "reasons", "score", "verdict", "needs_llm_review", "needs_human_review", "confidence",
    "needs_recheck", "warnings",
)


def rules_frame(spark: SparkSession, rules: Rules = RULES) -> DataFrame:
    """The thresholds as rows of rule, lo and hi; a threshold without an upper end has a null there."""
    pairs = {k: v if isinstance(v, tuple) else (v, None) for k, v in asdict(rules).items()}
    return spark.createDataFrame(
        [(k, float(lo), None if hi is None else float(hi)) for k, (lo, hi) in pairs.items()],
        "rule string, lo double, hi double",
    )


def rules_from_frame(frame: DataFrame) -> Rules:
    """Thresholds from such rows; rules that are missing keep their defaults, unknown names are left out."""
    kinds = asdict(RULES)
    rows = [r for r in frame.limit(len(kinds) * 2).collect() if r["rule"] in kinds]
    return replace(
        RULES,
        **{r["rule"]: (r["lo"], r["hi"]) if isinstance(kinds[r["rule"]], tuple) else type(kinds[r["rule"]])(r["lo"]) for r in rows}
    )


def _texts(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def price_over(price: Column, limit: int | Column) -> Column:
    return F.format_string("価格 %,d円 が上限 %,d円 を超えています", price, F.lit(limit))


def not_active(state: Column) -> Column:
    return F.concat(F.lit("販売状態が active でない: "), F.coalesce(state, F.lit("unknown")))


def out_of_range(label: str, value: Column, lo: float | Column, hi: float | Column) -> Column:
    least, most = F.lit(lo).cast("string"), F.lit(hi).cast("string")
    below = F.concat(F.lit("cm が下限 "), least, F.lit("cm を下回っています"))
    outside = F.concat(F.lit("cm が範囲外 ("), least, F.lit("–"), most, F.lit("cm)"))
    return F.concat(F.lit(f"{label} "), value.cast("string"), F.when(F.lit(hi) >= 99, below).otherwise(outside))


def inseam_never(value: Column) -> Column:
    return F.concat(F.lit("股下 "), value.cast("string"), F.lit("cm は絶対NG (70cm以下)"))


def inseam_short(value: Column, least: Column, double: Column) -> Column:
    note = F.when(double, " (裾ダブル許容)").otherwise("")
    return F.concat(F.lit("股下 "), value.cast("string"), F.lit("cm が最低値 "), least.cast("string"), F.lit("cm を下回っています"), note)


def rule_price(rules: Rules = RULES) -> Column:
    price = F.col("price")
    paid = F.coalesce(F.nullif(price["buy_now_price_jpy"], F.lit(0)), price["current_price_jpy"])
    return _texts(
        F.when((price["listing_type"] == "auction") & price["buy_now_price_jpy"].isNull(), NO_BUY_NOW),
        F.when(paid > rules.max_price, price_over(paid, rules.max_price)).when(paid.isNull(), NO_PRICE),
    )


def rule_status() -> Column:
    state = F.col("status")["normalized_status"]
    return _texts(F.when(~state.eqNullSafe("active"), not_active(state)))


def rule_jacket(rules: Rules = RULES) -> tuple[Column, Column]:
    """(blocking reasons, notes)"""
    jacket = F.col("size")["jacket"]
    shoulder, chest, sleeve = (jacket[f]["value"] for f in ("shoulder_cm", "chest_width_cm", "sleeve_cm"))
    outside = lambda label, v, r: F.when(~v.between(*r), out_of_range(label, v, *r))
    return _texts(
        outside("肩幅", shoulder, rules.shoulder), outside("身幅", chest, rules.chest),
        F.when(sleeve < rules.sleeve[0], out_of_range("袖丈", sleeve, *rules.sleeve)),
    ), _texts(
        F.when(shoulder.isNull(), UNKNOWN["shoulder"]), F.when(chest.isNull(), UNKNOWN["chest"]),
        F.when(sleeve.isNull(), UNKNOWN["sleeve"]).when(sleeve > rules.sleeve[1], out_of_range("袖丈", sleeve, *rules.sleeve)),
    )


def rule_pants(rules: Rules = RULES) -> tuple[Column, Column]:
    """(blocking reasons, notes)"""
    pants = F.col("size")["pants"]
    flat, girth, inseam, hem, thigh = (
        pants[f]["value"] for f in ("waist_flat_cm", "waist_circumference_cm", "inseam_cm", "hem_width_cm", "thigh_cm")
    )
    double = pants["hem_finish"]["value"].eqNullSafe("double")
    least = F.when(double, rules.inseam_double).otherwise(rules.inseam)
    waist = F.when(flat.isNotNull(), F.when(~flat.between(*rules.waist_flat), out_of_range("ウエスト平置き", flat, *rules.waist_flat))).when(
        ~girth.between(*rules.waist_girth), out_of_range("ウエスト周り", girth, *rules.waist_girth)
    )
    return _texts(
        waist, F.when(inseam <= rules.inseam_never, inseam_never(inseam)).when(inseam < least, inseam_short(inseam, least, double)),
        F.when(hem < rules.hem_width, out_of_range("裾幅", hem, rules.hem_width, 99)),
        F.when(thigh < rules.thigh, out_of_range("ワタリ", thigh, rules.thigh, 99)),
    ), _texts(F.when(flat.isNull() & girth.isNull(), UNKNOWN["waist"]), F.when(inseam.isNull(), UNKNOWN["inseam"]))


def rule_material() -> tuple[Column, Column]:
    """(blocking reasons, notes)"""
    outer = F.col("material")["outer_fibers"]
    names = F.create_map(*[F.lit(x) for pair in NG_FIBERS.items() for x in pair])
    blocking = F.array_compact(F.transform(outer, lambda f: F.try_element_at(names, f["fiber"])))
    return F.coalesce(blocking, F.array().cast("array<string>")), _texts(
        F.when(F.coalesce(F.size(outer), F.lit(0)) <= 0, UNKNOWN["material"])
    )


def rule_style() -> Column:
    style = F.col("style")
    return _texts(
        F.when(style["button_type"] == "double", NG_STYLE["double"]), F.when(style["button_count"] == 1, NG_STYLE["one"]),
        F.when(style["button_color"] == "gold", NG_STYLE["gold"]), F.when(style["button_color"] == "silver", NG_STYLE["silver"]),
    )


def rule_condition() -> Column:
    condition = F.col("condition")
    severe = F.exists(condition["warnings"], lambda w: w.contains("ひどい"))
    return _texts(
        F.when(condition["has_stain"].eqNullSafe(True) & severe, SEVERE_STAIN),
        F.when(condition["has_hole"].eqNullSafe(True), HOLE),
    )


def score() -> Column:
    """From 1.0, less for each reason, note and unknown size, more for mohair and wool; between 0 and 1."""
    share = lambda fiber: F.try_element_at(
        F.filter(F.col("material")["outer_fibers"], lambda f: f["fiber"] == fiber), F.lit(1),
    )["percentage"]
    mohair, wool = share("mohair"), share("wool")
    bonus = F.when(mohair >= 60, 0.15).when(mohair > 0, mohair / F.lit(60.0) * 0.05).otherwise(0.0) + F.when(wool >= 80, 0.05).otherwise(0.0)
    raw = F.lit(1.0) - F.size("blocking_reasons") * 0.4 - F.size("reasons") * 0.05 - F.coalesce(
        F.size(F.col("size")["unknown_fields"]), F.lit(0),
    ) * 0.03 + bonus
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(raw, 3)))


def needs_recheck(verdict: Column, blocking: Column) -> Column:
    """Whether a later run should look again: always after REVIEW, after NO_MATCH only if a price was all that lacked."""
    return F.when(verdict == "REVIEW", True).when(verdict == "NO_MATCH", F.forall(blocking, lambda r: r == NO_PRICE)).otherwise(False)


_NAMES = "cast(array() as array<string>)"
_FIBERS = "cast(array() as array<struct<fiber:string,percentage:int>>)"

#: Attributes without values, for rows that lack them.
EMPTY = {
    "material": f"named_struct('outer_fibers', {_FIBERS}, 'lining_fibers', {_FIBERS}, 'unknown_fields', {_NAMES}, 'warnings', {_NAMES}, 'confidence', 0.0D)",
    "style": "named_struct('button_type', cast(null as string), 'button_count', cast(null as int), 'button_color', cast(null as string), "
    f"'unknown_fields', {_NAMES}, 'warnings', {_NAMES}, 'confidence', 0.0D)",
    "condition": "named_struct('grade', cast(null as string), 'has_stain', cast(null as boolean), 'has_hole', cast(null as boolean), "
    f"'unknown_fields', {_NAMES}, 'warnings', {_NAMES}, 'confidence', 0.0D)",
}


def merge_attributes(rows: DataFrame) -> DataFrame:
    """rows with all six attribute structs; those that are missing or null become ones without values."""
    there = set(rows.columns)
    made = {name: F.lit(None) for name in EXTRACTORS if name not in there and name not in EMPTY}
    made |= {name: F.expr(f"coalesce({name}, {sql})" if name in there else sql) for name, sql in EMPTY.items()}
    return rows.withColumns(made)


def all_warnings() -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(F.col(n)["warnings"], none) for n in EXTRACTORS])


def _reasons(rules: Rules) -> list[Column]:
    (jacket, jacket_notes), (pants, pants_notes) = rule_jacket(rules), rule_pants(rules)
    material, material_notes = rule_material()
    blocking = F.concat(rule_price(rules), rule_status(), jacket, pants, material, rule_style(), rule_condition())
    return [blocking.alias("blocking_reasons"), F.concat(jacket_notes, pants_notes, material_notes).alias("reasons")]


def _decision(rules: Rules) -> list[list[Column]]:
    """The columns that `decide` adds, step by step: each step may use what the one before it added."""
    # a generator of one row, so that filters on a verdict don't copy all rules into themselves
    return [[F.inline(F.array(F.struct(*_reasons(rules))))], *_verdict(rules)]


def _verdict(rules: Rules) -> list[list[Column]]:
    unknowns = [F.coalesce(F.size(F.col(n)["unknown_fields"]), F.lit(0)) for n in ("size", "material", "style", "condition")]
    unsure = (F.col("unknown_count") >= rules.many_unknowns) | (F.col("score") < rules.least_score)
    verdict = F.when(F.size("blocking_reasons") > 0, "NO_MATCH").when(unsure, "REVIEW").otherwise("MATCH")
    return [
        [score().alias("score"), reduce(lambda a, b: a + b, unknowns).alias("unknown_count")],
        [verdict.alias("verdict")],
        [
            F.coalesce(F.size(F.col("size")["unknown_fields"]) > rules.fill_above, F.lit(False)).alias("needs_llm_review"),
            (F.col("verdict") == "REVIEW").alias("needs_human_review"),
            F.col("score").alias("confidence"),
            needs_recheck(F.col("verdict"), F.col("blocking_reasons")).alias("needs_recheck"),
            all_warnings().alias("warnings"),
        ],
    ]


def decide(attributes: DataFrame, rules: Rules = RULES) -> DataFrame:
    """attributes with blocking_reasons, reasons, score, verdict, the two review flags, confidence and warnings."""
    for step in once(rules, lambda: _decision(rules)):
        attributes = attributes.select("*", *step)
    return attributes.drop("unknown_count")


def decide_rule_sets(attributes: DataFrame, rule_sets: DataFrame, most: int = 10_000) -> DataFrame:
    """attributes decided under each of many rule sets: a row for every set, with its name in rule_set, and what `decide` adds.

    rule_sets has rule_set, rule, lo and hi, as rules_frame has them for one set. The sets are folded into one array of
    thresholds (a scalar subquery, no join), so attributes are extracted once however many there are. More than `most` sets are
    an error. A rule or end that a set lacks keeps its default; unknown rules are left out; of rows that repeat a rule the one
    with the largest ends counts; a null name is a name like any other; no sets give no rows.
    """
    kinds = asdict(RULES)
    ends = [F.max(F.when(F.col("rule") == name, F.struct("lo", "hi"))).alias(name) for name in kinds]
    sets = rule_sets.groupBy("rule_set").agg(*ends)
    whole = F.collect_list(F.struct("rule_set", *kinds))
    too_many = F.raise_error(F.concat(F.count("*").cast("string"), F.lit(f" rule sets, more than {most}")))
    array = sets.agg(F.when(F.count("*") <= most, whole).otherwise(too_many).alias("sets"))

    def rules_of(one: Column) -> Rules:
        def threshold(name: str) -> Column | tuple[Column, Column]:
            given, usual = one[name], kinds[name]
            if isinstance(usual, tuple):
                return F.coalesce(given["lo"], F.lit(usual[0])), F.coalesce(given["hi"], F.lit(usual[1]))
            return F.coalesce(given["lo"].cast("int" if isinstance(usual, int) else "double"), F.lit(usual))

        return replace(RULES, **{name: threshold(name) for name in kinds})

    rows = attributes.drop("rule_set", "rule_ends").withColumn("rule_ends", array.scalar())
    decided = F.transform("rule_ends", lambda one: F.struct(one.alias("rule_end"), *_reasons(rules_of(one))))
    rows = rows.select("*", F.inline(decided)).drop("rule_ends").withColumn("rule_set", F.col("rule_end")["rule_set"])
    for step in _verdict(rules_of(F.col("rule_end"))):
        rows = rows.select("*", *step)
    return rows.drop("unknown_count", "rule_end")
