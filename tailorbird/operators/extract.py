"""Attributes of listings from their evidence: size, price, status, material, style and condition.

Each extractor gives columns over an item's own array of blocks, in one or more steps, and a struct over them. An array is
sorted once by the order in which an extractor looks at its sources; a fold over it stops at the first block that
matches. So an item is decided within its row, and nothing is dealt out or gathered. An item whose texts say nothing
about an attribute gets nulls, empty arrays and the names of the unknown fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BOUNDS
from ..functions import patterns as P
from ..functions.text import found, implausible_message, norm_ja, parse_jpy
from .evidence import BLOCKS, first_block, first_value, joined_texts, ordered_blocks

_T = F.col
FIBER = "array<struct<fiber:string,percentage:int>>"
MEASURE = "struct<value:double,unit:string,confidence:double,evidence:string,source:string>"
CATEGORY = "struct<value:string,confidence:double,evidence:string,source:string>"


def _texts(*items: Column) -> Column:
    """An array of those texts that aren't null."""
    return F.array_compact(F.array(*[i.cast("string") for i in items]))


def _holds(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _first_of(pairs, otherwise: Column | None = None) -> Column:
    """The first of (condition, value) pairs whose condition holds."""
    (condition, value), *rest = pairs
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


# --- size ---------------------------------------------------------------------------------------------------


def target_size(text: Column) -> Column:
    """The size token of a text, by its canonical name."""
    return _first_of((text.rlike(P.size_token(s)), F.lit(P.SIZE_NAMES[s.lower()])) for s in P.SIZE_ORDER)


def size_table(text: Column) -> Column:
    """The rows of a size table in a text: an array of (size, row), sizes by their canonical names."""
    names = F.create_map(*[F.lit(x) for pair in P.SIZE_NAMES.items() for x in pair])
    rows = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(P.SIZE_ROW), F.lit(1)).alias("raw"),
        F.regexp_extract_all(text, F.lit(P.SIZE_ROW), F.lit(2)).alias("row"),
    )
    named = F.transform(rows, lambda r: F.struct(F.try_element_at(names, F.lower(r["raw"])).alias("size"), F.trim(r["row"]).alias("row")))
    return F.filter(named, lambda r: r["size"].isNotNull())


def narrow_size_table() -> dict[str, Column]:
    """Over an item's blocks: the rows of the tables that they hold, and whether a block's table has two or more sizes. Null without a table."""
    bracket = F.exists("blocks", lambda b: b["t"].rlike(r"[【\[]"))
    tables = F.transform("blocks", lambda b: F.when(b["t"].rlike(r"[【\[]"), size_table(b["t"])))
    return {"n_tables": F.when(bracket, tables), "o_size": ordered_blocks("size")}


def narrow_to_size() -> dict[str, Column]:
    """`narrowed`, the size on sale of an item with such a table: the title's, else the first that its texts name."""
    many = F.transform("n_tables", lambda rows: F.coalesce(F.size(F.array_distinct(F.transform(rows, lambda r: r["size"]))) >= 2, F.lit(False)))
    title = F.try_element_at(F.filter("blocks", lambda b: b["source"] == "title"), F.lit(1))["t"]
    texts = F.filter("blocks", lambda b: b["source"].isin("description", "all_text"))
    named = F.aggregate(texts, F.lit(None).cast("string"), lambda found, b: F.coalesce(found, target_size(b["t"])))
    return {"n_many": many, "narrowed": F.when(F.exists(many, lambda m: m), F.coalesce(target_size(title), named))}


def size_blocks() -> dict[str, Column]:
    """The texts to look for measures in, in order: a table is cut to the row of the size on sale, and left out without one.

    Texts without a digit or a hem, which no pattern matches, aren't among them.
    """
    text = """CASE WHEN element_at(n_many, b.at + 1) THEN try_element_at(filter(element_at(n_tables, b.at + 1), r -> r.size = narrowed), -1).row ELSE b.t END"""
    made = "named_struct('text', {0}, 'low', {1}, 'source', b.source, 'confidence', b.confidence)"
    plain = F.expr(f"transform(o_size, b -> {made.format('b.t', 'b.low')})")
    cut = F.expr(f"filter(transform(o_size, b -> {made.format(text, f'lower({text})')}), b -> b.text IS NOT NULL)")
    return {"z_blocks": F.filter(F.when(F.col("narrowed").isNotNull(), cut).otherwise(plain), lambda b: b["text"].rlike(r"(?U)[\d裾]"))}


_HIT = "struct<evidence:string,source:string,confidence:double>"
_HEM = "struct<value:string,evidence:string,source:string,confidence:double>"


def size_evidence() -> dict[str, Column]:
    """The first match of each measure. Labels are looked for before patterns, in all texts and then in each."""

    def named(text: str, labels: tuple[str, ...]) -> str:
        return " OR ".join(f"contains({text}, {sql_text(label.lower())})" for label in labels)

    def first(name: str, pattern: str) -> str:
        hit = f"named_struct('evidence', regexp_extract(b.text, {sql_text(pattern)}, 0), 'source', b.source, 'confidence', b.confidence)"
        step = f"CASE WHEN found IS NOT NULL THEN found WHEN ({named('b.low', P.LABELS[name])}) AND b.text RLIKE {sql_text(pattern)} THEN {hit} END"
        fold = f"aggregate(z_blocks, CAST(NULL AS {_HIT}), (found, b) -> {step})"
        return f"CASE WHEN {named('z_all', P.LABELS[name])} THEN {fold} END"

    def hem(value: str, pattern: str) -> str:
        return f"WHEN b.text RLIKE {sql_text(pattern)} THEN named_struct('value', '{value}', 'evidence', regexp_extract(b.text, {sql_text(pattern)}, 0), 'source', b.source, 'confidence', b.confidence)"

    out = {f"e_{name}": F.expr(first(name, pattern)) for name, pattern in P.MEASURES.items()}
    fold = f"aggregate(z_blocks, CAST(NULL AS {_HEM}), (found, b) -> CASE WHEN found IS NOT NULL THEN found {hem('double', P.HEM_DOUBLE)} {hem('single', P.HEM_SINGLE)} END)"
    return out | {"s_hem": F.expr(f"CASE WHEN contains(z_all, '裾') THEN {fold} END")}


def size_numbers() -> dict[str, Column]:
    """The same with their numbers, which are taken from the evidence alone."""
    made = "named_struct('value', try_cast(regexp_extract(e_{0}.evidence, {1}, 1) AS double), 'evidence', e_{0}.evidence, 'source', e_{0}.source, 'confidence', e_{0}.confidence)"
    return {f"s_{n}": F.expr(f"CASE WHEN e_{n} IS NOT NULL THEN {made.format(n, sql_text(p))} END") for n, p in P.MEASURES.items()}


_PLAIN = ("s_waist_flat IS NULL AND s_waist_girth IS NULL", "s_waist.value <= 60")

#: What each measure is taken from, in SQL over the first matches.
_FROM = {
    "jacket_shoulder_cm": "s_shoulder",
    "jacket_chest_width_cm": "coalesce(s_chest, CASE WHEN s_girth IS NOT NULL THEN named_struct('value', bround(s_girth.value / 2, 1), "
    "'evidence', concat(s_girth.evidence, ' (胸囲→身幅 ÷2)'), 'source', s_girth.source, 'confidence', s_girth.confidence) END)",
    "jacket_length_cm": "s_length",
    "jacket_sleeve_cm": "s_sleeve",
    "pants_waist_flat_cm": f"coalesce(s_waist_flat, CASE WHEN {_PLAIN[0]} AND {_PLAIN[1]} THEN s_waist END)",
    "pants_waist_circ_cm": f"coalesce(CASE WHEN s_waist_flat IS NULL THEN s_waist_girth END, CASE WHEN {_PLAIN[0]} AND NOT {_PLAIN[1]} THEN s_waist END)",
    "pants_rise_cm": "s_rise",
    "pants_inseam_cm": "s_inseam",
    "pants_hem_width_cm": "s_hem_width",
    "pants_thigh_cm": "s_thigh",
    "pants_total_length_cm": "s_total_length",
}


def size_hits() -> dict[str, Column]:
    """The match of each measure, plausible or not."""
    return {f"h_{field}": F.expr(sql) for field, sql in _FROM.items()}


def size_values() -> dict[str, Column]:
    """The measures whose matches are plausible."""

    def value(field: str) -> str:
        h, (lo, hi, _) = f"h_{field}", BOUNDS[field]
        made = f"named_struct('value', {h}.value, 'unit', 'cm', 'confidence', bround({h}.confidence * 0.9D, 3), 'evidence', {h}.evidence, 'source', {h}.source)"
        return f"CAST(CASE WHEN {h}.value BETWEEN {lo}D AND {hi}D THEN {made} END AS {MEASURE})"

    return {f"v_{field}": F.expr(value(field)) for field in _FROM}


def size_result() -> Column:
    warnings, unknown = [F.when(_T("narrowed").isNotNull(), F.concat(F.lit("サイズ表を検出: '"), _T("narrowed"), F.lit("' 行のみを使用して判定しました")))], []
    made = {field: _T(f"v_{field}") for field in _FROM}
    said = lambda field: implausible_message(field, F.expr(f"h_{field}.value"))
    missing = lambda field: F.when(made[field].isNull(), field)
    girth = F.expr("CASE WHEN s_chest IS NULL THEN s_girth.value END")
    warnings += [
        said("jacket_shoulder_cm"),
        F.concat(F.lit("胸囲 "), girth.cast("string"), F.lit("cm → 身幅 "), F.format_string("%.1f", girth / 2), F.lit("cm に換算して判定")),
        *[said(f) for f in ("jacket_chest_width_cm", "jacket_length_cm", "jacket_sleeve_cm", "pants_waist_flat_cm", "pants_waist_circ_cm")],
        F.expr(
            f"CASE WHEN {_PLAIN[0]} THEN concat('ウエスト ', CAST(s_waist.value AS string), 'cm: ', CASE WHEN {_PLAIN[1]} THEN '平置きと仮定' ELSE '周囲と仮定' END, ' (明示なし)') END"
        ),
    ]
    unknown += [missing(f) for f in ("jacket_shoulder_cm", "jacket_chest_width_cm", "jacket_length_cm", "jacket_sleeve_cm")]
    unknown.append(F.expr(f"CASE WHEN {_PLAIN[0]} AND s_waist IS NULL THEN 'pants_waist_flat_cm' END"))
    for field in ("pants_rise_cm", "pants_inseam_cm", "pants_hem_width_cm", "pants_thigh_cm", "pants_total_length_cm"):
        warnings.append(said(field))
        unknown.append(missing(field))
    unknown.append(F.expr("CASE WHEN s_hem IS NULL THEN 'pants_hem_finish' END"))
    hem_finish = F.expr(
        "CASE WHEN s_hem IS NOT NULL THEN named_struct('value', s_hem.value, 'confidence', bround(s_hem.confidence * 0.9D, 3), 'evidence', s_hem.evidence, 'source', s_hem.source) END"
    )
    required = ("jacket_shoulder_cm", "jacket_chest_width_cm", "jacket_sleeve_cm", "pants_inseam_cm")
    confidence = F.bround(reduce(lambda a, b: a + b, [made[f].isNotNull().cast("int") for f in required]) / 4, 3)
    jacket = {
        "shoulder_cm": "jacket_shoulder_cm", "chest_width_cm": "jacket_chest_width_cm", "length_cm": "jacket_length_cm",
        "sleeve_cm": "jacket_sleeve_cm",
    }
    pants = {
        "waist_flat_cm": "pants_waist_flat_cm", "waist_circumference_cm": "pants_waist_circ_cm", "rise_cm": "pants_rise_cm",
        "inseam_cm": "pants_inseam_cm",
        "hem_width_cm": "pants_hem_width_cm", "thigh_cm": "pants_thigh_cm", "total_length_cm": "pants_total_length_cm",
    }
    return F.struct(
        F.struct(*[made[f].alias(n) for n, f in jacket.items()]).alias("jacket"),
        F.struct(*[made[f].alias(n) for n, f in pants.items()], hem_finish.cast(CATEGORY).alias("hem_finish")).alias("pants"),
        _texts(*unknown).alias("unknown_fields"), _texts(*warnings).alias("warnings"), confidence.alias("confidence"),
    )


# --- price --------------------------------------------------------------------------------------------------


def price_blocks() -> dict[str, Column]:
    return {"o_price": ordered_blocks("price")}


def price_texts() -> dict[str, Column]:
    amount = lambda b: parse_jpy(found(F.regexp_replace(b["t"], P.BUY_NOW, ""), P.ANY_PRICE, 1))
    own = F.filter("o_price", lambda b: b["source"] == "price")
    return {"p_text": joined_texts("o_price"), "p_any": F.try_element_at(F.filter(F.transform(own, amount), lambda a: a > 0), F.lit(1))}


def price_values() -> dict[str, Column]:
    amount = lambda pattern: parse_jpy(found(_T("p_text"), pattern, 1))
    current = F.coalesce(amount(P.CURRENT), amount(P.WINNING), _T("p_any"))
    return {
        "v_current": current, "v_buy_now": amount(P.BUY_NOW), "v_fixed": amount(P.FIXED), "v_shipping": amount(P.SHIPPING),
        "v_free": _T("p_text").rlike(P.SHIPPING_FREE),
    }


def price_result() -> Column:
    current, buy_now, fixed, shipping, free = (_T(f"v_{n}") for n in ("current", "buy_now", "fixed", "shipping", "free"))
    only_fixed = buy_now.isNull() & current.isNull() & fixed.isNotNull()
    kind = _first_of(
        [
            (buy_now.isNotNull() & current.isNotNull(), F.lit("auction")),
            (buy_now.isNotNull(), F.lit("buy_now_only")),
            (fixed.isNotNull(), F.lit("fixed_price")),
            (current.isNotNull(), F.lit("auction")),
        ]
    )
    now, at_once = F.coalesce(current, F.when(only_fixed, fixed)), F.coalesce(buy_now, F.when(only_fixed, fixed))
    sent = F.when(free, F.lit(0)).otherwise(shipping)
    yen = lambda label, value: F.concat(F.lit(label), value.cast("string"), F.lit("円"))
    said = _texts(
        yen("現在価格: ", current), yen("即決: ", buy_now), F.when(free, F.lit("送料込み")).otherwise(yen("送料: ", shipping)),
        F.when(only_fixed, yen("販売価格: ", fixed)),
    )
    unknown = _texts(
        F.when(kind.isNull(), "listing_type"), F.when(now.isNull(), "current_price_jpy"),
        F.when(at_once.isNull(), "buy_now_price_jpy"), F.when(sent.isNull(), "shipping_price_jpy"),
    )
    return F.struct(
        kind.alias("listing_type"), now.alias("current_price_jpy"), at_once.alias("buy_now_price_jpy"), sent.alias("shipping_price_jpy"),
        F.when(free, F.lit(True)).alias("shipping_included"), said.alias("evidence"), unknown.alias("unknown_fields"),
        _texts(F.when(kind.isNull(), F.lit("listing_type を特定できませんでした"))).alias("warnings"),
        F.when(now.isNotNull() | at_once.isNotNull(), F.lit(0.9)).otherwise(F.lit(0.3)).alias("confidence"),
    )


# --- status -------------------------------------------------------------------------------------------------


def status_texts() -> dict[str, Column]:
    return {
        "t_status": joined_texts(F.filter("blocks", lambda b: b["source"] == "status")),
        "t_other": joined_texts(F.filter("blocks", lambda b: b["source"].isin("title", "description", "all_text"))),
    }


def status_values() -> dict[str, Column]:
    def said(text: Column, state: str, confidence: float, which: tuple[str, ...]) -> tuple[Column, Column]:
        evidence = F.coalesce(*[found(text, p) for p in which])
        return evidence.isNotNull(), F.struct(
            F.lit(state).alias("state"), evidence.alias("evidence"), F.lit(confidence).alias("confidence"),
        )

    status, other = _T("t_status"), _T("t_other")
    rules = [
        said(status, "sold", 0.95, P.SOLD), said(status, "ended", 0.9, P.ENDED), said(status, "active", 0.9, P.ACTIVE),
        said(other, "sold", 0.8, P.SOLD), said(other, "ended", 0.75, P.ENDED), said(other, "active", 0.75, P.ACTIVE),
    ]
    raw = F.substring(F.when(status != "", status).otherwise(other), 1, 80)
    return {"v_state": _first_of(rules, F.struct(F.lit("unknown").alias("state"), raw.alias("evidence"), F.lit(0.3).alias("confidence")))}


def status_result() -> Column:
    got = _T("v_state")
    return F.struct(
        got["state"].alias("normalized_status"), got["evidence"].alias("raw_status"), got["evidence"].alias("evidence"),
        got["confidence"].alias("confidence"),
        _texts(F.when(got["state"] == "unknown", F.lit("販売状態を特定できませんでした"))).alias("warnings"),
    )


# --- material -----------------------------------------------------------------------------------------------


def sql_text(value: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fibers_of(text: str, low: str) -> str:
    """The fibres of a text in their fixed order, each once, with the first percentage that is given for it; in SQL. low is the text in lower case."""

    def one(fiber: str) -> str:
        shares = f"regexp_extract_all({text}, {sql_text(P.fiber_share(fiber))}, 1)"
        share = f"try_cast(try_element_at(filter({shares}, s -> s != ''), 1) AS int)"
        holds = " OR ".join(f"contains({low}, {sql_text(w)})" for w in P.FIBER_WORDS[fiber])
        return f"CASE WHEN ({holds}) AND {text} RLIKE {sql_text('(?iU)' + P.FIBERS[fiber])} THEN named_struct('fiber', '{fiber}', 'percentage', {share}) END"

    return f"CAST(array_compact(array({', '.join(map(one, P.FIBERS))})) AS {FIBER})"


def infer_100(fibers: Column) -> Column:
    """A single fibre without a percentage makes up all."""
    only = fibers[0]
    return F.when(
        (F.size(fibers) == 1) & only["percentage"].isNull(),
        F.array(F.struct(only["fiber"].alias("fiber"), F.lit(100).alias("percentage"))),
    ).otherwise(fibers)


def split_outer_lining(text: Column) -> tuple[Column, Column]:
    """The parts of a text about the outer cloth and the lining; an empty text where there is none."""
    outer, lining = F.regexp_instr(text, F.lit(P.OUTER)), F.regexp_instr(text, F.lit(P.LINING))
    behind_outer = outer + F.length(F.regexp_extract(text, P.OUTER, 0))
    behind_lining = lining + F.length(F.regexp_extract(text, P.LINING, 0))
    end = F.length(text) + 1
    part = lambda a, b: F.substring(text, a, F.greatest(b - a, F.lit(0)))
    both, none = (outer > 0) & (lining > 0), (outer == 0) & (lining == 0)
    outer_text = _first_of(
        [(both & (outer < lining), part(behind_outer, lining)), (outer > 0, part(behind_outer, end)), (none, text)],
        F.lit(""),
    )
    lining_text = _first_of([(both & (lining < outer), part(behind_lining, outer)), (lining > 0, part(behind_lining, end))], F.lit(""))
    return outer_text, lining_text


def material_blocks() -> dict[str, Column]:
    words = tuple(w for words in P.FIBER_WORDS.values() for w in words)
    return {"o_material": ordered_blocks("material", F.filter("blocks", lambda b: _holds(b["low"], words) & b["t"].rlike(P.ANY_FIBER)))}


def material_texts() -> dict[str, Column]:
    """Of each block that names a fibre, its parts about the outer cloth and the lining."""

    def one(b: Column) -> Column:
        outer, lining = split_outer_lining(b["t"])
        marked = reduce(lambda x, y: x | y, [b["t"].rlike(p) for p in (P.OUTER, P.LINING, P.SECTION)])
        key = F.struct(b["prio"].alias("prio"), b["pos"].alias("pos"))
        return F.struct(key.alias("key"), outer.alias("outer"), lining.alias("lining"), F.lower(outer).alias("outer_low"), F.lower(lining).alias("lining_low"), marked.alias("marked"), b["confidence"].alias("confidence"))

    return {"m_texts": F.transform("o_material", one)}


def material_fibers() -> dict[str, Column]:
    fibers = lambda text: f"CASE WHEN {text} <> '' THEN {fibers_of(text, text + '_low')} ELSE CAST(array() AS {FIBER}) END"
    return {
        "m_fibers": F.expr(
            f"transform(m_texts, x -> named_struct('key', x.key, 'outer', {fibers('x.outer')}, 'lining', {fibers('x.lining')}, 'marked', x.marked, 'confidence', x.confidence))"
        )
    }


def material_firsts() -> dict[str, Column]:
    sure = lambda x: x["marked"] | F.exists(F.concat(x["outer"], x["lining"]), lambda f: f["percentage"].isNotNull())

    def first(which: str, fits) -> Column:
        got = F.try_element_at(F.filter("m_fibers", lambda x: (F.size(x[which]) > 0) & fits(x)), F.lit(1))
        return F.when(got.isNotNull(), F.struct(got["key"].alias("key"), infer_100(got[which]).alias("fibers"), got["confidence"].alias("confidence")))

    return {"m_sure": first("outer", sure), "m_maybe": first("outer", lambda x: ~sure(x)), "m_lining": first("lining", lambda x: F.lit(True))}


def material_result() -> Column:
    sure, maybe = _T("m_sure"), _T("m_maybe")
    lining = F.when(sure.isNull() | (_T("m_lining")["key"] <= sure["key"]), _T("m_lining"))
    none = F.array().cast(FIBER)
    outer_fibers, lining_fibers = F.coalesce(sure["fibers"], maybe["fibers"], none), F.coalesce(lining["fibers"], none)
    from_outer = F.coalesce(sure["confidence"] * 0.9, F.when(maybe.isNotNull(), F.lit(0.3)), F.lit(0.0))
    confidence = F.bround(F.greatest(from_outer, F.coalesce(lining["confidence"] * 0.7, F.lit(0.0))), 3)
    no_outer = F.size(outer_fibers) == 0
    return F.struct(
        outer_fibers.alias("outer_fibers"), lining_fibers.alias("lining_fibers"),
        _texts(F.when(no_outer, "outer_fibers"), F.when(F.size(lining_fibers) == 0, "lining_fibers")).alias("unknown_fields"),
        _texts(F.when(no_outer, F.lit("表地素材を特定できませんでした"))).alias("warnings"), confidence.alias("confidence"),
    )


# --- style --------------------------------------------------------------------------------------------------


def style_blocks() -> dict[str, Column]:
    words = tuple(dict.fromkeys(w for name in ("style", "buttons", "color") for w in P.WORDS[name]))
    return {"o_style": ordered_blocks("style", F.filter("blocks", lambda b: _holds(b["low"], words)))}


def style_firsts() -> dict[str, Column]:
    def kind(b: Column) -> Column:
        return F.when(_holds(b["low"], P.WORDS["style"]), _first_of([(b["t"].rlike(P.DOUBLE), F.lit("double")), (b["t"].rlike(P.SINGLE), F.lit("single"))]))

    def count(b: Column) -> Column:
        worded = found(b["t"], P.BUTTONS_WORD, 1)
        named = _first_of((worded.contains(w), F.lit(n)) for w, n in P.BUTTON_WORDS.items())
        return F.when(_holds(b["low"], P.WORDS["buttons"]), F.coalesce(found(b["t"], P.BUTTONS, 1).try_cast("int"), F.when(b["t"].contains("ボタン"), named)))

    def color(b: Column) -> Column:
        return F.when(_holds(b["low"], P.WORDS["color"]), _first_of((b["t"].rlike(p), F.lit(c)) for c, p in P.BUTTON_COLORS.items()))

    return {"y_type": first_value("o_style", kind, "string"), "y_count": first_value("o_style", count, "int"), "y_color": first_value("o_style", color, "string")}


def style_result() -> Column:
    kind, count, color = _T("y_type"), _T("y_count"), _T("y_color")
    sure = lambda c: F.coalesce(F.bround(c["confidence"] * 0.9, 3), F.lit(0.0))
    return F.struct(
        kind["value"].alias("button_type"), count["value"].alias("button_count"), color["value"].alias("button_color"),
        _texts(
            F.when(kind.isNull(), "button_type"), F.when(count.isNull(), "button_count"),
            F.when(color.isNull(), "button_color"),
        ).alias("unknown_fields"),
        F.array().cast("array<string>").alias("warnings"), F.greatest(sure(kind), sure(count)).alias("confidence"),
    )


# --- condition ----------------------------------------------------------------------------------------------


def condition_blocks() -> dict[str, Column]:
    words = tuple(w for name in ("grade", "stain", "hole") for w in P.WORDS[name])
    return {"o_condition": ordered_blocks("condition", F.filter("blocks", lambda b: _holds(b["low"], words)))}


def condition_firsts() -> dict[str, Column]:
    def row(b: Column, value: Column, weight: float, warning: str | None = None) -> Column:
        return F.struct(
            value.alias("value"), (b["confidence"] * weight).alias("confidence"), F.lit(warning).cast("string").alias("warning"),
            F.struct(b["prio"].alias("prio"), b["pos"].alias("pos")).alias("key"),
        )

    def stain(b: Column) -> Column:
        rules = [
            (b["t"].rlike(P.NO_STAIN), row(b, F.lit(False), 0.85)),
            (b["t"].rlike(P.SEVERE_STAIN), row(b, F.lit(True), 0.9, "ひどい汚れの記述あり")),
            (b["t"].rlike(P.STAIN), row(b, F.lit(True), 0.9, "汚れの記述あり")),
        ]
        return F.when(_holds(b["low"], P.WORDS["stain"]), _first_of(rules))

    def hole(b: Column) -> Column:
        rules = [(b["t"].rlike(P.HOLE), row(b, F.lit(True), 0.9, "穴・破れの記述あり")), (b["t"].rlike(P.NO_HOLE), row(b, F.lit(False), 0.85))]
        return F.when(_holds(b["low"], P.WORDS["hole"]), _first_of(rules))

    def grade(b: Column) -> Column:
        return F.when(_holds(b["low"], P.WORDS["grade"]), _first_of((b["t"].rlike(p), row(b, F.lit(g), 0.85)) for g, p in P.GRADES.items()))

    kind = "struct<value:{},confidence:double,warning:string,key:struct<prio:int,pos:int>>"
    return {
        "c_grade": first_block("o_condition", grade, kind.format("string")), "c_stain": first_block("o_condition", stain, kind.format("boolean")),
        "c_hole": first_block("o_condition", hole, kind.format("boolean")),
    }


def condition_result() -> Column:
    grade, stain, hole = _T("c_grade"), _T("c_stain"), _T("c_hole")
    warnings = F.when(
        hole["key"] < stain["key"], _texts(hole["warning"], stain["warning"]),
    ).otherwise(_texts(stain["warning"], hole["warning"]))
    confidence = F.bround(F.greatest(F.lit(0.0), grade["confidence"], stain["confidence"], hole["confidence"]), 3)
    return F.struct(
        grade["value"].alias("grade"), stain["value"].alias("has_stain"), hole["value"].alias("has_hole"),
        _texts(
            F.when(grade.isNull(), "grade"), F.when(stain.isNull(), "has_stain"), F.when(hole.isNull(), "has_hole"),
        ).alias("unknown_fields"),
        warnings.alias("warnings"), confidence.alias("confidence"),
    )


# --- all together -------------------------------------------------------------------------------------------

#: For each attribute its columns over an item's blocks, step by step, and the result over these.
EXTRACTORS = {
    "size": (
        (
            narrow_size_table, narrow_to_size, size_blocks, lambda: {"z_all": F.array_join(F.transform("z_blocks", lambda b: b["low"]), "\n")},
            size_evidence, size_numbers, size_hits, size_values,
        ),
        size_result,
    ),
    "price": ((price_blocks, price_texts, price_values), price_result),
    "status": ((status_texts, status_values), status_result),
    "material": ((material_blocks, material_texts, material_fibers, material_firsts), material_result),
    "style": ((style_blocks, style_firsts), style_result),
    "condition": ((condition_blocks, condition_firsts), condition_result),
}


def fold_blocks(items: DataFrame, which: tuple[str, ...] = tuple(EXTRACTORS)) -> DataFrame:
    """items, whose `blocks` are an array of BLOCKS in the order of their places, with the named attributes instead, and `n_blocks`."""
    kept = [c for c in items.columns if c != "blocks"]
    built = [built_columns(name) for name in which]
    low = F.transform("blocks", lambda b: F.struct(*[b[f].alias(f) for f in ("pos", "source", "confidence", "t")], F.lower(b["t"]).alias("low")))
    rows = items.withColumns({"n_blocks": F.size("blocks"), "blocks": low})
    for step in range(max((len(steps) for steps, _ in built), default=0)):
        rows = rows.select("*", *[v.alias(k) for steps, _ in built for k, v in (steps[step].items() if step < len(steps) else ())])
    # one row in, one row out: the generator keeps later filters and projections from copying these expressions into themselves;
    # n_blocks goes through it too, as a filter on it would sink below all steps and make the texts twice, where the rows still lie in one task
    result = F.inline(F.array(F.struct("n_blocks", *[result.alias(name) for name, (_, result) in zip(which, built)])))
    return rows.select(*kept, result)


def extract(evidence: DataFrame, which: tuple[str, ...] = tuple(EXTRACTORS), normalized: bool = False) -> DataFrame:
    """item_id and a struct of each of the named attributes, of long evidence, whose blocks are gathered by item first.

    Texts are normalised unless `normalized` says that they are.
    """
    text = _T("text") if normalized else norm_ja(_T("text"))
    rows = evidence.select("item_id", F.struct("pos", "source", F.col("confidence").cast("double").alias("confidence"), text.alias("t")).cast(BLOCKS[6:-1]).alias("b"))
    items = rows.groupBy("item_id").agg(F.filter(F.sort_array(F.collect_list("b")), lambda b: b["t"].isNotNull()).alias("blocks"))
    return fold_blocks(items, which).drop("n_blocks")


_built: dict[tuple, tuple] = {}


def once(name, build):
    """What build() gives, built once for each connection to Spark. For columns, which hold names and no table."""
    key = (SparkContext._gateway, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def built_columns(name: str) -> tuple[list[dict[str, Column]], Column]:
    steps, result = EXTRACTORS[name]
    return once(name, lambda: ([step() for step in steps], result()))
