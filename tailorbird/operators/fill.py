"""Filling gaps from a table of external results: which listings are worth asking for, what to ask, how to merge.

Results are (item_id, pass, result VARIANT). Values only fill what the texts left empty; null, implausible and
non-numeric values fill nothing. Calling a model is not part of this.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FIELD_LABELS, RULES, Rules
from ..functions.patterns import FIBER_NAMES
from ..functions.text import alias_lookup, implausible_message, plausible
from .extract import FIBER, MEASURE

#: Confidence and source of values that a result filled in.
CONFIDENCE = 0.4
SOURCE = "llm_gemini"
JACKET = {
    "jacket_shoulder_cm": "shoulder_cm", "jacket_chest_width_cm": "chest_width_cm", "jacket_length_cm": "length_cm",
    "jacket_sleeve_cm": "sleeve_cm",
}
PANTS = {
    "pants_waist_flat_cm": "waist_flat_cm", "pants_waist_circ_cm": "waist_circumference_cm", "pants_rise_cm": "rise_cm",
    "pants_inseam_cm": "inseam_cm",
    "pants_hem_width_cm": "hem_width_cm", "pants_thigh_cm": "thigh_cm", "pants_total_length_cm": "total_length_cm",
}


def _unknown() -> Column:
    return F.size(F.col("size")["unknown_fields"])


def _no_fibers() -> Column:
    return F.size(F.col("material")["outer_fibers"]) <= 0


def ml_fill_candidates(attributes: DataFrame, images: bool = False, rules: Rules = RULES) -> DataFrame:
    """Rows worth asking for: many unknown sizes or no outer fibres, and a text.

    By images, to be asked once the answers about texts are merged: those with pictures that still lack more sizes than
    pictures are worth, or still have no fibres. Rows without a text aren't asked about at all, not even by images.
    """
    text = F.trim(F.concat_ws("\n", F.nullif("specs_text", F.lit("")), F.nullif("description_text", F.lit(""))))
    if images:
        return attributes.filter(((_unknown() > rules.images_above) | _no_fibers()) & (F.size("image_urls") > 0) & (text != ""))
    return attributes.filter(((_unknown() > rules.fill_above) | _no_fibers()) & (text != ""))


def ml_fill_requests(candidates: DataFrame, images: bool = False, keep: tuple[str, ...] = (), rules: Rules = RULES) -> DataFrame:
    """item_id, pass, about (size or material), prompt and images: a row for each question about a candidate. Columns of `keep` come along.

    Each question has a gate of its own: sizes are asked for if any is unknown, by images only if many are; fibres if there are none.
    """
    labels = F.create_map(*[F.lit(x) for pair in FIELD_LABELS.items() for x in pair])
    asked = F.filter(F.col("size")["unknown_fields"], lambda f: F.try_element_at(labels, f).isNotNull())
    lines = F.array_join(
        F.transform(asked, lambda f: F.concat(F.lit('  "'), f, F.lit('": '), F.try_element_at(labels, f), F.lit(" — number or null"))),
        "\n",
    )
    text = F.trim(F.concat_ws("\n", F.nullif("specs_text", F.lit("")), F.nullif("description_text", F.lit(""))))
    given = F.lit("The pictures show the listing.") if images else F.concat(F.lit("Listing text:\n"), text)
    size = F.concat(
        F.lit("Read the garment's measures in centimetres from a second-hand suit listing. Answer in JSON only, with these keys:\n"),
        lines, F.lit("\n"), given,
    )
    material = F.concat(
        F.lit(
            'Read the fibres from a second-hand suit listing. Answer in JSON only: {"outer_fibers": [{"fiber": name, "percentage": whole number or null}], "lining_fibers": [...]}\n'
            f"A name is one of {', '.join(FIBER_NAMES)}.\n"
            'For example, of 表地 ウール60% ポリエステル40%: {"outer_fibers": [{"fiber": "wool", "percentage": 60}, {"fiber": "polyester", "percentage": 40}], "lining_fibers": []}\n'
        ),
        given,
    )
    sizes = (_unknown() > rules.images_above) if images else F.lit(True)
    ask = F.array_compact(
        F.array(
            F.when((F.size(asked) > 0) & sizes, F.struct(F.lit("size").alias("about"), size.alias("prompt"))),
            F.when(_no_fibers(), F.struct(F.lit("material").alias("about"), material.alias("prompt"))),
        )
    )
    pictures = F.slice("image_urls", 1, 4) if images else F.lit(None).cast("array<string>")
    rows = candidates.select(
        "item_id", F.lit("image" if images else "text").alias("pass"), F.explode(ask).alias("a"), pictures.alias("images"),
        *keep
    )
    return rows.select("item_id", "pass", "a.about", "a.prompt", "images", *keep)


def answers(result: Column) -> Column:
    """A struct of what a result VARIANT says: a number or null for each measure, and both fibre lists."""
    numbers = [F.try_variant_get(result, f"$.{f}", "string").try_cast("double").alias(f) for f in (*JACKET, *PANTS)]
    # whatever name a result gives, it goes by its canonical one, so that rules see it
    fibers = [
        F.transform(F.try_variant_get(result, f"$.{key}", FIBER), lambda f: f.withField("fiber", alias_lookup(F.trim(f["fiber"])))).alias(key)
        for key in ("outer_fibers", "lining_fibers")
    ]
    return F.struct(*numbers, *fibers)


def fill_size(size: Column, said: Column) -> Column:
    """A size struct with its gaps filled from the answers of a result."""
    jacket, pants, filled, warnings = size["jacket"], size["pants"], [], []

    def number(field: str) -> Column:
        return said[field]

    def made(value: Column) -> Column:
        evidence = F.concat(F.lit("LLM抽出: "), value.cast("string"), F.lit("cm"))
        return F.struct(
            value.alias("value"), F.lit("cm").alias("unit"), F.lit(CONFIDENCE).alias("confidence"),
            evidence.alias("evidence"), F.lit(SOURCE).alias("source"),
        ).cast(MEASURE)

    def take(part: Column, field: str, name: str, alternative: Column | None = None) -> Column:
        value = number(field)
        fits = part[name].isNull() & value.isNotNull() & plausible(field, value)
        fits = fits if alternative is None else fits & ~alternative
        filled.append(F.when(fits, field))
        warnings.append(F.when(part[name].isNull(), implausible_message(field, value)))
        return F.coalesce(part[name], F.when(fits, made(value)))

    for field, name in JACKET.items():
        jacket = jacket.withField(name, take(size["jacket"], field, name))
    # a flat waist that is none may be a girth: then it fills that, and nothing is said about the flat one
    flat = number("pants_waist_flat_cm")
    as_girth = pants["waist_flat_cm"].isNull() & ~plausible("pants_waist_flat_cm", flat) & pants["waist_circumference_cm"].isNull() & plausible("pants_waist_circ_cm", flat)
    as_girth = F.coalesce(as_girth, F.lit(False))
    before = size["pants"]
    for field, name in PANTS.items():
        if name == "waist_flat_cm":
            pants = pants.withField(name, take(before, field, name))
            warnings[-1] = F.when(~as_girth, warnings[-1])
            both = before["waist_flat_cm"].isNull() & ~plausible(field, flat) & before["waist_circumference_cm"].isNull()
            warnings.append(F.when(both, implausible_message("pants_waist_circ_cm", flat)))
            filled.append(F.when(as_girth, field))
        elif name == "waist_circumference_cm":
            own = take(before, field, name, as_girth)
            warnings[-1] = F.when(~as_girth, warnings[-1])
            pants = pants.withField(name, F.coalesce(before[name], F.when(as_girth, made(flat)), own))
        else:
            pants = pants.withField(name, take(before, field, name))
    got = F.array_compact(F.array(*filled))
    out = size.withField("jacket", jacket).withField("pants", pants).withField(
        "unknown_fields", F.array_except(size["unknown_fields"], got),
    )
    out = out.withField("warnings", F.concat(size["warnings"], F.array_compact(F.array(*warnings))))
    return F.when(F.size(got) > 0, out).otherwise(size)


def fill_material(material: Column, said: Column) -> Column:
    """A material struct with its empty fibre lists filled from the answers of a result; only the outer ones stop being unknown."""
    outer, lining = said["outer_fibers"], said["lining_fibers"]
    new_outer = (F.size(material["outer_fibers"]) <= 0) & (F.size(outer) > 0)
    new_lining = (F.size(material["lining_fibers"]) <= 0) & (F.size(lining) > 0)
    known = F.filter(material["unknown_fields"], lambda f: f != "outer_fibers")
    return (
        material.withField("outer_fibers", F.when(new_outer, outer).otherwise(material["outer_fibers"]))
        .withField("lining_fibers", F.when(new_lining, lining).otherwise(material["lining_fibers"]))
        .withField("unknown_fields", F.when(new_outer, known).otherwise(material["unknown_fields"]))
    )


def ml_fill_join(attributes: DataFrame, results: DataFrame, passes: tuple[str, ...] = ("text", "image")) -> DataFrame:
    """attributes with size and material filled from the results of each pass in turn; an item has one result a pass."""
    results = results.filter(F.col("pass").isin(*passes)).groupBy("item_id").pivot("pass", list(passes)).agg(F.first(F.to_json("result"), ignorenulls=True))
    out = attributes.join(results.hint("merge"), "item_id", "left")

    def apply(rows: DataFrame, name: str) -> DataFrame:
        # generators of one row, so that neither the next step nor a filter copies these expressions into itself: a result's
        # text is parsed once, and each of its numbers is taken out once
        once = lambda df, column, as_: df.select("*", F.inline(F.array(F.struct(column.alias(as_)))))
        rows, names = once(once(rows, F.try_parse_json(F.col(name)), "_result"), answers(F.col("_result")), "_said"), rows.columns
        filled = F.struct(fill_size(F.col("size"), F.col("_said")).alias("size"), fill_material(F.col("material"), F.col("_said")).alias("material"))
        return rows.select(*[c for c in names if c not in ("size", "material")], F.inline(F.array(filled))).select(*names)

    return reduce(apply, passes, out).drop(*passes)
