"""Thresholds, bounds and priorities. The numbers and words are fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    """What makes a listing a match; every field can be changed with dataclasses.replace."""

    max_price: int = 30_000
    shoulder: tuple[float, float] = (43.0, 45.0)
    chest: tuple[float, float] = (51.0, 53.0)
    sleeve: tuple[float, float] = (60.0, 64.0)
    waist_flat: tuple[float, float] = (42.0, 45.0)
    waist_girth: tuple[float, float] = (84.0, 90.0)
    inseam: float = 74.0
    inseam_double: float = 71.0
    inseam_never: float = 70.0
    hem_width: float = 18.0
    thigh: float = 29.0
    many_unknowns: int = 6
    least_score: float = 0.5
    fill_above: int = 3
    images_above: int = 5


RULES = Rules()

#: Field, least and most plausible centimetres, name in messages, name in requests.
MEASURES = (
    ("jacket_shoulder_cm", 36.0, 55.0, "ジャケット肩幅", "肩幅 (cm)"),
    ("jacket_chest_width_cm", 44.0, 70.0, "ジャケット身幅", "身幅 (cm)"),
    ("jacket_length_cm", 60.0, 90.0, "ジャケット着丈", "着丈 (cm)"),
    ("jacket_sleeve_cm", 50.0, 75.0, "ジャケット袖丈", "袖丈 (cm)"),
    ("pants_waist_flat_cm", 30.0, 60.0, "パンツウエスト平置き", "ウエスト平置き (cm)"),
    ("pants_waist_circ_cm", 60.0, 120.0, "パンツウエストぐるり", "ウエスト周り (cm)"),
    ("pants_rise_cm", 20.0, 40.0, "パンツ股上", "股上 (cm)"),
    ("pants_inseam_cm", 55.0, 95.0, "パンツ股下", "股下 (cm)"),
    ("pants_hem_width_cm", 14.0, 30.0, "パンツ裾幅", "裾幅 (cm)"),
    ("pants_thigh_cm", 22.0, 45.0, "パンツワタリ", "ワタリ (cm)"),
    ("pants_total_length_cm", 85.0, 130.0, "パンツ総丈", "総丈 (cm)"),
)
BOUNDS = {field: (lo, hi, name) for field, lo, hi, name, _ in MEASURES}
FIELD_LABELS = {field: label for field, _, _, _, label in MEASURES}

#: In which order each extractor looks at the sources of evidence; others come last, as 99.
PRIORITIES = {
    "size": ("specs", "description", "title", "brand", "category", "all_text"),
    "price": ("price", "specs", "description", "all_text"),
    "material": ("specs", "description", "title", "all_text"),
    "style": ("specs", "title", "description", "all_text"),
    "condition": ("description", "specs", "title", "all_text"),
}

#: The text buckets of a page in the order of their evidence, with block type and confidence.
SIGNALS = (
    ("title", "title_text", "title", 1.0),
    ("price", "price_text", "price", 1.0),
    ("status", "status_text", "status", 1.0),
    ("specs", "specs_text", "specs", 0.95),
    ("brand", "brand_text", "brand", 0.95),
    ("category", "category_text", "category", 0.8),
    ("description", "description_text", "description", 0.85),
    ("all_text", "all_text", "all_text", 0.6),
)

#: Parts of a URL that name a site, in the order of the checks; any other URL is the last site's.
SITES = (
    ("mercari.com", "mercari"),
    ("store.shopping.yahoo.co.jp", "yahoo_shopping"),
    ("paypayfleamarket.yahoo.co.jp", "paypay_flea_market"),
)
DEFAULT_SITE = "yahoo_auctions"
