"""Text and unit normalisation as columns. Only `nfkc` and `html_to_text` leave the JVM, in Arrow batches.

Null in, null out; empty texts stay empty.
"""

from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import BOUNDS
from .patterns import FIBER_NAMES


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility normalisation: full-width to half-width, units in one sign to letters, and so on.

    Arrow's own utf8_normalize is of no use here: in the version at hand it leaves letters decomposed.
    """
    return pa.array([v if v is None or v.isascii() else normalize("NFKC", v) for v in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def html_to_text(html: pa.Array) -> pa.Array:
    """The text of HTML fragments, one line per piece of text; scripts and styles are left out."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden and data.strip():
                self.parts.append(data.strip())

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        parser = Text()
        parser.feed(value)
        parser.close()
        return "\n".join(parser.parts)

    return pa.array([one(v) for v in html.to_pylist()], pa.string())


def norm_ws(text: Column) -> Column:
    """White space of any kind, in runs, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_ja(text: Column) -> Column:
    return norm_ws(nfkc(text))


def norm_colon(text: Column) -> Column:
    return F.translate(text, "：／", ":/")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def clean_text(text: Column) -> Column:
    """What evidence goes through: tags to spaces, NFKC, colons, white space."""
    return norm_ws(norm_colon(nfkc(strip_tags(text))))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of a pattern's first match; null where nothing, or an empty text, matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_cm(raw: Column) -> Column:
    """The first number of a text in centimetres; one before `mm` or `ミリ` counts as millimetres."""
    bare = F.regexp_replace(F.trim(raw), "(?iu)cm|㎝|センチ", "")
    millimetres = found(bare, r"(?iU)(\d+(?:\.\d+)?)\s*(?:mm|ミリ)", 1)
    number = found(bare, r"(?U)(\d+(?:\.\d+)?)", 1)
    return F.coalesce(millimetres.try_cast("double") / 10, number.try_cast("double"))


def parse_jpy(raw: Column) -> Column:
    """The first run of digits of a price, without 円, commas and spaces."""
    return found(F.regexp_replace(raw, r"(?U)[円,，\s]", ""), r"(\d+)", 1).try_cast("int")


def cm_to_mm(value: Column) -> Column:
    return value * 10.0


def mm_to_cm(value: Column) -> Column:
    return value / 10.0


def plausible(field: str, value: Column) -> Column:
    """Whether a measure lies within its field's bounds; fields without bounds are always plausible."""
    lo, hi, _ = BOUNDS.get(field, (None, None, None))
    return F.lit(True) if lo is None else value.between(lo, hi)


def implausible_message(field: str, value: Column) -> Column:
    """The warning for a value outside its bounds; null for others."""
    lo, hi, name = BOUNDS[field]
    return F.when(~value.between(lo, hi), F.concat(F.lit(f"{name} "), value.cast("string"), F.lit(f"cm は妥当範囲外 ({lo}–{hi}cm)")))


def alias_lookup(raw: Column) -> Column:
    """A fibre's canonical name; other texts in lower case."""
    names = F.create_map(*[F.lit(x) for fiber, aliases in FIBER_NAMES.items() for alias in aliases for x in (alias, fiber)])
    return F.coalesce(F.try_element_at(names, F.lower(raw)), F.lower(raw))
