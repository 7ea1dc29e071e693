"""Text of drawings: scale notes, areas, layers, marks, openings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Drawing scales by their printed label.
ARCHITECTURAL = [('1/16" = 1\'-0"', 1 / 16), ('3/32" = 1\'-0"', 3 / 32), ('1/8" = 1\'-0"', 1 / 8), ('3/16" = 1\'-0"', 3 / 16), ('1/4" = 1\'-0"', 1 / 4), ('3/8" = 1\'-0"', 3 / 8), ('1/2" = 1\'-0"', 1 / 2), ('3/4" = 1\'-0"', 3 / 4), ('1" = 1\'-0"', 1.0), ('1-1/2" = 1\'-0"', 1.5), ('3" = 1\'-0"', 3.0)]
ENGINEERING = [10, 20, 30, 40, 50, 60]
METRIC = [10, 20, 25, 50, 75, 100, 125, 150, 200, 250, 300, 400, 500, 1000, 2000]
PX_PER_INCH = 72 * 2.0


def standard_scales() -> list[tuple[int, str, float]]:
    """(place, label, feet per pixel)."""
    rows = [(label, 1 / inches / PX_PER_INCH) for label, inches in ARCHITECTURAL]
    rows += [(f"1\" = {feet}'", feet / PX_PER_INCH) for feet in ENGINEERING]
    rows += [(f"1:{ratio}", ratio / 12 / PX_PER_INCH) for ratio in METRIC]
    return [(i, *row) for i, row in enumerate(rows)]


def canonical_scale_text(text: Column) -> Column:
    """Straight quotes, upper case, no white space; paper sizes become a boundary."""
    straight = F.regexp_replace(F.regexp_replace(text, "[“”″]", '"'), "[‘’′]", "'")
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.upper(straight), r"\s+", "  "), F.lit(" "))
    no_size = F.regexp_replace(F.regexp_replace(spaced, r" (?:ISO-?)?A[0-4] ", " | "), r" (?:ISO-?)?A[0-4]/", " |")
    return F.regexp_replace(no_size, r"\s+", "")


def scale_patterns() -> list[tuple[int, str, float, str]]:
    """(place, label, feet per pixel, pattern on canonical text): a key never starts or ends inside a longer number."""
    import re

    out = []
    for place, label, upp in standard_scales():
        full = label.replace(" ", "")
        keys = [full]
        if full.endswith("=1'-0\""):
            keys.append(full[:-3])
        elif full.endswith("'"):
            keys.append(full + '-0"')
        before = "(?<![0-9])" if label.startswith("1:") else "(?<![0-9/-])"
        out.append((place, label, upp, f"{before}(?:{'|'.join(map(re.escape, keys))})(?![0-9])"))
    return out


def material_kind(name: Column) -> Column:
    """Kind of a material by its name; the first that fits."""
    n = F.coalesce(name, F.lit(""))
    return (
        F.when(n.rlike(r"(?i)mortar|thin-?set"), "mortar").when(n.rlike("(?i)grout"), "grout").when(n.rlike("(?i)adhes|glue|bond|mastic"), "adhesive")
        .when(n.rlike(r"(?i)\btrim\b|\bprofile\b|top cap|edge cap|nosing|\bschiene\b|reducer"), "trim").otherwise("")
    )


def grout_coverage(length: Column, width: Column, thickness: Column, joint: Column, bag: Column, density: float = 8.33) -> Column:
    """Square feet that a bag of grout covers; 0 unless all sizes are positive."""
    ok = (length > 0) & (width > 0) & (thickness > 0) & (joint > 0) & (bag > 0)
    product = F.when(ok, length * width).otherwise(F.lit(1.0))
    pounds = ((length + width) / product) * thickness * joint * density
    return F.when(ok, bag / F.when(ok, pounds).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def coverage_per(value: Column) -> Column:
    """A derived coverage: whole from ten on, else two decimals."""
    return F.when(value >= 10, F.floor(value + 0.5).cast("double")).otherwise(F.floor(value * 100 + 0.5).cast("double") / 100)


def layer_tokens(name: Column) -> Column:
    """Words of a layer's name: what follows the last |, bind marks folded, upper case."""
    base = F.regexp_replace(F.substring_index(F.coalesce(name, F.lit("")), "|", -1), r"\$[0-9]+\$", "-")
    return F.filter(F.split(F.upper(base), "[^A-Z0-9]+"), lambda t: t != "")


def printed_area_sf(text: Column) -> Column:
    """Square feet of a printed area stamp (SF, SQ FT, m²); null for gross areas and other text."""
    t = F.upper(F.trim(text))
    number = F.replace(F.regexp_extract(t, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:SF|SQ\.?\s*FT\.?|S\.F\.|M2|M²)\b?", 1), F.lit(","), F.lit("")).try_cast("double")
    metric = t.rlike(r"(?:M2|M²)")
    return F.when(t.rlike(r"GSF|GROSS"), F.lit(None)).otherwise(F.when(metric, number / 0.09290304).otherwise(number))


def dimension_text(text: Column) -> Column:
    """Whether a whole string is a dimension such as 12'-4\"."""
    return F.trim(text).rlike(r"""^[0-9]+'\s*-?\s*[0-9]+(?:\s+[0-9]+/[0-9]+)?"$""")


def mark_shape(text: Column) -> Column:
    return text.rlike("^[A-Z]{1,3}-?[0-9]{1,3}[A-Z]?$")


def value_shape(text: Column) -> Column:
    return F.trim(text).rlike("^[0-9][0-9,]{0,6}$")


def normal_text(text: Column) -> Column:
    """Text as it is compared: compatibility forms folded (NFKC), white space to single spaces, lower case."""
    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    return F.lower(F.trim(F.regexp_replace(F.when(ascii_only, text).otherwise(folded(text)), r"[\s\u00A0]+", " ")))
