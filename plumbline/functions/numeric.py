"""Rounding, units and small arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors and defaults.
EPSILON = 2.220446049250313e-16
SF_TO_M2, FT_TO_M, IN_TO_MM, CF_TO_M3 = 0.09290304, 0.3048, 25.4, 0.028316846592
SF_PER_SY, CF_PER_CY, DEFAULT_ROLL_WIDTH_FT = 9.0, 27.0, 12.0


def number(value: Column) -> Column:
    """A double; text that isn't one, null and NaN are 0."""
    cast = value.try_cast("double")
    return F.when(cast.isNull() | F.isnan(cast), F.lit(0.0)).otherwise(cast)


def or_else(value: Column, other: float) -> Column:
    """value unless it is null, NaN or 0: then other."""
    cast = value.try_cast("double")
    return F.when(cast.isNull() | F.isnan(cast) | (cast == 0), F.lit(float(other))).otherwise(cast)


def round2_eps(value: Column) -> Column:
    """Half up at two decimals after adding the machine epsilon; for totals, reports, revisions, roll goods."""
    return F.floor((value + F.lit(EPSILON)) * 100.0 + 0.5).cast("double") / 100.0


def round2_plain(value: Column) -> Column:
    """Half up at two decimals; for overlaps and seams."""
    return F.floor(value * 100.0 + 0.5).cast("double") / 100.0


def round2_fixed(value: Column) -> Column:
    """Two decimals of the double's exact binary value, ties away from zero; for a shape's own figures.

    A double below 2**53/1000 is exact in 38 decimal digits closely enough to tell a tie: only multiples of 1/8 can be
    ties at the third decimal, and those print exactly.
    """
    eighth = value * 8.0
    tie = (eighth == F.floor(eighth).cast("double")) & (F.abs(eighth % 2) == 1)
    up = F.signum(value) * F.floor(F.abs(value) * 100.0 + 0.5).cast("double") / 100.0
    return F.when(tie, up).otherwise(F.regexp_replace(F.format_number(value, 2), ",", "").cast("double"))


def round1(value: Column) -> Column:
    return F.floor(value * 10.0 + 0.5).cast("double") / 10.0


def sf_to_m2(value: Column) -> Column:
    return value * SF_TO_M2


def ft_to_m(value: Column) -> Column:
    return value * FT_TO_M


def in_to_mm(value: Column) -> Column:
    return value * IN_TO_MM


def cf_to_m3(value: Column) -> Column:
    return value * CF_TO_M3


def cf_to_cy(value: Column) -> Column:
    return value / CF_PER_CY


def feet_inches(feet: Column) -> Column:
    """Whole feet and nearest inches, as 12'-4\"; twelve inches roll up to a foot, a minus sign leads."""
    total = F.floor(F.abs(feet) * 12.0 + 0.5).cast("long")
    sign = F.when((feet < 0) & (total > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(total / 12).cast("string"), F.lit("'-"), (total % 12).cast("string"), F.lit('"'))


def check_verdict(measured: Column, stated: Column) -> Column:
    """match within 1 %, close within 5 %, else off, judged on the error rounded to a tenth of a percent; null without a stated length."""
    error = F.abs(round1((measured - stated) / stated * 100.0))
    return F.when(stated.isNull() | (stated <= 0), F.lit(None).cast("string")).when(error <= 1, "match").when(error <= 5, "close").otherwise("off")


def calibrated(feet: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Feet per pixel of a stated length; null where the points coincide or the length isn't positive."""
    pixels = F.hypot(x2 - x1, y2 - y1)
    return F.when((pixels > 0) & (feet > 0), feet / pixels)


def round_up_to_inch(feet: Column) -> Column:
    return F.ceil(feet * 12.0 - 1e-6).cast("double") / 12.0


def roll_quantity(order_ft: Column, width_ft: Column, unit: Column) -> Column:
    """Order footage in the unit the roll sells in: lf, sf, else square yards."""
    area = order_ft * or_else(width_ft, DEFAULT_ROLL_WIDTH_FT)
    return F.when(unit == "lf", order_ft).when(unit == "sf", area).otherwise(area / SF_PER_SY)


def material_quantity(basis: Column, per: Column, whole: Column) -> Column:
    """basis / per; 0 where per isn't positive; rounded up to whole units unless whole is false."""
    coverage = F.greatest(F.lit(0.0), number(per))
    plain = F.when(coverage > 0, basis / coverage).otherwise(F.lit(0.0))
    return F.when(F.coalesce(whole, F.lit(True)), F.ceil(plain - 1e-9).cast("double")).otherwise(round2_eps(plain))


def parse_length(text: Column) -> Column:
    """Feet of a typed length: 12'-4\", 12' 4.5\", 12', 4\", 12 4 and 12.5; NaN for anything else, and for 12 inches or more after feet."""
    t = F.trim(text)
    t = F.regexp_replace(F.regexp_replace(t, "[’′]", "'"), "[”″]", '"')
    both = r"""^([0-9]+(?:\.[0-9]+)?)\s*(?:'|ft)\s*-?\s*([0-9]+(?:\.[0-9]+)?)\s*(?:"|in)?$"""
    feet = r"""^([0-9]*\.?[0-9]+)\s*(?:'|ft)$"""
    inch = r"""^([0-9]*\.?[0-9]+)\s*(?:"|in)$"""
    pair = r"^([0-9]+)\s+([0-9]+(?:\.[0-9]+)?)$"
    plain = r"^[0-9]*\.?[0-9]+$"
    inches = F.regexp_extract(t, both, 2).try_cast("double")
    second = F.regexp_extract(t, pair, 2).try_cast("double")
    nan = F.lit(float("nan"))
    return (
        F.when(t.rlike(both), F.when(inches < 12, F.regexp_extract(t, both, 1).try_cast("double") + inches / 12.0).otherwise(nan))
        .when(t.rlike(feet), F.regexp_extract(t, feet, 1).try_cast("double"))
        .when(t.rlike(inch), F.regexp_extract(t, inch, 1).try_cast("double") / 12.0)
        .when(t.rlike(pair), F.when(second < 12, F.regexp_extract(t, pair, 1).try_cast("double") + second / 12.0).otherwise(nan))
        .when(t.rlike(plain), t.try_cast("double"))
        .otherwise(nan)
    )
