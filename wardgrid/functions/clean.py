"""Column functions for messy source values; each gives null where it cannot tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_TOKENS = ["", "NA", "NULL", "null", "nan", "NaN"]
#: Factors of unit conversions.
OUNCE_G, POUND_KG, INCH_CM, GLUCOSE, CREATININE = 28.3495, 0.4535924, 2.54, 18.0182, 88.4
#: Unit conversions (source, target).
CONVERSIONS: dict[tuple[str, str], Callable[[Column], Column]] = {
    ("F", "C"): lambda v: (v - 32.0) * (5.0 / 9.0),
    ("C", "F"): lambda v: v * (9.0 / 5.0) + 32.0,
    ("in", "cm"): lambda v: v * INCH_CM,
    ("cm", "in"): lambda v: v / INCH_CM,
    ("oz", "g"): lambda v: v * OUNCE_G,
    ("g", "oz"): lambda v: v / OUNCE_G,
    ("lb", "kg"): lambda v: v * POUND_KG,
    ("kg", "lb"): lambda v: v / POUND_KG,
    ("mg/dL_glu", "mmol/L_glu"): lambda v: v / GLUCOSE,
    ("mmol/L_glu", "mg/dL_glu"): lambda v: v * GLUCOSE,
    ("mg/dL_crea", "μmol/L_crea"): lambda v: v * CREATININE,
    ("μmol/L_crea", "mg/dL_crea"): lambda v: v / CREATININE,
}


def null_tokens(c: Column) -> Column:
    return F.when(~F.trim(c).isin(NULL_TOKENS), c)


def number(c: Column) -> Column:
    """A number, after comparison and question marks and before a per cent sign."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^[?<>=\s]+", ""), r"\s*%$", "").try_cast("double")


def leading_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")


def convert_unit(v: Column, source: str, target: str) -> Column:
    """v in the target unit; an unknown pair is an error."""
    if source == target:
        return v
    return CONVERSIONS[source, target](v)


def stay_key(c: Column, dataset: str) -> Column:
    """The id with the dataset's prefix, added only where it is absent."""
    prefix = {"mimic_iv": "miiv"}.get(dataset, dataset) + "_"
    return F.when(c.cast("string").startswith(prefix), c.cast("string")).otherwise(F.concat(F.lit(prefix), c.cast("string")))


def offset_time(anchor: Column, offset: Column, unit: str) -> Column:
    """anchor + offset; days and hours go by whole minutes."""
    minutes = {"day": 1440.0, "hour": 60.0, "min": 1.0}
    us = F.round(offset * minutes[unit]) * 60_000_000 if unit in minutes else F.round(offset) * 1_000_000
    return F.timestamp_micros(F.unix_micros(anchor.cast("timestamp")) + us.cast("long"))


def lenient_time(*cs: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c) for c in cs])


def age(c: Column) -> Column:
    """'> 89' is 90; at most 120."""
    years = F.when(F.trim(c).startswith(">"), F.lit(90.0)).otherwise(c.try_cast("double"))
    return F.when(years > 120, 120.0).otherwise(years)


def sex_male(c: Column) -> Column:
    s = F.lower(F.substring(F.trim(c), 1, 1))
    return F.when(s == "m", 1.0).when(s == "f", 0.0).otherwise(0.5).cast("float")


def within(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high) & ~F.isnan(c), c)


def first_class(name: Column, hints: list[tuple[str, str]], default: str = "other") -> Column:
    """Class of the first hint, in order, that the lower-case name contains; hints keep their order, as one may hold another."""
    out = F.lit(default)
    for hint, kind in reversed(hints):
        out = F.when(F.lower(name).contains(hint), kind).otherwise(out)
    return F.when(name.isNull(), default).otherwise(out)


def first_regex(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), kind).otherwise(out)
    return out


def drug_token(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z][a-z\-]+)", 1), F.lit(""))


def unit_suffix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\(([^)]+)\)\s*$", 1), F.lit(""))


def icd_first(c: Column) -> Column:
    return F.nullif(F.trim(F.split(c, ",")[0]), F.lit(""))


def icd_root(c: Column) -> Column:
    return F.upper(F.substring(F.regexp_replace(c, r"\.", ""), 1, 3))


def icd_version(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Za-z]"), "10").otherwise("9")


def gcs_total(eye: Column, motor: Column, verbal: Column) -> Column:
    """Sum of coded parts such as '4 spontaneous', each within its range; null unless all three are there."""
    part = lambda c, high: within(leading_number(F.trim(c)), 1, high)
    return part(eye, 4) + part(motor, 6) + part(verbal, 5)


def clean_note(c: Column) -> Column:
    """Without de-identification brackets, whole or torn, and underscore runs, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(c, r"\[\*\*[^\]]*\*\*\]", " "), r"\[\*\*|\*\*\]|_{2,}", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def stream_code(category: Column, name: Column) -> Column:
    return F.concat_ws("//", F.upper(category), name)


def canonical_units(events: DataFrame, concepts: DataFrame, clip: bool = False, sentinel: float | None = None) -> DataFrame:
    """events with the unit of their concept, and values outside its range dropped (or clipped).

    concepts is (concept, canonical_unit, low, high). Sentinels become null before ranges apply; nulls are dropped.
    """
    v = F.col("value") if sentinel is None else F.when(F.abs("value") < sentinel, F.col("value"))
    met = events.withColumn("value", v).join(concepts, "concept", "left").withColumn("unit", F.coalesce("canonical_unit", "unit"))
    if clip:
        met = met.withColumn("value", F.when(F.col("value").isNotNull(), F.greatest(F.least("value", F.coalesce("high", "value")), F.coalesce("low", "value"))))
    else:
        met = met.where(F.coalesce(F.col("value") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("high"), F.lit(True)))
    return met.where("value is not null").select(*events.columns)
