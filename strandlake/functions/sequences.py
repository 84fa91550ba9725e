"""Column expressions on aligned rows; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The symbols of a gap and of missing data.
GAPS = "-._"
MISSING = "~"


def residues(aseq: Column) -> Column:
    """Letters of an aligned row in upper case, T as U."""
    return F.translate(F.upper(F.regexp_replace(aseq, "[^A-Za-z]", "")), "T", "U")


def n_letters(aseq: Column) -> Column:
    return F.length(F.regexp_replace(aseq, "[^A-Za-z]", ""))


def norm_name(name: Column) -> Column:
    """Family name without padding and case; null stays null."""
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def identity_threshold(raw: Column) -> Column:
    """Fraction of an identity filter; null where the filter is off.

    Above 1 it is a percentage; null, NaN, negative and exactly 1 switch it off.
    """
    return F.when(raw.isNull() | F.isnan(raw) | (raw < 0) | (raw == 1), None).when(raw > 1, raw / 100).otherwise(raw)
