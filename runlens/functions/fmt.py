"""Number and duration texts."""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(v: float | None) -> str | None:
    """Shortest text that reads back as the same double, never in scientific form, whole numbers without a fraction."""
    if v is None:
        return None
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "inf" if v > 0 else "-inf"
    text = format(Decimal(repr(float(v))), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def significant(v: float | None, digits: int) -> str | None:
    """float_text with the fraction cut, not rounded, to so many significant digits; whole digits are never cut."""
    text = float_text(v)
    if text is None or "." not in text:
        return text
    whole, fraction = text.split(".")
    used = len(whole.lstrip("-0"))
    zeros = 0 if used else len(fraction) - len(fraction.lstrip("0"))
    keep = max(0, digits - used) + zeros
    fraction = fraction[:keep].rstrip("0")
    return f"{whole}.{fraction}" if fraction else whole


def float_text_udf(values: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([float_text(x) if x is not None and x is not pd.NA else None for x in v], dtype=object)

    column = F.col(values) if isinstance(values, str) else values
    return F.when(column.isNotNull(), run(column))  # pandas cannot tell null from NaN


def significant_udf(values: Column, digits: int) -> Column:
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([significant(x, digits) if x is not None and x is not pd.NA else None for x in v], dtype=object)

    return run(values)


def duration(seconds: Column) -> Column:
    """92s under two minutes, 4m05s, 2h11m, 54d13h from 48 hours on; empty if negative or not finite."""
    s = F.round(seconds).cast("long")
    text = F.when(s < 120, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
    text = text.when(s < 48 * 3600, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).otherwise(F.format_string("%dd%02dh", F.floor(s / 86400), F.floor(s % 86400 / 3600)))
    return F.when(F.isnan(seconds) | (seconds < 0) | (F.abs(seconds) == float("inf")) | seconds.isNull(), "").otherwise(text)
