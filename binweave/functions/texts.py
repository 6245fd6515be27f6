"""Text and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_names(text: Column) -> Column:
    """Comma-separated names, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")


def json_number(x: Column) -> Column:
    """A number that JSON can hold: NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def significant(x: Column) -> Column:
    """Rounded to eight significant digits."""
    return F.format_string("%.7e", x).cast("double")
