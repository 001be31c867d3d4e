"""Key normalisation and numeric coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "<MISSING>"


def normalize_key(df: DataFrame, name: str) -> Column:
    """Whole numbers lose their decimal point, text is trimmed, blanks become null."""
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = F.when(value == F.floor(value), F.floor(value).cast("string"))
        text = F.coalesce(whole, F.nanvl(value.cast("double"), F.lit(None).cast("double")).cast("string"))
        return text
    if isinstance(kind, T.StringType):
        return F.nullif(F.trim(value), F.lit(""))
    return value.cast("string")


def category_key(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def to_number(value: Column) -> Column:
    """Numeric coercion: text that is no number, and NaN, become null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def filled_number(value: Column, fill: float) -> Column:
    return F.coalesce(to_number(value), F.lit(float(fill)))


def finite_or_null(value: Column) -> Column:
    """Report columns: NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
