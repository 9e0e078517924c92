"""Scalar Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Beside ISO.  Where day and month could be either, the month comes first.
DATE_FORMATS = (
    "M/d/yyyy[ H:mm[:ss]]",
    "M-d-yyyy[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]",
    "yyyyMMdd[ H:mm[:ss]]",
)
SHORT_YEAR = "M/d/yy[ H:mm[:ss]]"  # 69 to 99 are of the last century
ISO_DATE = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
DECIMAL = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    """An absent optional column reads as all-missing."""
    return df[name] if name in df.columns else F.lit(None).cast(kind)


def number(df: DataFrame, name: str) -> Column:
    """Column as double; unreadable values and NaN become NULL."""
    column = column_or_null(df, name)
    value = column.try_cast("double")
    if name in df.columns and isinstance(df.schema[name].dataType, T.StringType):
        # Java also reads type suffixes and hexadecimal, which are no numbers in a data file.
        value = F.when(column.rlike(DECIMAL), value)
    return F.when(~F.isnan(value), value)


def moment(df: DataFrame, name: str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Column as timestamp; unreadable values become NULL."""
    column = column_or_null(df, name)
    if name not in df.columns or not isinstance(df.schema[name].dataType, T.StringType):
        return column.try_cast("timestamp")
    # A bare time would otherwise be read as that time of today.
    iso = F.when(column.rlike(ISO_DATE), column.try_cast("timestamp"))
    text = F.trim(column)
    short = F.try_to_timestamp(text, F.lit(SHORT_YEAR))
    short = F.when(F.year(short) > 2068, short - F.expr("INTERVAL 100 YEARS")).otherwise(short)
    spelled = (F.try_to_timestamp(text, F.lit(pattern)) for pattern in formats)
    return F.coalesce(iso, *spelled, short)


def share(part: Column, total: Column) -> Column:
    """part / total to six places; 0 on empty input."""
    return F.round(F.coalesce(F.try_divide(part, total), F.lit(0.0)), 6)


def sunday_calendar(day: Column) -> dict[str, Column]:
    """Calendar of the mart: weekday 0 = Sunday, boolean weekend."""
    weekday = F.dayofweek(day) - 1
    return {
        "weekday": weekday,
        "month": F.month(day),
        "year": F.year(day),
        "is_weekend": weekday.isin(0, 6),
    }


def monday_calendar(day: Column) -> dict[str, Column]:
    """Calendar of the model features: weekday 0 = Monday, weekend as 0/1."""
    weekday = F.weekday(day)
    return {
        "weekday": weekday,
        "month": F.month(day),
        "year": F.year(day),
        "is_weekend": weekday.isin(5, 6).cast("int"),
    }
