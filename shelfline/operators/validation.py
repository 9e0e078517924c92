"""Time-ordered validation: the last dates are held out, never random rows.

Only the distinct dates are ever gathered, a set bounded by the calendar; they reach the row
plan as scalar subqueries, so the date filters still push down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.schema import DATE, MONTH, require_columns


def _day(date_column: str) -> Column:
    return F.to_date(F.col(date_column))


def from_day(df: DataFrame, start: Column, date_column: str = DATE) -> Column:
    """Rows of `start` or later; a table stored by month is pruned by its folders as well."""
    late = _day(date_column) >= start
    return late & (F.col(MONTH) >= F.trunc(start, "month")) if MONTH in df.columns else late


def before_day(df: DataFrame, end: Column, date_column: str = DATE) -> Column:
    early = _day(date_column) < end
    return early & (F.col(MONTH) <= F.trunc(end, "month")) if MONTH in df.columns else early


def between_days(df: DataFrame, first, last, date_column: str = DATE) -> Column:
    """Rows of two days and those between them."""
    within = _day(date_column).between(first, last)
    if MONTH not in df.columns:
        return within
    first, last = F.lit(first).cast("date"), F.lit(last).cast("date")
    return within & F.col(MONTH).between(F.trunc(first, "month"), F.trunc(last, "month"))


def _distinct_days(df: DataFrame, date_column: str) -> DataFrame:
    require_columns(df, [date_column], "validation input")
    days = df.select(_day(date_column).alias("day"))
    return days.where(F.col("day").isNotNull()).distinct()


def _checked(ok: Column, value: Column, message: str, kind: str = "date") -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def holdout_start(df: DataFrame, date_column: str = DATE, holdout_days: int = 28) -> Column:
    """First held-out date: the `holdout_days`-th latest observed one."""
    if holdout_days <= 0:
        raise ValueError("holdout_days must be positive")
    latest = _distinct_days(df, date_column).orderBy(F.desc("day")).limit(holdout_days + 1)
    days = F.sort_array(F.collect_list("day"), asc=False)
    start = latest.agg(
        _checked(
            F.size(days) > holdout_days,
            F.get(days, F.lit(holdout_days - 1)),
            f"not enough dates to hold out {holdout_days}",
        ).alias("day")
    )
    return start.scalar()


def label_holdout(
    df: DataFrame, date_column: str = DATE, holdout_days: int = 28, name: str = "role"
) -> DataFrame:
    """Both sides of the split in one pass: `name` is train or holdout."""
    late = _day(date_column) >= holdout_start(df, date_column, holdout_days)
    dated = df.where(F.col(date_column).isNotNull())
    return dated.withColumn(name, F.when(late, "holdout").otherwise("train"))


def train_holdout_split(
    df: DataFrame, date_column: str = DATE, holdout_days: int = 28
) -> tuple[DataFrame, DataFrame]:
    """(train, holdout): the latest `holdout_days` observed dates are held out."""
    start = holdout_start(df, date_column, holdout_days)
    return (
        df.where(before_day(df, start, date_column)),
        df.where(from_day(df, start, date_column)),
    )


def make_time_splits(
    df: DataFrame, date_column: str, n_splits: int, horizon_days: int, gap: int = 0
) -> DataFrame:
    """One row per fold: consecutive validation blocks that end at the last date, each with
    all earlier dates but the `gap` nearest as training range."""
    if n_splits <= 0 or horizon_days <= 0:
        raise ValueError("n_splits and horizon_days must be positive")
    if gap < 0:
        raise ValueError("gap must not be negative")
    days = _distinct_days(df, date_column).agg(F.sort_array(F.collect_list("day")).alias("days"))
    needed = n_splits * horizon_days + 1 + gap
    start = F.size("days") - (n_splits - F.col("split") + 1) * horizon_days
    # Whichever columns are read, too few dates are an error.
    enough = F.size("days") >= needed
    days = days.select(_checked(enough, F.col("days"), f"{needed} dates are needed", "array<date>").alias("days"))
    folds = days.select(
        "days", F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("split")
    ).withColumn("start", start)
    return folds.select(
        "split",
        F.get("days", F.lit(0)).alias("train_start"),
        F.get("days", F.col("start") - 1 - gap).alias("train_end"),
        F.get("days", F.col("start")).alias("valid_start"),
        F.get("days", F.col("start") + horizon_days - 1).alias("valid_end"),
    )


def make_time_series_folds(
    df: DataFrame, validation_size: int, n_folds: int, gap: int = 0, date_column: str = DATE
) -> DataFrame:
    return make_time_splits(df, date_column, n_folds, validation_size, gap)


def split_by_fold(df: DataFrame, fold, date_column: str = DATE) -> tuple[DataFrame, DataFrame]:
    """(train, valid) for one fold given as a Row or dict."""
    require_columns(df, [date_column], "validation input")
    return tuple(
        df.where(between_days(df, fold[f"{role}_start"], fold[f"{role}_end"], date_column))
        for role in ("train", "valid")
    )


def assign_folds(df: DataFrame, folds: DataFrame, date_column: str = DATE) -> DataFrame:
    """Rows once per fold they belong to, with `split` and `role`; no join takes place."""
    require_columns(df, [date_column], "validation input")
    ranges = [
        F.struct(
            "split",
            F.lit(role).alias("role"),
            F.col(f"{role}_start").alias("start"),
            F.col(f"{role}_end").alias("end"),
        )
        for role in ("train", "valid")
    ]
    table = folds.agg(F.flatten(F.collect_list(F.array(*ranges)))).scalar()
    day = _day(date_column)
    own = F.filter("_folds", lambda fold: day.between(fold["start"], fold["end"]))
    return (
        df.withColumn("_folds", table)
        .withColumn("fold", F.explode(own))
        .select(*df.columns, "fold.split", "fold.role")
    )
