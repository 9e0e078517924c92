"""Baseline forecasts as columns next to the rows they predict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.metrics import METRICS, error_sums, forecast_metrics, metrics_of_sums
from shelfline.operators.features import past, series_window
from shelfline.operators.ordered import RUN_ROWS, with_frames
from shelfline.operators.validation import assign_folds
from shelfline.schema import DATE, SERIES_KEYS, TARGET, require_columns

# Names of the baselines.
BASELINES = [
    "naive_last_value",
    "seasonal_naive_7",
    "seasonal_naive_28",
    "moving_average_7",
    "moving_average_28",
    "median_by_weekday",
]


def _series_baselines(target: str) -> dict[str, Column]:
    w = series_window()
    return {
        "naive_last_value": F.lag(target, 1).over(w),
        "seasonal_naive_7": F.lag(target, 7).over(w),
        "seasonal_naive_28": F.lag(target, 28).over(w),
        "moving_average_7": F.avg(target).over(past(w, 7)),
        "moving_average_28": F.avg(target).over(past(w, 28)),
    }


def _weekday_median(target: str) -> Column:
    same_weekday = Window.partitionBy(*SERIES_KEYS, F.weekday(DATE)).orderBy(DATE)
    return F.percentile(target, 0.5).over(past(same_weekday))


def add_baselines(
    df: DataFrame, names: list[str] | None = None, target: str = TARGET
) -> DataFrame:
    """Add the named baselines (all six by default).

    The series windows come first: their partitioning also serves the weekday windows, so
    everything happens behind one shuffle.
    """
    require_columns(df, [DATE, *SERIES_KEYS, target], "baseline input")
    names = names or BASELINES
    series = {k: v for k, v in _series_baselines(target).items() if k in names}
    if series:
        df = df.withColumns(series)
    if "median_by_weekday" in names:
        df = df.withColumn("median_by_weekday", _weekday_median(target))
    return df


def _add_frame(
    df: DataFrame, name: str, target: str, groups: list[str] | None, reach: int, run_rows: int, make
) -> DataFrame:
    groups = groups or SERIES_KEYS
    date = DATE if DATE in df.columns else "date"
    require_columns(df, [*groups, date, target], "baseline input")
    return with_frames(df, groups, date, reach, lambda w: {name: make(w)}, run_rows)


def add_seasonal_naive(
    df: DataFrame,
    season_length: int = 7,
    group_columns: list[str] | None = None,
    target: str = TARGET,
    name: str = "seasonal_naive",
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Value `season_length` rows earlier in the group."""
    return _add_frame(
        df, name, target, group_columns, season_length, run_rows,
        lambda w: F.lag(target, season_length).over(w),
    )


def add_moving_average(
    df: DataFrame,
    window: int = 28,
    group_columns: list[str] | None = None,
    target: str = TARGET,
    name: str = "moving_average",
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Mean of the `window` earlier rows in the group."""
    return _add_frame(
        df, name, target, group_columns, window, run_rows,
        lambda w: F.avg(target).over(past(w, window)),
    )


def baseline_metrics(
    df: DataFrame,
    names: list[str] | None = None,
    target: str = TARGET,
    common_rows: bool = False,
) -> DataFrame:
    """Long table baseline x metric x value over rows that carry baseline columns.

    Rows without a forecast are left out per baseline, or for all baselines alike when
    `common_rows` is set.  All metrics come from one aggregation of the rows.
    """
    names = names or BASELINES
    if common_rows:
        df = df.dropna(subset=names)
    wide = df.agg(
        *(
            value.alias(f"{name}__{metric}")
            for name in names
            for metric, value in forecast_metrics(F.col(target), F.col(name)).items()
        )
    )
    long = [
        F.struct(F.lit(name).alias("baseline"), F.lit(metric).alias("metric"),
                 F.col(f"{name}__{metric}").alias("value"))
        for name in names
        for metric in METRICS
    ]
    return wide.select(F.inline(F.array(*long)))


def daily_error_sums(
    df: DataFrame, names: list[str] | None = None, target: str = TARGET, date_column: str = DATE
) -> DataFrame:
    """(date, baseline, sums behind the metrics): one aggregation of rows that carry baselines, whose
    exchange holds a row per date and task.  Rows without a date are in no fold."""
    names = names or BASELINES
    sums = {n: error_sums(F.col(target), F.col(n)) for n in names}
    wide = (
        df.where(F.col(date_column).isNotNull())
        .groupBy(date_column)
        .agg(*(c.alias(f"{n}__{part}") for n, parts in sums.items() for part, c in parts.items()))
    )
    long = [
        F.struct(F.lit(n).alias("baseline"), *(F.col(f"{n}__{part}").alias(part) for part in parts))
        for n, parts in sums.items()
    ]
    return wide.select(date_column, F.inline(F.array(*long)))


def baseline_metrics_by_fold(
    df: DataFrame,
    folds: DataFrame,
    names: list[str] | None = None,
    target: str = TARGET,
    date_column: str = DATE,
) -> DataFrame:
    """(split, role, baseline, metric, value) of each fold's training and validation range.

    The metrics' sums are additive, so rows are summed per date once, and folds, which may overlap,
    are ranges of dates: no row of `df` is copied per fold.
    """
    daily = daily_error_sums(df, names, target, date_column)
    parts = [c for c in daily.columns if c not in (date_column, "baseline")]
    summed = (
        assign_folds(daily, folds, date_column)
        .groupBy("split", "role", "baseline")
        .agg(*(F.sum(c).alias(c) for c in parts))
    )
    wide = summed.select("split", "role", "baseline", *(c.alias(n) for n, c in metrics_of_sums().items()))
    return wide.unpivot(["split", "role", "baseline"], METRICS, "metric", "value")


def best_baseline(metrics: DataFrame) -> DataFrame:
    """The baseline with the smallest WMAPE, by name among equals."""
    wmape = metrics.where(F.lower("metric") == "wmape")
    return wmape.orderBy(F.col("value").asc_nulls_last(), "baseline").limit(1).select(
        "baseline", F.lit("wmape").alias("metric"), "value"
    )
