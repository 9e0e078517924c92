"""Leak-free time-series features at mart grain.

Lags and frames count rows of a series, not calendar days.  A series (stock_code, market_id)
has one row per day in the mart, so its length is bounded by the calendar whatever the
number of invoices; equal window specs share one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shelfline.functions.columns import monday_calendar
from shelfline.operators.ordered import RUN_ROWS, with_frames
from shelfline.schema import DATE, SERIES_KEYS, TARGET, require_columns

# Column names.
FEATURE_INPUTS = [DATE, *SERIES_KEYS, TARGET, "avg_unit_price", "invoices_cnt", "customers_cnt"]


def series_window() -> WindowSpec:
    return Window.partitionBy(*SERIES_KEYS).orderBy(DATE)


def past(window: WindowSpec, rows: int | None = None) -> WindowSpec:
    """The `rows` rows before the current one; all earlier rows when not given."""
    start = Window.unboundedPreceding if rows is None else -rows
    return window.rowsBetween(start, -1)


def _lags(w: WindowSpec) -> dict[str, Column]:
    lags = {f"lag_{n}": F.lag(TARGET, n).over(w) for n in (7, 14, 28)}
    for count in ("invoices_cnt", "customers_cnt"):
        lags[f"{count}_lag_7"] = F.lag(count, 7).over(w)
    return lags


def _rolling(w: WindowSpec) -> dict[str, Column]:
    return {
        "rolling_mean_7": F.avg(TARGET).over(past(w, 7)),
        "rolling_mean_28": F.avg(TARGET).over(past(w, 28)),
        "rolling_std_28": F.stddev_samp(TARGET).over(past(w, 28)),
        "rolling_median_28": F.percentile(TARGET, 0.5).over(past(w, 28)),
    }


def _price_lag(w: WindowSpec) -> dict[str, Column]:
    return {"avg_unit_price_lag_7": F.lag("avg_unit_price", 7).over(w)}


def _price_changes() -> dict[str, Column]:
    change = F.col("avg_unit_price") - F.col("avg_unit_price_lag_7")
    return {
        "price_change_abs": change,
        "price_change_pct": F.try_divide(change, F.col("avg_unit_price_lag_7")),
    }


def _sale_history(w: WindowSpec) -> dict[str, Column]:
    sold = F.col(TARGET) > 0
    return {
        "_row": F.row_number().over(w),
        "_sale_date": F.max(F.when(sold, F.col(DATE))).over(past(w)),
    }


def _pauses(w: WindowSpec) -> dict[str, Column]:
    """Days since the last earlier sale, and earlier rows without a sale since then."""
    last_row = F.max(F.when(F.col(TARGET) > 0, F.col("_row"))).over(past(w))
    return {
        "days_since_last_sale": F.date_diff(DATE, F.col("_sale_date")),
        "zero_sales_streak": F.col("_row") - 1 - F.coalesce(last_row, F.lit(0)),
    }


def add_lag_features(df: DataFrame) -> DataFrame:
    require_columns(df, FEATURE_INPUTS, "feature input")
    return df.withColumns(_lags(series_window()))


def add_rolling_features(df: DataFrame) -> DataFrame:
    require_columns(df, FEATURE_INPUTS, "feature input")
    return df.withColumns(_rolling(series_window()))


def add_price_features(df: DataFrame) -> DataFrame:
    require_columns(df, FEATURE_INPUTS, "feature input")
    return df.withColumns(_price_lag(series_window())).withColumns(_price_changes())


def add_calendar_features(df: DataFrame) -> DataFrame:
    require_columns(df, [DATE], "feature input")
    return df.withColumns(monday_calendar(F.col(DATE)))


def add_zero_sales_features(df: DataFrame) -> DataFrame:
    require_columns(df, FEATURE_INPUTS, "feature input")
    w = series_window()
    return df.withColumns(_sale_history(w)).withColumns(_pauses(w)).drop("_row", "_sale_date")


def feature_view(mart: DataFrame) -> DataFrame:
    """Mart columns plus all features, with the mart's own calendar."""
    require_columns(mart, FEATURE_INPUTS, "feature input")
    w = series_window()
    return (
        mart.withColumns(_lags(w) | _rolling(w) | _price_lag(w) | _sale_history(w))
        .withColumns(_price_changes() | _pauses(w))
        .drop("_row", "_sale_date")
    )


def feature_matrix(mart: DataFrame) -> DataFrame:
    """All features for the model, with the Monday-first calendar."""
    return add_calendar_features(feature_view(mart))


def add_lag_rolling_features(
    df: DataFrame,
    group_columns: list[str] | None = None,
    target: str = TARGET,
    lags: tuple[int, ...] = (7, 14, 28),
    windows: tuple[int, ...] = (7, 28),
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Lags and rolling means for any grouping; the date column is sales_date or date."""
    groups = group_columns or SERIES_KEYS
    date = DATE if DATE in df.columns else "date"
    require_columns(df, [*groups, date, target], "feature input")

    def columns(w: WindowSpec) -> dict[str, Column]:
        added = {f"lag_{n}": F.lag(target, n).over(w) for n in lags}
        added |= {f"rolling_mean_{n}": F.avg(target).over(past(w, n)) for n in windows}
        return added

    return with_frames(df, groups, date, max([*lags, *windows]), columns, run_rows)
