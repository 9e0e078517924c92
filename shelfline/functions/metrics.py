"""Forecast-quality metrics as aggregate Columns, usable under any groupBy.

Pairs with a missing side are left out of every sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["wmape", "mae", "rmse", "bias", "service_level_proxy", "stockout_risk_rate"]


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def _mean(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def _scale(actual: Column, forecast: Column) -> Column:
    return _total(F.when(forecast.isNotNull(), F.abs(actual)))


def mae(actual: Column, forecast: Column) -> Column:
    return _mean(F.abs(actual - forecast))


def rmse(actual: Column, forecast: Column) -> Column:
    error = actual - forecast
    return F.sqrt(_mean(error * error))


def wmape(actual: Column, forecast: Column) -> Column:
    """Sum of absolute errors over sum of absolute actuals; 0 or 1 without any demand."""
    errors, scale = _total(F.abs(actual - forecast)), _scale(actual, forecast)
    return F.when(scale != 0, F.try_divide(errors, scale)).otherwise(F.signum(errors))


def forecast_bias(actual: Column, forecast: Column) -> Column:
    """Positive when the forecast is too high; only the sign without any demand."""
    surplus, scale = _total(forecast - actual), _scale(actual, forecast)
    return F.when(scale != 0, F.try_divide(surplus, scale)).otherwise(F.signum(surplus))


def service_level_proxy(actual: Column, forecast: Column) -> Column:
    return _mean((forecast >= actual).cast("double"))


def stockout_risk_rate(actual: Column, forecast: Column, threshold: float = 0.0) -> Column:
    return _mean((actual - forecast > threshold).cast("double"))


def forecast_metrics(
    actual: Column, forecast: Column, threshold: float = 0.0
) -> dict[str, Column]:
    return {
        "wmape": wmape(actual, forecast),
        "mae": mae(actual, forecast),
        "rmse": rmse(actual, forecast),
        "bias": forecast_bias(actual, forecast),
        "service_level_proxy": service_level_proxy(actual, forecast),
        "stockout_risk_rate": stockout_risk_rate(actual, forecast, threshold),
    }


def evaluate(df: DataFrame, actual: str, forecast: str) -> DataFrame:
    """All six metrics as one row."""
    measured = forecast_metrics(F.col(actual), F.col(forecast))
    return df.agg(*(value.alias(name) for name, value in measured.items()))


def metrics_table(df: DataFrame, actual: str, forecast: str) -> DataFrame:
    """All six metrics as rows (metric, value)."""
    return evaluate(df, actual, forecast).unpivot([], METRICS, "metric", "value")


def error_sums(actual: Column, forecast: Column, threshold: float = 0.0) -> dict[str, Column]:
    """The sums behind all six metrics; those of parts add up to those of the whole."""
    error = actual - forecast
    return {
        "pairs": F.count(error),
        "absolute": _total(F.abs(error)),
        "square": _total(error * error),
        "surplus": _total(forecast - actual),
        "scale": _scale(actual, forecast),
        "served": F.count_if(forecast >= actual),
        "short": F.count_if(error > threshold),
    }


def metrics_of_sums() -> dict[str, Column]:
    """The six metrics from columns named as in `error_sums`."""
    pairs, scale = F.col("pairs"), F.col("scale")

    def mean(name: str) -> Column:
        return F.coalesce(F.try_divide(F.col(name).cast("double"), pairs), F.lit(0.0))

    def scaled(name: str) -> Column:
        value = F.col(name)
        return F.when(scale != 0, F.try_divide(value, scale)).otherwise(F.signum(value))

    return {
        "wmape": scaled("absolute"),
        "mae": mean("absolute"),
        "rmse": F.sqrt(mean("square")),
        "bias": scaled("surplus"),
        "service_level_proxy": mean("served"),
        "stockout_risk_rate": mean("short"),
    }
