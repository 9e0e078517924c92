"""Scenario stock formulas as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAD_TIME_DAYS = 7
Z_SCORE = 1.65

# Z-score per service level.
SERVICE_LEVEL_Z = {0.90: 1.28, 0.95: 1.65, 0.98: 2.05}


def _as_column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _not_negative(name: str, value: Column | float) -> Column:
    """Plain numbers are checked at once, columns when the row is computed."""
    if not isinstance(value, Column):
        if value < 0:
            raise ValueError(f"{name} must not be negative")
        return F.lit(value)
    return F.when(value < 0, F.raise_error(F.lit(f"{name} must not be negative"))).otherwise(value)


def safety_stock(
    demand_std: Column, lead_time_days: Column | int = LEAD_TIME_DAYS, z_score: Column | float = Z_SCORE
) -> Column:
    z = _not_negative("z_score", z_score)
    lead = _not_negative("lead_time_days", lead_time_days)
    return z * _not_negative("demand_std", demand_std) * F.sqrt(lead)


def reorder_point(
    avg_daily_demand: Column,
    lead_time_days: Column | int = LEAD_TIME_DAYS,
    safety: Column | float = 0.0,
) -> Column:
    lead = _not_negative("lead_time_days", lead_time_days)
    demand = _not_negative("avg_daily_demand", avg_daily_demand)
    return demand * lead + _not_negative("safety_stock", safety)


def demand(quantity: Column) -> Column:
    """Quantity clipped at zero; stays NULL when missing."""
    return F.when(quantity < 0, 0.0).otherwise(quantity)


def stockout_risk(actual: Column, forecast: Column, available: Column) -> Column:
    """Demand above the assumed stock or above the forecast."""
    stock = _not_negative("available_stock_assumption", available)
    return (demand(actual) > stock) | (demand(actual) > demand(forecast))


def excess_stock(forecast: Column, actual: Column) -> Column:
    return demand(forecast) > demand(actual)


def service_level_z(service_level: Column | float) -> Column:
    """z-score of a known service level, 1.65 for any other."""
    level = _as_column(service_level)
    z = F.lit(Z_SCORE)
    for known, score in SERVICE_LEVEL_Z.items():
        z = F.when(level == known, score).otherwise(z)
    return z


def safety_stock_at(
    demand_std: Column, lead_time_days: Column | int, service_level: Column | float = 0.95
) -> Column:
    return safety_stock(demand_std, lead_time_days, service_level_z(service_level))


def reorder_point_at(
    avg_daily_demand: Column,
    demand_std: Column,
    lead_time_days: Column | int,
    service_level: Column | float = 0.95,
) -> Column:
    safety = safety_stock_at(demand_std, lead_time_days, service_level)
    return reorder_point(avg_daily_demand, lead_time_days, safety)
