"""ABC segments by revenue share and XYZ segments by demand variability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.operators.ordered import running_total
from shelfline.schema import SERIES_KEYS, TARGET, require_columns

# Upper bounds of the preceding revenue share (percent) and of the variation.
A_PERCENT, B_PERCENT = 80, 95
X_VARIATION, Y_VARIATION = 0.5, 1.0

EXACT = "decimal(38,6)"


def segment_stats(df: DataFrame) -> DataFrame:
    """Revenue and demand statistics per product and market."""
    require_columns(df, [*SERIES_KEYS, TARGET, "revenue"], "segmentation input")
    known = df.dropna(subset=SERIES_KEYS)
    return known.groupBy(*SERIES_KEYS).agg(
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum(TARGET), F.lit(0.0)).alias("total_net_sales_qty"),
        F.avg(TARGET).alias("mean_net_sales_qty"),
        F.coalesce(F.stddev_samp(TARGET), F.lit(0.0)).alias("std_net_sales_qty"),
        F.count(TARGET).alias("active_days"),
    )


def add_abc_segment(
    df: DataFrame, value: str = "revenue", keys: list[str] = SERIES_KEYS, blocks: int | None = None
) -> DataFrame:
    """A until 80 % of the value lies before the row, B until 95 %, else C.

    The running sum is exact (decimal), so summation order cannot move a row over an edge.
    """
    exact = F.coalesce(F.col(value).cast(EXACT), F.lit(0).cast(EXACT))
    order = [F.desc("_exact"), *(F.col(key) for key in keys)]
    ranked = running_total(
        df.withColumn("_exact", exact), F.col("_exact"), order, "_running", blocks, "_total"
    )
    split = ranked.withColumn("_before", F.col("_running") - F.col("_exact"))
    earning = F.col("_total") > 0

    def below(percent: int):
        return F.col("_before") * 100 < F.col("_total") * percent

    whole = F.col("_total").cast("double")
    return split.withColumns(
        {
            "value_share": F.when(earning, F.col(value) / whole).otherwise(0.0),
            "cumulative_share": F.when(earning, F.col("_running").cast("double") / whole).otherwise(0.0),
            "abc_segment": F.when(~earning, "C")
            .when(below(A_PERCENT), "A")
            .when(below(B_PERCENT), "B")
            .otherwise("C"),
        }
    ).drop("_exact", "_running", "_total", "_before")


def add_xyz_segment(
    df: DataFrame, mean: str = "mean_net_sales_qty", std: str = "std_net_sales_qty"
) -> DataFrame:
    """X up to a variation of 0.5, Y up to 1.0, else Z; Z without a mean."""
    variation = F.col("coefficient_of_variation")
    return df.withColumn(
        "coefficient_of_variation", F.try_divide(F.col(std), F.col(mean))
    ).withColumn(
        "xyz_segment",
        F.when(variation <= X_VARIATION, "X").when(variation <= Y_VARIATION, "Y").otherwise("Z"),
    )


def abc_xyz_segments(df: DataFrame, blocks: int | None = None) -> DataFrame:
    """Segments per product and market, best segment and largest revenue first."""
    segmented = add_xyz_segment(add_abc_segment(segment_stats(df), blocks=blocks))
    return segmented.withColumn(
        "abc_xyz_segment", F.concat("abc_segment", "xyz_segment")
    ).orderBy("abc_segment", "xyz_segment", F.desc("revenue"), *SERIES_KEYS)


def abc_xyz_from_sales(df: DataFrame) -> DataFrame:
    """Segments from frames that call the quantity `sales` and the market `country`."""
    for wanted, other in ((TARGET, "sales"), ("market_id", "country")):
        if wanted not in df.columns and other in df.columns:
            df = df.withColumn(wanted, F.col(other))
    return abc_xyz_segments(df)
