"""Boosted-tree demand forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.columns import number
from shelfline.functions.metrics import evaluate
from shelfline.operators.baselines import best_baseline
from shelfline.operators.boosting import DEPTH, NODES, Forest, add_prediction, fit_forest, node_rows
from shelfline.operators.validation import train_holdout_split
from shelfline.schema import DATE, FORECAST, SERIES_KEYS, TARGET, require_columns
from shelfline.session import hand_over

# Same-day outcomes that a forecast must not see.
LEAKAGE_COLUMNS = [
    "description",
    "sales_qty",
    "revenue",
    "returns_qty",
    "invoices_cnt",
    "customers_cnt",
    "is_return_flag",
]

# The learner's settings; 31 leaves are 30 splits.
TREES = 200
LEARNING_RATE = 0.05
LEAVES = 31


@dataclass
class DemandModel:
    """A fitted forest, the features asked for and those that carried any value."""

    forest: Forest
    feature_columns: list[str]
    used_columns: list[str]


def feature_columns(df: DataFrame, target: str = TARGET, date_column: str = DATE) -> list[str]:
    """Numeric and boolean columns without keys, target and leakage."""
    blocked = {*LEAKAGE_COLUMNS, *SERIES_KEYS, DATE, TARGET, target, date_column}
    names = [
        f.name
        for f in df.schema.fields
        if f.name not in blocked and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    if not names:
        raise ValueError("no numeric feature column is left")
    return names


def prepare_train_test(
    df: DataFrame, target: str = TARGET, date_column: str = DATE, holdout_days: int = 28
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, holdout, features) by the latest dates; rows without target or date are left out.

    Features come from before the split, so the holdout is scored one step ahead.
    """
    require_columns(df, [target, date_column, *SERIES_KEYS], "model input")
    names = feature_columns(df, target, date_column)
    clean = df.withColumns(
        {date_column: F.col(date_column).try_cast("date"), target: number(df, target)}
    ).dropna(subset=[target, date_column])
    train, holdout = train_holdout_split(clean, date_column, holdout_days)
    return train, holdout, names


def _inputs(df: DataFrame, names: list[str]) -> list[Column]:
    """Features as doubles; NaN is missing like NULL."""
    return [F.nanvl(df[f"`{n}`"].cast("double"), F.lit(None)).alias(n) for n in names]


def train_model(
    train: DataFrame,
    names: list[str],
    target: str = TARGET,
    trees: int = TREES,
    learning_rate: float = LEARNING_RATE,
    leaves: int = LEAVES,
    depth: int = DEPTH,
) -> DemandModel:
    """Fit the trees, each by its best leaves; a missing feature goes to the side that it fits."""
    y = train[f"`{target}`"].cast("double").alias("_y")
    rows = hand_over(train.select(y, *_inputs(train, names)), "training")
    known = rows.agg(*(F.count(f"`{n}`").alias(n) for n in names)).first().asDict()
    if not any(known.values()):
        raise ValueError("no feature of the training rows has a value")
    used = [n for n in names if known[n]]
    forest = fit_forest(rows, used, "_y", trees, learning_rate, leaves, depth=depth)
    return DemandModel(forest, names, used)


def predict_non_negative(model: DemandModel, df: DataFrame) -> DataFrame:
    """Add the forecast, never below zero; no row is left out."""
    scored = add_prediction(df, model.forest, _inputs(df, model.used_columns), FORECAST)
    return scored.withColumn(FORECAST, F.greatest(F.col(FORECAST), F.lit(0.0)))


def compare_with_best_baseline(
    model_metrics: DataFrame, baselines: DataFrame | None = None, source: str = "model"
) -> DataFrame:
    """WMAPE of the model and, when given, of the best baseline."""
    row = model_metrics.select(
        F.lit(source).alias("source"), F.lit("wmape").alias("metric"), F.col("wmape").alias("value")
    )
    if baselines is None:
        return row
    named = "baseline" in baselines.columns
    table = baselines if named else baselines.withColumn("baseline", F.lit("best_baseline"))
    best = best_baseline(table).withColumnRenamed("baseline", "source")
    return row.unionByName(best)


def model_nodes(model: DemandModel, df: DataFrame) -> DataFrame:
    """The trees as a table, one row per node.  `df` only lends its session."""
    return df.sparkSession.createDataFrame(node_rows(model.forest), NODES)


def _per_feature(model: DemandModel, df: DataFrame, value: Column) -> DataFrame:
    names = df.sparkSession.createDataFrame([(n,) for n in model.feature_columns], "feature string")
    found = model_nodes(model, df).groupBy("feature").agg(value.alias("importance"))
    zero = F.lit(0).cast(found.schema["importance"].dataType)
    return (
        names.join(found, "feature", "left")
        .select("feature", F.coalesce("importance", zero).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def feature_importance(model: DemandModel, df: DataFrame) -> DataFrame:
    """Share of all splits' gains per feature, largest first; a feature without any value or split
    counts zero.  `df` only lends its session."""
    total = sum(sum(tree.gain) for tree in model.forest.trees)
    return _per_feature(model, df, F.sum("gain") / (total or 1.0))


def split_counts(model: DemandModel, df: DataFrame) -> DataFrame:
    """Number of splits per feature over all trees."""
    return _per_feature(model, df, F.count(F.lit(1)))


def run_modeling(
    features: DataFrame,
    baselines: DataFrame | None = None,
    holdout_days: int = 28,
    trees: int = TREES,
) -> dict[str, object]:
    """Split, fit, forecast, score and compare; every part is returned under its name."""
    train, holdout, names = prepare_train_test(
        hand_over(features, "features"), holdout_days=holdout_days
    )
    model = train_model(train, names, trees=trees)
    if holdout.isEmpty():
        raise ValueError("the holdout has no rows")
    forecast = predict_non_negative(model, holdout)
    forecast = hand_over(forecast, "forecast")
    metrics = evaluate(forecast, TARGET, FORECAST)
    return {
        "model": model,
        "train": train,
        "test": holdout,
        "feature_columns": names,
        "forecast": forecast,
        "metrics": metrics,
        "comparison": compare_with_best_baseline(metrics, baselines),
        "feature_importance": feature_importance(model, features),
    }
