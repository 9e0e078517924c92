"""Time the headline queries, and each stage by itself, and print one JSON line.

The metric's value is the sum of the headline queries, from raw tables; `stage_` entries start from
the stored table before them.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from shelfline.operators.features import feature_matrix  # noqa: E402
from shelfline.operators.inventory import inventory_policy  # noqa: E402
from shelfline.operators.mart import daily_sales_mart, prepare_transactions  # noqa: E402
from shelfline.operators.segments import abc_xyz_segments  # noqa: E402
from shelfline.plans.stages import baseline_forecast, dashboard_from_mart  # noqa: E402
from shelfline.session import hand_over, local_session  # noqa: E402
from shelfline.sources.fixtures import transactions  # noqa: E402

HEADLINE = [
    "run_all_data_checks",
    "mart_daily_sales",
    "feature_matrix",
    "baselines_all",
    "baseline_metrics",
    "abc_xyz_segments",
    "inventory_policy_table",
    "risk_table_by_source",
    "dashboard_dataset",
    "sales_overview",
    "assign_folds",
]


def spent(make) -> float:
    """Seconds to build a table and read it whole."""
    began = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def run(spark, folder: str, name: str) -> float:
    return spent(lambda: QUERIES[name](spark, folder))


def stage_seconds(spark, folder: str) -> dict[str, float]:
    """Every stage by itself, from the stored table of the stage before it."""
    facts = hand_over(prepare_transactions(transactions(spark, folder)), "facts")
    mart = hand_over(daily_sales_mart(facts), "mart")
    forecast = hand_over(baseline_forecast(mart, holdout_days=365), "forecast")
    stages = {
        "facts": lambda: prepare_transactions(transactions(spark, folder)),
        "mart": lambda: daily_sales_mart(facts),
        "features": lambda: feature_matrix(mart),
        "forecast": lambda: baseline_forecast(mart, holdout_days=365),
        "segments": lambda: abc_xyz_segments(mart),
        "policy": lambda: inventory_policy(forecast, require_rows=False),
        "dashboard": lambda: dashboard_from_mart(mart, forecast),
    }
    return {f"stage_{name}": round(spent(make), 3) for name, make in stages.items()}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores)
    run(spark, folder, "mart_daily_sales")  # start-up and code generation
    seconds = {name: round(run(spark, folder, name), 3) for name in names}
    stages = stage_seconds(spark, folder) if not sys.argv[1:] else {}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds | stages,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
