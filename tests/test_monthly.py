"""Tables stored by month: pruned reads, and a mart refreshed month by month."""

from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfline.operators import dashboard as D
from shelfline.operators import mart as M
from shelfline.operators import validation as V
from shelfline.schema import FACT_SCHEMA, MONTH
from shelfline.sources import monthly as S
from tests.conftest import rows


def facts(spark, count, seed, days=(0, 200)):
    pick = random.Random(seed)
    raw = []
    for _ in range(count):
        at = datetime(2024, 1, 1, 9) + timedelta(days=pick.randrange(*days)) if pick.random() > 0.02 else None
        raw.append((str(pick.randrange(40)), f"S{pick.randrange(4)}", pick.choice(["a", "b", None]),
                    float(pick.randrange(-2, 9)), at, pick.choice([None, 1.5, 2.0]), pick.choice(["x", "y", None]), "UK"))
    df = spark.createDataFrame(
        raw, "invoice string, stock_code string, description string, quantity double, invoice_date timestamp, "
        "unit_price double, customer_id string, country string"
    )
    return M.prepare_transactions(df).select(*FACT_SCHEMA.fieldNames())


def files_read(df) -> int:
    """Files that the scans of an executed plan have opened."""
    df._jdf.collectToPython()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
    return total


def test_refresh_equals_a_rebuild(spark, tmp_path):
    paths = str(tmp_path / "facts"), str(tmp_path / "mart")
    base = facts(spark, 400, 1)
    before = S.write_months(M.daily_sales_mart(S.write_months(base, paths[0])), paths[1])
    assert before.count() > 100
    written = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "mart").iterdir()}
    changes = facts(spark, 30, 2, (40, 70)).unionByName(facts(spark, 20, 3, (230, 260)))
    after = S.refresh_mart(spark, *paths, changes).drop(MONTH)
    expected = M.daily_sales_mart(base.unionByName(changes))
    assert sorted(map(str, rows(after))) == sorted(map(str, rows(expected)))
    # Months without a change were not written.
    now = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "mart").iterdir()}
    same = {name for name, at in written.items() if now[name] == at and MONTH in name}
    assert {f"{MONTH}=2024-0{n}-01" for n in (1, 4, 5, 6, 7)} <= same
    assert {f"{MONTH}=2024-02-01", f"{MONTH}=2024-03-01"}.isdisjoint(same)


def test_refresh_reads_changed_months_only(spark, tmp_path):
    stored = S.write_months(facts(spark, 400, 4), str(tmp_path / "facts"))
    months = S.changed_months(facts(spark, 10, 5, (40, 45)))
    assert months == [date(2024, 2, 1)]
    touched = M.daily_sums(stored.where(F.col(MONTH).isin(months)))
    assert files_read(touched) == len(list((tmp_path / "facts" / f"{MONTH}=2024-02-01").glob("*.parquet")))


def test_nothing_to_refresh(spark, tmp_path):
    paths = str(tmp_path / "facts"), str(tmp_path / "mart")
    base = facts(spark, 50, 6)
    mart = S.write_months(M.daily_sales_mart(S.write_months(base, paths[0])), paths[1])
    count = mart.count()
    assert S.refresh_mart(spark, *paths, base.limit(0)).count() == count
    with pytest.raises(ValueError, match="mode"):
        S.write_months(base, paths[0], mode="merge")


def test_cutoffs_prune_folders_at_run_time(spark, tmp_path):
    mart = M.daily_sums(facts(spark, 900, 7))
    stored = S.write_months(mart, str(tmp_path / "mart"))
    folders = {f.name: len(list(f.glob("*.parquet"))) for f in (tmp_path / "mart").glob(f"{MONTH}=*")}
    train, holdout = V.train_holdout_split(stored, holdout_days=20)
    plan = holdout._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*sales_month#\d+ >= trunc\(Subquery", plan)
    days = [r[0] for r in mart.select("sales_date").distinct().orderBy(F.desc("sales_date")).limit(20).collect()]
    wanted = {f"{MONTH}={d:%Y-%m}-01" for d in days}
    assert files_read(holdout) == sum(folders[name] for name in wanted) < sum(folders.values())
    plain = V.train_holdout_split(mart, holdout_days=20)
    for got, expected in zip((train, holdout), plain):
        assert sorted(map(str, rows(got.drop(MONTH)))) == sorted(map(str, rows(expected)))


def test_folds_and_filters_prune_folders(spark, tmp_path):
    stored = S.write_months(M.daily_sums(facts(spark, 900, 8)), str(tmp_path / "mart"))
    fold = {"train_start": date(2024, 1, 5), "train_end": date(2024, 2, 9),
            "valid_start": date(2024, 2, 10), "valid_end": date(2024, 2, 20)}
    train, valid = V.split_by_fold(stored, fold)
    plain = V.split_by_fold(stored.drop(MONTH), fold)
    assert [train.count(), valid.count()] == [df.count() for df in plain]
    assert valid.select(MONTH).distinct().count() == 1
    february = len(list((tmp_path / "mart" / f"{MONTH}=2024-02-01").glob("*.parquet")))
    assert files_read(valid) == files_read(D.filter_dashboard(stored, (date(2024, 2, 1), date(2024, 2, 3)))) == february
