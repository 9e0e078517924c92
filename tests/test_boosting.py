"""Leaf-wise trees against a plain learner, and their node table against their forecasts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.operators import boosting as BO
from shelfline.operators import model as L
from shelfline.session import hand_over


def plain_forest(rows, names, edges, trees, rate, leaves, least):
    """Best-first trees by trying every cut of every leaf; returns each row's sum."""
    y = np.array([r[-1] for r in rows], float)
    bins = [
        [0 if v is None else 1 + sum(e < v for e in edges[i]) for i, v in enumerate(r[:-1])] for r in rows
    ]
    score, splits = np.full(len(rows), y.mean()), []

    def best(members, pull):
        whole, found = sum(pull[m] for m in members), None
        for f in range(len(names)):
            for with_left in (False, True):
                for cut in range(1, 256):
                    left = [m for m in members if (bins[m][f] and bins[m][f] <= cut) or (not bins[m][f] and with_left)]
                    if cut > max(bins[m][f] for m in members):
                        break
                    right = len(members) - len(left)
                    if len(left) < least or right < least:
                        continue
                    a = sum(pull[m] for m in left)
                    gain = a**2 / len(left) + (whole - a) ** 2 / right - whole**2 / len(members)
                    if gain > 1e-9 and (found is None or gain > found[0] * (1 + 1e-9)):
                        found = gain, f, cut, set(left)
        return found

    for _ in range(trees):
        pull = y - score
        open_leaves, count = [list(range(len(rows)))], 0
        gains = [best(open_leaves[0], pull)]
        while len(open_leaves) < leaves and any(gains):
            at = max((i for i, g in enumerate(gains) if g), key=lambda i: gains[i][0])
            members, split = open_leaves.pop(at), gains.pop(at)
            sides = [m for m in members if m in split[3]], [m for m in members if m not in split[3]]
            open_leaves += sides
            gains += [best(side, pull) for side in sides]
            count += 1
        for members in open_leaves:
            score[members] += rate * np.mean([pull[m] for m in members])
        splits.append(count)
    return score, splits


@pytest.fixture(scope="module")
def table(spark):
    pick = random.Random(7)
    rows = []
    for _ in range(500):
        a, b, c = pick.gauss(0, 1), pick.choice([None, *range(6)]), pick.uniform(0, 9)
        target = 3 * a + (5 if b is None else b) + (4 if c > 6 and a > 0 else 0) + pick.gauss(0, 0.3)
        rows.append((a if pick.random() > 0.1 else None, None if b is None else float(b), c, target))
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    return rows, hand_over(df.repartition(3), "boosting")


def test_equals_a_plain_learner(spark, table):
    rows, df = table
    names = ["a", "b", "c"]
    forest = BO.fit_forest(df, names, "y", trees=3, rate=0.3, leaves=9, least_rows=15, depth=99, bins=20)
    expected, splits = plain_forest(rows, names, forest.edges, 3, 0.3, 9, 15)
    assert [t.splits for t in forest.trees] == splits == [8, 8, 8]
    got = {tuple(r[:4]): r["p"] for r in BO.add_prediction(df, forest, [F.col(n) for n in names], "p").collect()}
    for row, value in zip(rows, expected):
        assert got[row] == pytest.approx(value, rel=1e-9)


def test_stored_gradients_and_reduction_change_nothing(spark, table, monkeypatch):
    _, df = table
    fit = lambda: BO.node_rows(BO.fit_forest(df, ["a", "b", "c"], "y", 5, 0.1, 6))
    one = fit()
    monkeypatch.setattr(BO, "STORE_EVERY", 2)
    monkeypatch.setattr(BO, "DIRECT_PARTS", 0)
    monkeypatch.setattr(BO, "BLOCK_ROWS", 64)
    assert [r[:7] for r in fit()] == [r[:7] for r in one]


def test_thirty_splits_and_bounded_depth(spark):
    df = hand_over(spark.range(3000).selectExpr("rand(1) AS a", "rand(2) AS b", "rand(3) AS y"), "wide")
    forest = BO.fit_forest(df, ["a", "b"], "y", 2, 0.05, 31)
    assert [t.splits for t in forest.trees] == [30, 30]
    shallow = BO.fit_forest(df, ["a", "b"], "y", 1, 0.05, 31, depth=2)
    assert shallow.trees[0].splits == 3


def test_node_table_gives_the_forecast(spark, table):
    """The forecast again, by walking the node table with joins."""
    _, df = table
    named = df.withColumn("id", F.monotonically_increasing_id()).cache()
    model = L.train_model(named, ["a", "b", "c"], "y", trees=3, learning_rate=0.2, leaves=7)
    nodes = L.model_nodes(model, df).cache()
    long = named.unpivot(["id"], ["a", "b", "c"], "feature", "v")
    at = named.select("id").crossJoin(nodes.where("node = 0").select("tree", "node"))
    total = None
    for _ in range(9):
        here = at.join(nodes, ["tree", "node"])
        leaves = here.where("left IS NULL").select("id", "tree", "value")
        total = leaves if total is None else total.union(leaves)
        goes = F.when(F.col("v").isNull(), F.col("missing_left")).otherwise(
            F.coalesce(F.col("v") <= F.col("edge"), F.lit(True))
        )
        at = here.join(long, ["id", "feature"]).select(
            "id", "tree", F.when(goes, F.col("left")).otherwise(F.col("right")).alias("node")
        )
    walked = total.groupBy("id").agg((F.sum("value") + model.forest.start).alias("w"))
    both = L.predict_non_negative(model, named).join(walked, "id")
    assert both.count() == 500
    off = F.abs(F.greatest("w", F.lit(0.0)) - F.col("forecast_net_sales_qty"))
    assert both.agg(F.max(off)).first()[0] < 1e-9


def test_constant_and_missing_inputs(spark):
    df = spark.createDataFrame([(1.0, None, 2.0)] * 50, "a double, b double, y double")
    model = L.train_model(df, ["a", "b"], "y", trees=2)
    assert model.used_columns == ["a"] and [t.splits for t in model.forest.trees] == [0, 0]
    assert L.predict_non_negative(model, df).select("forecast_net_sales_qty").distinct().first()[0] == 2.0
    with pytest.raises(ValueError, match="no feature"):
        L.train_model(df, ["b"], "y", trees=1)


def test_the_driver_gets_a_few_numbers_per_leaf(spark, table, monkeypatch):
    """Whatever the number of tasks, no histogram reaches the driver."""
    import pickle

    from pyspark import RDD

    _, df = table
    got, collect = [], RDD.collect
    monkeypatch.setattr(BO, "LOCAL_ROWS", 0, raising=False)

    def counted(rdd):
        found = collect(rdd)
        got.append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", counted)
    sizes = []
    for parts in (4, 9):
        got.clear()
        spread = hand_over(df.repartition(parts), "spread")
        monkeypatch.setattr(BO, "store_binned", _in_parts(BO.store_binned, parts))
        BO.fit_forest(spread, ["a", "b", "c"], "y", 1, 0.1, 6)
        monkeypatch.undo()
        monkeypatch.setattr(BO, "LOCAL_ROWS", 0, raising=False)
        monkeypatch.setattr(RDD, "collect", counted)
        sizes.append(max(got))
    assert max(sizes) < 8_000


def _in_parts(store, parts):
    return lambda *args: store(*args).repartition(parts)


def test_subtrees_grown_by_one_task_are_the_same(spark, table, monkeypatch):
    _, df = table
    fit = lambda: BO.node_rows(BO.fit_forest(df, ["a", "b", "c"], "y", 4, 0.2, 12, depth=5))
    monkeypatch.setattr(BO, "LOCAL_ROWS", 0)
    rounds = fit()
    for least in (100, 300, 1000):
        monkeypatch.setattr(BO, "LOCAL_ROWS", least)
        local = fit()
        assert [r[:7] for r in local] == [r[:7] for r in rounds]
        values = [[r[7] or 0.0 for r in found] for found in (local, rounds)]
        assert values[0] == pytest.approx(values[1], rel=1e-9)
