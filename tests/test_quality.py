from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shelfline.operators import quality as Q

SCHEMA = (
    "invoice string, stock_code string, description string, quantity string, "
    "invoice_date string, unit_price string, customer_id string, country string"
)
GOOD = [
    ("77120", "L-14", "oak lamp", "6", "2023-05-04 16:45:30", "7.25", "904", "Norway"),
    ("77121", "D-02", "side desk", "1", "2023-05-06 08:05:00", "149.0", "377", "Chile"),
]


def frame(spark, data=None):
    return spark.createDataFrame(data or GOOD, SCHEMA)


def changed(**columns):
    """GOOD with per-row values for the given columns."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return [
        tuple(columns[n][i] if n in columns else v for n, v in zip(names, row))
        for i, row in enumerate(GOOD)
    ]


def only(report):
    return report.first().asDict()


def test_clean_rows_pass(spark):
    report = Q.run_all_data_checks(frame(spark)).collect()
    assert [r["check"] for r in report] == [
        "required_columns", "negative_or_zero_prices", "duplicate_transaction_rows",
        "missing_invoice_date", "missing_stock_code", "missing_prices_share", "returns_share",
    ]
    assert all(r["passed"] for r in report)


def test_required_columns(spark):
    got = only(Q.check_required_columns(frame(spark).drop("country", "invoice")))
    assert not got["passed"] and got["metric"]["missing_columns"] == 2
    assert "country, invoice" in got["message"]


def test_prices(spark):
    got = only(Q.check_negative_prices(frame(spark, changed(unit_price=["0", "-1"]))))
    assert not got["passed"] and got["metric"]["invalid_price_rows"] == 2
    junk = frame(spark, changed(unit_price=["abc", "12d"]))
    assert only(Q.check_negative_prices(junk))["passed"]
    assert only(Q.check_negative_prices(junk))["metric"]["missing_price_rows"] == 2
    got = only(Q.check_missing_prices_share(frame(spark, changed(unit_price=[None, "3"]))))
    assert not got["passed"]
    assert got["metric"] == {"missing_prices_count": 1.0, "missing_prices_share": 0.5}


def test_duplicates(spark):
    got = only(Q.check_duplicate_rows(frame(spark, [*GOOD, GOOD[0]])))
    assert got["metric"] == {"duplicates_count": 1.0, "duplicates_share": 0.333333}
    nulls = [tuple([None] * 8)] * 3
    assert only(Q.check_duplicate_rows(frame(spark, nulls)))["metric"]["duplicates_count"] == 2


def test_dates(spark):
    got = only(Q.check_missing_invoice_date(frame(spark, changed(invoice_date=[None, "not a date"]))))
    assert got["metric"]["missing_invoice_date_count"] == 2
    assert only(Q.check_missing_invoice_date(frame(spark, changed(invoice_date=["12/1/2010 8:26", "2011-01-02"]))))["passed"]


@pytest.mark.parametrize("blank", ["", " \t", None])
def test_stock_code(spark, blank):
    got = only(Q.check_missing_stock_code(frame(spark, changed(stock_code=[blank, "B"]))))
    assert got["metric"]["missing_stock_code_count"] == 1
    absent = only(Q.check_missing_stock_code(frame(spark).drop("stock_code")))
    assert absent["metric"]["missing_stock_code_share"] == 1.0


def test_returns(spark):
    got = only(Q.check_returns_share(frame(spark, changed(invoice=["C10001", None], quantity=["2", "-3"]))))
    assert got["passed"] and got["metric"]["returns_count"] == 2


def test_single_checks_agree_with_report(spark):
    df = frame(spark, [*changed(unit_price=["-1", None], stock_code=["", "B"]), GOOD[0], GOOD[0]])
    report = {r["check"]: r.asDict() for r in Q.run_all_data_checks(df).collect()}
    for check in (
        Q.check_required_columns, Q.check_negative_prices, Q.check_duplicate_rows,
        Q.check_missing_invoice_date, Q.check_missing_stock_code, Q.check_missing_prices_share,
        Q.check_returns_share,
    ):
        got = only(check(df))
        assert got == report[got["check"]]


def test_empty_input(spark):
    report = Q.run_all_data_checks(frame(spark).where("1 = 0")).collect()
    assert len(report) == 7 and report[2]["metric"]["duplicates_share"] == 0.0


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicates_shuffle_signatures_alone(spark, tmp_path, monkeypatch):
    """Rows cross the network as two hashes and a count; whole rows only where those repeat."""
    frame(spark, [*GOOD, GOOD[0]]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    seen = []
    monkeypatch.setattr(Q, "hand_over", lambda d, stem: seen.append(executed(d)) or d)
    report = Q.run_all_data_checks(df)
    exchange = re.search(r"Exchange hashpartitioning\((.*?)\), ENSURE", seen[0]).group(1)
    assert re.sub(r"#\d+L?", "", exchange) == "_signature_1, _signature_2, 4"
    assert report.where("check = 'duplicate_transaction_rows'").first()["metric"]["duplicates_count"] == 1
    # Beside the repeated rows, every exchange is of sums or signatures.
    assert "BroadcastHashJoin" in executed(Q.repeated_rows(df))


def test_equal_signatures_of_unlike_rows(spark, monkeypatch):
    data = [*GOOD, GOOD[0], (None,) * 8, (None,) * 8, (None,) * 7 + ("x",), ("x",) + (None,) * 7]
    expected = only(Q.check_duplicate_rows(frame(spark, data)))
    assert expected["metric"]["duplicates_count"] == 2
    constant = [F.lit(1).cast("bigint").alias(n) for n in Q.SIGNATURE]
    for limit in (0, 10):
        monkeypatch.setattr(Q, "BROADCAST_SIGNATURES", limit)
        assert only(Q.check_duplicate_rows(frame(spark, data))) == expected
        with monkeypatch.context() as patch:
            patch.setattr(Q, "row_signature", lambda df: constant)
            assert only(Q.check_duplicate_rows(frame(spark, data))) == expected


def test_signatures_take_equal_numbers_as_equal(spark):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 1), (float("nan"), 2), (float("nan"), 2)], "x double, y int")
    assert sorted(r["_rows"] for r in Q.repeated_rows(df).collect()) == [2, 2]


def test_summary(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, None)], "x double, y string")
    got = {r["column"]: r.asDict() for r in Q.data_quality_summary(df).collect()}
    assert got["x"] == {"column": "x", "dtype": "double", "missing_count": 2,
                        "missing_share": 0.666667, "unique_count": 1}
    assert got["y"]["unique_count"] == 1
    assert Q.data_quality_summary(df, approx=True).agg(F.sum("unique_count")).first()[0] == 2
    assert "Expand" not in executed(Q.data_quality_summary(df))


def test_daily_sketches_merge_to_the_summary(spark):
    df = spark.range(40_000).selectExpr(
        "id % 30 AS day", "id % 9000 AS a", "IF(id % 4 = 0, NULL, CAST(id AS STRING)) AS b", "CAST(NULL AS INT) AS c"
    )
    sketches = Q.column_sketches(df, [F.col("day").alias("of")])
    assert sketches.count() == 30 and "Expand" not in executed(sketches)
    exact = {r["column"]: r.asDict() for r in Q.data_quality_summary(df).collect()}
    got = {r["column"]: r.asDict() for r in Q.summary_of_sketches(sketches, df.schema).collect()}
    for name, row in exact.items():
        assert got[name]["unique_count"] == pytest.approx(row.pop("unique_count"), rel=0.05)
        assert row.items() <= got[name].items()
    few = Q.summary_of_sketches(sketches.where("of < 3"), df.schema).where("column = 'day'").first()
    assert few["unique_count"] == 3
    assert Q.summary_of_sketches(sketches.where("of > 99"), df.schema).count() == 4


def test_summary_queries_take_the_joins_once(spark, tmp_path):
    """A column's scan reads stored rows: the joins behind the raw rows are no part of its plan."""
    from checks.queries import QUERIES

    tables = {
        "lineitem": "(1L, 1L, 'R', 2.0D, 9.0D, DATE'1995-03-01'), (1L, 2L, 'N', 1.0D, 5.0D, DATE'1995-03-02') "
        "AS t(l_orderkey, l_partkey, l_returnflag, l_quantity, l_extendedprice, l_shipdate)",
        "orders": "(1L, 7L) AS t(o_orderkey, o_custkey)",
        "customer": "(7L, 3) AS t(c_custkey, c_nationkey)",
        "nation": "(3, 'PERU') AS t(n_nationkey, n_name)",
        "part": "(1L, 'Brand#1', 'STEEL'), (2L, 'Brand#2', 'TIN') AS t(p_partkey, p_brand, p_type)",
    }
    for name, values in tables.items():
        spark.sql(f"SELECT * FROM VALUES {values}").write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("data_quality_summary", "data_quality_sketches"):
        rows = QUERIES[name](spark, str(tmp_path))
        assert rows.count() == 8
        assert "l_orderkey" not in executed(rows)
