"""Quality checks on normalised transactions.

A report row is (check, passed, metric, message) with the counts in a map.  Duplicates are counted
in two steps: rows are shuffled as 128-bit signatures first, and only rows whose signature repeats
are read again and grouped by all columns, so equal signatures of unlike rows do no harm.  All
other checks are sums that each task makes of its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.columns import column_or_null, moment, number, share
from shelfline.schema import TRANSACTION_COLUMNS, missing_columns
from shelfline.session import hand_over

BLANKS = " \t\n\r\f\v"
SIGNATURE = ["_signature_1", "_signature_2"]
BROADCAST_SIGNATURES = 1_000_000  # repeated ones, of 16 bytes each
SKETCH_BITS = 12  # of a distinct-count sketch: a standard error of 1.6 %


def _counts(df: DataFrame) -> dict[str, Column]:
    """Row counts behind the checks, but for the copies."""
    price = number(df, "unit_price")
    code = column_or_null(df, "stock_code").cast("string")
    invoice = F.coalesce(column_or_null(df, "invoice").cast("string"), F.lit(""))
    returned = invoice.startswith("C") | F.coalesce(number(df, "quantity") < 0, F.lit(False))
    return {
        "total": F.count(F.lit(1)),
        "price_invalid": F.count_if(price <= 0),
        "price_missing": F.count_if(price.isNull()),
        "date_missing": F.count_if(moment(df, "invoice_date").isNull()),
        "code_missing": F.count_if(code.isNull() | (F.trim(code, F.lit(BLANKS)) == "")),
        "returned": F.count_if(returned),
    }


def row_signature(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns: equal rows, with missing as a value, have equal ones."""
    parts = []
    for field in df.schema.fields:
        column = df[f"`{field.name}`"]
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = column + F.lit(0.0)  # the two zeros are equal
        parts += [column, column.isNull()]
    return [F.xxhash64(F.lit(seed), *parts).alias(n) for seed, n in enumerate(SIGNATURE)]


def repeated_rows(df: DataFrame) -> DataFrame:
    """Every distinct row that occurs more than once, with its number of rows as `_rows`."""
    signed = df.select("*", *row_signature(df))
    counted = signed.groupBy(*SIGNATURE).agg(F.count(F.lit(1)).alias("_rows"))
    repeated = hand_over(counted.where("_rows > 1").select(*SIGNATURE), "repeated")
    few = repeated.count() <= BROADCAST_SIGNATURES
    suspects = signed.join(F.broadcast(repeated) if few else repeated, SIGNATURE, "left_semi")
    groups = suspects.groupBy(*(f"`{c}`" for c in df.columns)).agg(F.count(F.lit(1)).alias("_rows"))
    return groups.where("_rows > 1")


def _row(
    check: str, metric: dict[str, Column], passed: Column, good: str, bad: str
) -> Column:
    entries = [part for name, value in metric.items() for part in (F.lit(name), value.cast("double"))]
    return F.struct(
        F.lit(check).alias("check"),
        passed.alias("passed"),
        F.create_map(*entries).alias("metric"),
        F.when(passed, good).otherwise(bad).alias("message"),
    )


def _count_and_share(stem: str, count: str) -> dict[str, Column]:
    value = F.col(count)
    return {f"{stem}_count": value, f"{stem}_share": share(value, F.col("total"))}


def _required_row(df: DataFrame) -> Column:
    missing = missing_columns(df, TRANSACTION_COLUMNS)
    return _row(
        "required_columns",
        {"rows": F.col("total"), "missing_columns": F.lit(len(missing))},
        F.lit(not missing),
        "all required columns are present",
        "missing columns: " + ", ".join(missing),
    )


def _rows() -> dict[str, Column]:
    """Report rows over one row of counts, in report order."""
    def none(count: str) -> Column:
        return F.col(count) == 0

    return {
        "negative_or_zero_prices": _row(
            "negative_or_zero_prices",
            {
                "invalid_price_rows": F.col("price_invalid"),
                "missing_price_rows": F.col("price_missing"),
            },
            none("price_invalid"),
            "every known price is positive",
            "zero or negative prices occur",
        ),
        "duplicate_transaction_rows": _row(
            "duplicate_transaction_rows",
            _count_and_share("duplicates", "copies"),
            none("copies"),
            "no row occurs twice",
            "rows repeat others in full",
        ),
        "missing_invoice_date": _row(
            "missing_invoice_date",
            _count_and_share("missing_invoice_date", "date_missing"),
            none("date_missing"),
            "every row has a readable invoice date",
            "some rows lack a readable invoice date",
        ),
        "missing_stock_code": _row(
            "missing_stock_code",
            _count_and_share("missing_stock_code", "code_missing"),
            none("code_missing"),
            "every row has a stock code",
            "some rows lack a stock code",
        ),
        "missing_prices_share": _row(
            "missing_prices_share",
            _count_and_share("missing_prices", "price_missing"),
            none("price_missing"),
            "every row has a price",
            "some rows lack a price, which distorts revenue and mean price",
        ),
        "returns_share": _row(
            "returns_share",
            _count_and_share("returns", "returned"),
            F.lit(True),
            "returns are counted, their rows are kept",
            "",
        ),
    }


def _single_counts(df: DataFrame) -> DataFrame:
    return df.agg(*(c.alias(n) for n, c in _counts(df).items()))


def _all_counts(df: DataFrame) -> DataFrame:
    copies = repeated_rows(df).agg(F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("copies"))
    return _single_counts(df).withColumn("copies", copies.scalar())


def _single(df: DataFrame, check: str) -> DataFrame:
    duplicates = check == "duplicate_transaction_rows"
    counts = _all_counts(df) if duplicates else _single_counts(df)
    return counts.select(F.inline(F.array(_rows()[check])))


def check_required_columns(df: DataFrame) -> DataFrame:
    return _single_counts(df).select(F.inline(F.array(_required_row(df))))


def check_negative_prices(df: DataFrame) -> DataFrame:
    """Prices at or below zero; missing ones are counted but do not fail the check."""
    return _single(df, "negative_or_zero_prices")


def check_duplicate_rows(df: DataFrame) -> DataFrame:
    """Copies beyond the first over all columns, missing values being equal."""
    return _single(df, "duplicate_transaction_rows")


def check_missing_invoice_date(df: DataFrame) -> DataFrame:
    return _single(df, "missing_invoice_date")


def check_missing_stock_code(df: DataFrame) -> DataFrame:
    return _single(df, "missing_stock_code")


def check_missing_prices_share(df: DataFrame) -> DataFrame:
    return _single(df, "missing_prices_share")


def check_returns_share(df: DataFrame) -> DataFrame:
    """Cancelled invoices and negative quantities; this check always passes."""
    return _single(df, "returns_share")


def run_all_data_checks(df: DataFrame) -> DataFrame:
    """All seven checks in fixed order."""
    return _all_counts(df).select(F.inline(F.array(_required_row(df), *_rows().values())))


def long_report(report: DataFrame) -> DataFrame:
    """One row per check and metric."""
    return report.select(
        "check", "passed", F.explode("metric").alias("metric_name", "metric_value"), "message"
    )


def _known(df: DataFrame, field: T.StructField) -> Column:
    """The column, NaN being missing."""
    column = df[f"`{field.name}`"]
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def _summary_rows(wide: DataFrame, fields: list[T.StructField]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"missing_{i}").alias("missing_count"),
            share(F.col(f"missing_{i}"), F.col("total")).alias("missing_share"),
            F.col(f"unique_{i}").alias("unique_count"),
        )
        for i, f in enumerate(fields)
    ]
    return wide.select(F.inline(F.array(*rows)))


def data_quality_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, missing count and share, and number of known values per column.

    Each column's values are grouped by themselves, from a scan of that column alone; with `approx`
    one scan makes a sketch per column.
    """
    fields = df.schema.fields
    wide = df.agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(_known(df, f).isNull()).alias(f"missing_{i}") for i, f in enumerate(fields)),
        *(
            F.approx_count_distinct(_known(df, f)).alias(f"unique_{i}")
            for i, f in enumerate(fields)
            if approx
        ),
    )
    if not approx:
        values = (df.select(_known(df, f).alias("v")).where("v IS NOT NULL") for f in fields)
        counts = (v.distinct().agg(F.count(F.lit(1)).alias("n")).scalar() for v in values)
        wide = wide.withColumns({f"unique_{i}": n for i, n in enumerate(counts)})
    return _summary_rows(wide, fields)


def column_sketches(df: DataFrame, by: list[Column]) -> DataFrame:
    """Rows, missing values and a sketch of the known ones of every column, per group of `by`.

    Store it per day: sketches of any days merge to the sketch of all their rows.
    """
    fields = df.schema.fields
    text = [_known(df, f).cast("string") for f in fields]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(t.isNull()).alias(f"missing_{i}") for i, t in enumerate(text)),
        *(F.hll_sketch_agg(t, SKETCH_BITS).alias(f"sketch_{i}") for i, t in enumerate(text)),
    )


def summary_of_sketches(sketches: DataFrame, schema: T.StructType) -> DataFrame:
    """`data_quality_summary` from stored `column_sketches` of rows with `schema`; known values are
    counted with a standard error of 1.6 %."""
    fields = schema.fields
    numbers = range(len(fields))
    wide = sketches.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        *(F.coalesce(F.sum(f"missing_{i}"), F.lit(0)).alias(f"missing_{i}") for i in numbers),
        *(F.hll_union_agg(f"sketch_{i}").alias(f"sketch_{i}") for i in numbers),
    )
    counted = {
        f"unique_{i}": F.coalesce(F.hll_sketch_estimate(f"sketch_{i}"), F.lit(0)) for i in numbers
    }
    return _summary_rows(wide.withColumns(counted), fields)
