"""Run the queries next to their SQL counterparts and report differences.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

from checks.oracles import ORACLES
from checks.queries import QUERIES
from shelfline.session import local_session

DEFAULT_FOLDER = "/root/testdata/sf0.01"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _texts(frame: pd.DataFrame) -> pd.DataFrame:
    def text(value) -> str:
        if pd.isna(value):
            return "NULL"
        if isinstance(value, (bool,)) or type(value).__name__ in ("bool_", "bool"):
            return str(bool(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return repr(float(value))
        return str(pd.Timestamp(value)) if hasattr(value, "year") else str(value)

    columns = sorted(frame.columns)
    out = pd.DataFrame({c: [text(v) for v in frame[c].astype(object)] for c in columns})
    return out.sort_values(columns).reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty when both frames hold the same rows in any order."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} vs {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} vs {len(sql_rows)}"
    left, right = _texts(spark_rows), _texts(sql_rows)
    wrong = (left != right).any(axis=1)
    if not wrong.any():
        return ""
    return f"{int(wrong.sum())} rows differ, e.g.\n{left[wrong].head(3)}\n{right[wrong].head(3)}"


# Spark's name of each SQL type.
TYPES = {
    "BIGINT": "bigint",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "DOUBLE": "double",
    "INTEGER": "int",
    "TIMESTAMP": "timestamp",
    "VARCHAR": "string",
}


def type_difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Columns whose types differ."""
    wanted = {row[0]: TYPES.get(row[1], row[1]) for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    pairs = ((name, kind, wanted.get(name)) for name, kind in df.dtypes)
    return ", ".join(f"{name}: {kind} vs {other}" for name, kind, other in pairs if kind != other)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else DEFAULT_FOLDER
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), connect(folder)
    failed = 0
    for name in names:
        began = time.time()
        try:
            result = QUERIES[name](spark, folder)
            rows = result.toPandas()
            taken = time.time() - began
            if name not in ORACLES:
                print(f"rows {name}: {len(rows)} ({taken:.1f}s)", flush=True)
                continue
            expected = con.execute(ORACLES[name]).df()
            problem = difference(rows, expected) or type_difference(result, con, ORACLES[name])
        except Exception as error:  # noqa: BLE001 - reported per query
            taken, problem, rows = time.time() - began, str(error)[:1500], []
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok'} {name}: {len(rows)} ({taken:.1f}s) {problem}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
