"""The same answers in DuckDB SQL, built from named common table expressions."""

from __future__ import annotations

# name -> (SQL, names it reads)
CTES: dict[str, tuple[str, list[str]]] = {}
ORACLES: dict[str, str] = {}

YEAR = 365


def cte(name: str, sql: str, *reads: str) -> str:
    CTES[name] = (sql, list(reads))
    return name


def _chain(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][1]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def oracle(name: str, sql: str, *reads: str, doubles: str = "") -> None:
    """Register the answer; `doubles` lists the columns to round."""
    replaced = ", ".join(f"ROUND({c}, 6) + CAST(0 AS DOUBLE) AS {c}" for c in doubles.split())
    outer = f"SELECT * REPLACE ({replaced}) FROM answer" if replaced else "SELECT * FROM answer"
    steps = [f"{n} AS ({CTES[n][0]})" for n in _chain(list(reads))] + [f"answer AS ({sql})"]
    ORACLES[name] = "WITH " + ",\n".join(steps) + "\n" + outer


# Inputs ---------------------------------------------------------------------------------

LINES = """
FROM lineitem l
JOIN orders   o  ON o.o_orderkey  = l.l_orderkey
JOIN customer cu ON cu.c_custkey  = o.o_custkey
JOIN nation   n  ON n.n_nationkey = cu.c_nationkey
JOIN part     p  ON p.p_partkey   = l.l_partkey
"""

TYPED = """
  CASE WHEN l.l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l.l_orderkey AS VARCHAR) AS invoice,
  CASE WHEN l.l_partkey % 211 = 0 THEN NULL
       WHEN l.l_partkey % 223 = 0 THEN '' ELSE p.p_brand END AS stock_code,
  CASE WHEN l.l_partkey % 3 <> 0 THEN '  ' || p.p_type || ' ' END AS description,
  CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS quantity,
  CASE WHEN l.l_orderkey % 1009 = 0 THEN NULL ELSE l.l_shipdate END AS invoice_date,
  CASE WHEN l.l_partkey % 97 = 0 THEN NULL
       WHEN l.l_partkey % 89 = 0 THEN CAST(0 AS DOUBLE)
       ELSE FLOOR(l.l_extendedprice / l.l_quantity * 100) / CAST(100 AS DOUBLE) END AS unit_price,
  CASE WHEN o.o_custkey % 50 = 0 THEN NULL ELSE CAST(o.o_custkey AS VARCHAR) END AS customer_id,
  ' ' || n.n_name AS country
"""

cte("transactions", f"SELECT {TYPED} {LINES}")
cte("raw_lines", f"SELECT {TYPED}, l.l_orderkey AS okey, l.l_partkey AS pkey {LINES}")
cte(
    "raw_once",
    """
SELECT invoice, stock_code, description, CAST(quantity AS VARCHAR) AS quantity,
  CASE WHEN okey % 1013 = 0 THEN 'not a date' WHEN okey % 101 = 0 THEN '8:26'
    WHEN okey % 103 = 0 THEN strftime(invoice_date, '%-m/%-d/%Y %-H:%M:%S')
    WHEN okey % 107 = 0 THEN strftime(invoice_date, '%-m/%-d/%y %-H:%M')
    WHEN okey % 109 = 0 THEN strftime(invoice_date, '%-m-%-d-%Y %-H:%M')
    WHEN okey % 113 = 0 THEN strftime(invoice_date, '%-d %b %Y')
    WHEN okey % 127 = 0 THEN strftime(invoice_date, '%Y%m%d')
    ELSE CAST(invoice_date AS VARCHAR) END AS invoice_date,
  CASE WHEN pkey % 101 = 0 THEN 'abc' WHEN pkey % 103 = 0 THEN '0x1p3' WHEN pkey % 107 = 0 THEN '12d'
    ELSE CAST(unit_price AS VARCHAR) END AS unit_price,
  customer_id, country, okey
FROM raw_lines""",
    "raw_lines",
)
RAW = "invoice, stock_code, description, quantity, invoice_date, unit_price, customer_id, country"
cte(
    "raw",
    f"SELECT {RAW} FROM raw_once UNION ALL SELECT {RAW} FROM raw_once WHERE okey % 997 = 0",
    "raw_once",
)
cte(
    "fact",
    """
SELECT invoice, stock_code, TRIM(description) AS description, quantity, invoice_date,
  CAST(invoice_date AS DATE) AS sales_date, unit_price, customer_id, country,
  TRIM(country) AS market_id,
  COALESCE(invoice LIKE 'C%' OR quantity < 0, FALSE) AS is_return_flag,
  unit_price IS NULL AS is_price_missing,
  unit_price IS NULL OR unit_price <= 0 AS is_price_invalid,
  quantity * unit_price AS revenue
FROM transactions""",
    "transactions",
)
cte(
    "mart",
    """
SELECT sales_date, stock_code, MIN(description) AS description, market_id,
  SUM(CASE WHEN is_return_flag THEN 0 ELSE quantity END) AS sales_qty,
  AVG(CASE WHEN is_price_invalid THEN NULL ELSE unit_price END) AS avg_unit_price,
  SUM(revenue) AS revenue,
  COUNT(DISTINCT invoice) AS invoices_cnt,
  COUNT(DISTINCT customer_id) AS customers_cnt,
  ABS(SUM(CASE WHEN is_return_flag THEN quantity ELSE 0 END)) AS returns_qty,
  SUM(quantity) AS net_sales_qty,
  CAST(EXTRACT(dow FROM sales_date) AS INTEGER) AS weekday,
  CAST(EXTRACT(month FROM sales_date) AS INTEGER) AS month,
  CAST(EXTRACT(year FROM sales_date) AS INTEGER) AS year,
  EXTRACT(dow FROM sales_date) IN (0, 6) AS is_weekend,
  BOOL_OR(is_return_flag) AS is_return_flag,
  BOOL_OR(is_price_missing) AS is_price_missing
FROM fact
WHERE sales_date IS NOT NULL AND stock_code IS NOT NULL AND market_id IS NOT NULL
GROUP BY sales_date, stock_code, market_id""",
    "fact",
)
cte(
    "dense",
    """
SELECT CAST(ts AS DATE) AS sales_date, event_type AS stock_code,
  'M' || CAST(user_id % 5 AS VARCHAR) AS market_id,
  ROUND(SUM(CASE WHEN event_id % 4 = 0 THEN -2 * value ELSE value END), 2) AS net_sales_qty,
  AVG(value) AS avg_unit_price, COUNT(*) AS invoices_cnt,
  COUNT(DISTINCT user_id) AS customers_cnt, SUM(value) AS revenue
FROM events GROUP BY ALL""",
)

# Features -------------------------------------------------------------------------------

SERIES = "PARTITION BY stock_code, market_id ORDER BY sales_date"


def feature_sql(source: str) -> str:
    before = f"({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
SELECT * EXCLUDE (rn, sale_date, sale_rn),
  avg_unit_price - avg_unit_price_lag_7 AS price_change_abs,
  (avg_unit_price - avg_unit_price_lag_7) / NULLIF(avg_unit_price_lag_7, 0) AS price_change_pct,
  CAST(DATE_DIFF('day', sale_date, sales_date) AS INTEGER) AS days_since_last_sale,
  CAST(rn - 1 - COALESCE(sale_rn, 0) AS INTEGER) AS zero_sales_streak
FROM (
  SELECT *,
    MAX(CASE WHEN net_sales_qty > 0 THEN sales_date END) OVER {before} AS sale_date,
    MAX(CASE WHEN net_sales_qty > 0 THEN rn END) OVER {before} AS sale_rn
  FROM (
    SELECT *,
      ROW_NUMBER() OVER w AS rn,
      LAG(net_sales_qty, 7) OVER w AS lag_7,
      LAG(net_sales_qty, 14) OVER w AS lag_14,
      LAG(net_sales_qty, 28) OVER w AS lag_28,
      LAG(invoices_cnt, 7) OVER w AS invoices_cnt_lag_7,
      LAG(customers_cnt, 7) OVER w AS customers_cnt_lag_7,
      AVG(net_sales_qty) OVER week AS rolling_mean_7,
      AVG(net_sales_qty) OVER month28 AS rolling_mean_28,
      STDDEV_SAMP(net_sales_qty) OVER month28 AS rolling_std_28,
      MEDIAN(net_sales_qty) OVER month28 AS rolling_median_28,
      LAG(avg_unit_price, 7) OVER w AS avg_unit_price_lag_7
    FROM {source}
    WINDOW w AS ({SERIES}),
      week AS ({SERIES} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
      month28 AS ({SERIES} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)
  )
)"""


cte("features", feature_sql("mart"), "mart")
cte("dense_features", feature_sql("dense"), "dense")
MONDAY = """
  CAST(EXTRACT(isodow FROM sales_date) - 1 AS INTEGER) AS weekday,
  CAST(EXTRACT(month FROM sales_date) AS INTEGER) AS month,
  CAST(EXTRACT(year FROM sales_date) AS INTEGER) AS year,
  CASE WHEN EXTRACT(isodow FROM sales_date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend"""
cte(
    "matrix",
    "SELECT * REPLACE ("
    "CAST(EXTRACT(isodow FROM sales_date) - 1 AS INTEGER) AS weekday, "
    "CASE WHEN EXTRACT(isodow FROM sales_date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend) "
    "FROM features",
    "features",
)
cte(
    "baselines",
    f"""
SELECT sales_date, stock_code, market_id, net_sales_qty,
  LAG(net_sales_qty, 1) OVER w AS naive_last_value,
  LAG(net_sales_qty, 7) OVER w AS seasonal_naive_7,
  LAG(net_sales_qty, 28) OVER w AS seasonal_naive_28,
  AVG(net_sales_qty) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS moving_average_7,
  AVG(net_sales_qty) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS moving_average_28,
  MEDIAN(net_sales_qty) OVER (
    PARTITION BY stock_code, market_id, EXTRACT(dow FROM sales_date) ORDER BY sales_date
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS median_by_weekday
FROM mart WINDOW w AS ({SERIES})""",
    "mart",
)
BASELINES = [
    "naive_last_value",
    "seasonal_naive_7",
    "seasonal_naive_28",
    "moving_average_7",
    "moving_average_28",
    "median_by_weekday",
]
cte("days", "SELECT DISTINCT sales_date AS day FROM mart", "mart")
cte("placed", "SELECT day, ROW_NUMBER() OVER (ORDER BY day) - 1 AS pos, COUNT(*) OVER () AS n FROM days", "days")
for _n in (28, YEAR):
    cte(f"late{_n}", f"SELECT MIN(day) AS start FROM (SELECT day FROM days ORDER BY day DESC LIMIT {_n})", "days")
    cte(
        f"held{_n}",
        f"SELECT baselines.* FROM baselines, late{_n} WHERE sales_date >= start",
        "baselines",
        f"late{_n}",
    )
    cte(
        f"forecast{_n}",
        f"""SELECT sales_date, stock_code, market_id, net_sales_qty,
  moving_average_28 AS forecast_net_sales_qty
FROM held{_n} WHERE moving_average_28 IS NOT NULL""",
        f"held{_n}",
    )

# Metrics --------------------------------------------------------------------------------


def metric_sql(a: str, f: str, limit: str = "0") -> dict[str, str]:
    """Metric expressions over rows in which both sides are known."""
    return {
        "wmape": f"CASE WHEN SUM(ABS({a})) = 0 THEN CASE WHEN SUM(ABS({a} - {f})) = 0 THEN 0.0 ELSE 1.0 END "
        f"ELSE SUM(ABS({a} - {f})) / SUM(ABS({a})) END",
        "mae": f"AVG(ABS({a} - {f}))",
        "rmse": f"SQRT(AVG(({a} - {f}) * ({a} - {f})))",
        "bias": f"CASE WHEN SUM(ABS({a})) = 0 THEN CAST(SIGN(SUM({f} - {a})) AS DOUBLE) "
        f"ELSE SUM({f} - {a}) / SUM(ABS({a})) END",
        "service_level_proxy": f"AVG(CASE WHEN {f} >= {a} THEN 1.0 ELSE 0.0 END)",
        "stockout_risk_rate": f"AVG(CASE WHEN {a} - {f} > {limit} THEN 1.0 ELSE 0.0 END)",
    }


ACTUAL, PREDICTED = "net_sales_qty", "forecast_net_sales_qty"
SIX = metric_sql(ACTUAL, PREDICTED)
FOUR = ", ".join(f"{SIX[m]} AS {m}" for m in ("wmape", "mae", "rmse", "bias"))


def score_rows(source: str, columns: list[str], where: str = "{c} IS NOT NULL") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS baseline, '{m}' AS metric, CAST({e} AS DOUBLE) AS value "
        f"FROM {source} WHERE {where.format(c=c)}"
        for c in columns
        for m, e in metric_sql(ACTUAL, c).items()
    )


cte("scores", score_rows(f"held{YEAR}", BASELINES), f"held{YEAR}")

# Segments -------------------------------------------------------------------------------

cte(
    "stats",
    """
SELECT stock_code, market_id, COALESCE(SUM(revenue), 0) AS revenue,
  COALESCE(SUM(net_sales_qty), 0) AS total_net_sales_qty,
  AVG(net_sales_qty) AS mean_net_sales_qty,
  COALESCE(STDDEV_SAMP(net_sales_qty), 0) AS std_net_sales_qty,
  COUNT(net_sales_qty) AS active_days
FROM mart GROUP BY stock_code, market_id""",
    "mart",
)
cte(
    "running",
    """
SELECT *, CAST(revenue AS DECIMAL(28, 6)) AS exact,
  SUM(CAST(revenue AS DECIMAL(28, 6))) OVER (
    ORDER BY CAST(revenue AS DECIMAL(28, 6)) DESC, stock_code, market_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  SUM(CAST(revenue AS DECIMAL(28, 6))) OVER () AS whole
FROM stats""",
    "stats",
)
cte(
    "abc",
    """
SELECT * EXCLUDE (exact, upto, whole),
  CASE WHEN whole > 0 THEN revenue / CAST(whole AS DOUBLE) ELSE 0 END AS value_share,
  CASE WHEN whole > 0 THEN CAST(upto AS DOUBLE) / CAST(whole AS DOUBLE) ELSE 0 END AS cumulative_share,
  CASE WHEN whole <= 0 THEN 'C'
       WHEN (upto - exact) * 100 < whole * 80 THEN 'A'
       WHEN (upto - exact) * 100 < whole * 95 THEN 'B' ELSE 'C' END AS abc_segment
FROM running""",
    "running",
)
XYZ = """
  std_net_sales_qty / NULLIF(mean_net_sales_qty, 0) AS coefficient_of_variation,
  CASE WHEN std_net_sales_qty / NULLIF(mean_net_sales_qty, 0) <= 0.5 THEN 'X'
       WHEN std_net_sales_qty / NULLIF(mean_net_sales_qty, 0) <= 1.0 THEN 'Y'
       ELSE 'Z' END AS xyz_segment"""
cte(
    "segments",
    f"SELECT *, abc_segment || xyz_segment AS abc_xyz_segment FROM (SELECT *, {XYZ} FROM abc)",
    "abc",
)
STATS_DOUBLES = "revenue total_net_sales_qty mean_net_sales_qty std_net_sales_qty"
SEGMENT_DOUBLES = STATS_DOUBLES + " value_share cumulative_share coefficient_of_variation"

# Inventory ------------------------------------------------------------------------------


def policy_sql(
    source: str, lead: int = 7, z: float = 1.65, multiplier: float = 1.0, keys: str = "stock_code, market_id"
) -> str:
    clipped = metric_sql("a", "f")
    return f"""
SELECT *, z_score * demand_std * SQRT(lead_time_days) AS suggested_safety_stock,
  avg_daily_demand * lead_time_days + z_score * demand_std * SQRT(lead_time_days)
    AS suggested_reorder_point
FROM (
  SELECT {keys}, COUNT(DISTINCT sales_date) AS observed_days,
    AVG(a) AS avg_daily_demand, COALESCE(STDDEV_SAMP(a), 0) AS demand_std,
    AVG(f) AS avg_forecast_sales,
    {clipped["wmape"]} AS forecast_error, {clipped["bias"]} AS forecast_bias,
    AVG(CASE WHEN a > f * CAST({multiplier} AS DOUBLE) OR a > f THEN 1.0 ELSE 0.0 END) AS stockout_risk_rate,
    AVG(CASE WHEN f > a THEN 1.0 ELSE 0.0 END) AS overstock_risk_rate,
    BOOL_OR(a > f * CAST({multiplier} AS DOUBLE) OR a > f) AS stockout_risk_flag,
    BOOL_OR(f > a) AS overstock_risk_flag,
    COUNT(CASE WHEN net_sales_qty < 0 THEN 1 END) AS negative_actual_sales_count,
    CAST({lead} AS INTEGER) AS lead_time_days, CAST({z} AS DOUBLE) AS z_score,
    AVG(f * CAST({multiplier} AS DOUBLE)) AS available_stock_assumption
  FROM (SELECT *, GREATEST(net_sales_qty, 0) AS a, GREATEST(forecast_net_sales_qty, 0) AS f FROM {source})
  GROUP BY {keys}
)"""


POLICY_DOUBLES = (
    "avg_daily_demand demand_std avg_forecast_sales forecast_error forecast_bias stockout_risk_rate "
    "overstock_risk_rate z_score available_stock_assumption suggested_safety_stock "
    "suggested_reorder_point"
)
cte("policy", policy_sql(f"forecast{YEAR}"), f"forecast{YEAR}")
cte(
    "sourced",
    f"""SELECT 'model' AS source, sales_date, stock_code, market_id, net_sales_qty,
  moving_average_28 AS forecast_net_sales_qty FROM held{YEAR} WHERE moving_average_28 IS NOT NULL
UNION ALL SELECT 'naive', sales_date, stock_code, market_id, net_sales_qty, naive_last_value
FROM held{YEAR} WHERE naive_last_value IS NOT NULL""",
    f"held{YEAR}",
)
cte("by_source", policy_sql("sourced", keys="source, stock_code, market_id"), "sourced")
METRICS10 = """stock_code, market_id, avg_daily_demand, demand_std, forecast_error, forecast_bias,
  stockout_risk_flag, overstock_risk_flag, suggested_reorder_point, suggested_safety_stock"""
METRICS10_DOUBLES = (
    "avg_daily_demand demand_std forecast_error forecast_bias suggested_reorder_point "
    "suggested_safety_stock"
)

# Dashboard ------------------------------------------------------------------------------

cte(
    "group_errors",
    f"SELECT stock_code, market_id, {FOUR} FROM forecast{YEAR} GROUP BY stock_code, market_id",
    f"forecast{YEAR}",
)


def dashboard_sql(stock: str) -> str:
    return f"""
SELECT r.sales_date, r.stock_code, '' AS description, r.market_id,
  s.abc_segment, s.xyz_segment, s.abc_xyz_segment,
  r.net_sales_qty AS actual_sales, r.forecast_net_sales_qty AS forecast_sales,
  r.net_sales_qty - r.forecast_net_sales_qty AS forecast_error,
  ABS(r.net_sales_qty - r.forecast_net_sales_qty) AS abs_forecast_error,
  g.wmape, g.mae, g.rmse, g.bias, s.revenue,
  i.stockout_risk_flag, i.overstock_risk_flag, i.suggested_reorder_point, i.suggested_safety_stock
FROM forecast{YEAR} r
LEFT JOIN segments s ON s.stock_code = r.stock_code AND s.market_id = r.market_id
LEFT JOIN {stock} i ON i.stock_code = r.stock_code AND i.market_id = r.market_id
LEFT JOIN group_errors g ON g.stock_code = r.stock_code AND g.market_id = r.market_id"""


cte("model_source", "SELECT * FROM by_source WHERE source = 'model'", "by_source")
_DASH = ("segments", "group_errors", f"forecast{YEAR}")
cte("dashboard", dashboard_sql("policy"), "policy", *_DASH)
DASHBOARD_DOUBLES = (
    "actual_sales forecast_sales forecast_error abs_forecast_error wmape mae rmse bias revenue "
    "suggested_reorder_point suggested_safety_stock"
)

# Answers: sources and schema ------------------------------------------------------------

# Of the raw fixture's spellings; a bare time is no date.
_DATE = """CASE WHEN regexp_matches(invoice_date, '^[0-9]{4}-') THEN TRY_CAST(invoice_date AS TIMESTAMP)
  ELSE CAST(try_strptime(invoice_date, ['%m/%d/%Y %H:%M:%S', '%m/%d/%y %H:%M', '%m-%d-%Y %H:%M',
    '%d %b %Y', '%Y%m%d']) AS TIMESTAMP) END"""
_PRICE = """CASE WHEN regexp_matches(unit_price, '^[-+]?[0-9]+[.]?[0-9]*$')
  THEN TRY_CAST(unit_price AS DOUBLE) END"""
_raw_typed = """SELECT invoice, {code} AS stock_code, description,
  TRY_CAST(quantity AS DOUBLE) AS quantity, {date} AS invoice_date,
  {price} AS unit_price, customer_id, country FROM raw"""
oracle("read_transactions", _raw_typed.format(code="NULLIF(stock_code, '')", date=_DATE, price=_PRICE), "raw", doubles="quantity unit_price")
oracle("normalize_column_names", _raw_typed.format(code="stock_code", date=_DATE, price=_PRICE), "raw", doubles="quantity unit_price")
_renamed = """SELECT sales_date, stock_code, market_id, net_sales_qty AS actual_sales,
  forecast_net_sales_qty AS forecast_sales FROM forecast{n}"""
oracle(
    "normalize_dashboard_columns", _renamed.format(n=28), "forecast28", doubles="actual_sales forecast_sales"
)
oracle(
    "read_source",
    _renamed.format(n=YEAR).replace("stock_code,", "NULLIF(stock_code, '') AS stock_code,"),
    f"forecast{YEAR}",
    doubles="actual_sales forecast_sales",
)
for _name in ("transactions_schema", "prepare_transactions"):
    oracle(_name, "SELECT * FROM fact", "fact", doubles="quantity unit_price revenue")
oracle(
    "dim_date",
    """SELECT DISTINCT sales_date, CAST(EXTRACT(dow FROM sales_date) AS INTEGER) AS weekday,
  CAST(EXTRACT(month FROM sales_date) AS INTEGER) AS month,
  CAST(EXTRACT(year FROM sales_date) AS INTEGER) AS year,
  EXTRACT(dow FROM sales_date) IN (0, 6) AS is_weekend FROM fact WHERE sales_date IS NOT NULL""",
    "fact",
)
oracle(
    "dim_product",
    """SELECT stock_code, description FROM (
  SELECT stock_code, description, ROW_NUMBER() OVER (PARTITION BY stock_code
    ORDER BY description IS NULL, COUNT(*) DESC, description) AS place
  FROM fact WHERE stock_code IS NOT NULL GROUP BY stock_code, description) WHERE place = 1""",
    "fact",
)
oracle(
    "dim_market",
    "SELECT DISTINCT market_id, market_id AS country FROM fact WHERE market_id IS NOT NULL",
    "fact",
)
oracle(
    "write_forecast", "SELECT * FROM forecast28", "forecast28", doubles="net_sales_qty forecast_net_sales_qty"
)

# Answers: quality -----------------------------------------------------------------------

_TOTAL = "(SELECT COUNT(*) FROM raw)"
_counts = {
    "negative": f"(SELECT COUNT(*) FROM raw WHERE {_PRICE} <= 0)",
    "price": f"(SELECT COUNT(*) FROM raw WHERE {_PRICE} IS NULL)",
    "copies": "(SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw))",
    "date": f"(SELECT COUNT(*) FROM raw WHERE {_DATE} IS NULL)",
    "code": "(SELECT COUNT(*) FROM raw WHERE stock_code IS NULL OR TRIM(stock_code) = '')",
    "returned": "(SELECT COUNT(*) FROM raw WHERE COALESCE(invoice LIKE 'C%', FALSE) "
    "OR COALESCE(TRY_CAST(quantity AS DOUBLE) < 0, FALSE))",
}


def _check(check: str, metric: str, value: str, passed: str, good: str, bad: str) -> str:
    return (
        f"SELECT '{check}' AS \"check\", {passed} AS passed, '{metric}' AS metric_name, "
        f"CAST({value} AS DOUBLE) AS metric_value, "
        f"CASE WHEN {passed} THEN '{good}' ELSE '{bad}' END AS message"
    )


def _count_and_share(check: str, stem: str, key: str, passed: str, good: str, bad: str) -> str:
    value = _counts[key]
    portion = f"ROUND(CAST({value} AS DOUBLE) / NULLIF({_TOTAL}, 0), 6)"
    return (
        _check(check, f"{stem}_count", value, passed, good, bad)
        + " UNION ALL "
        + _check(check, f"{stem}_share", portion, passed, good, bad)
    )


def _zero(key: str) -> str:
    return f"({_counts[key]} = 0)"


_positive = ("every known price is positive", "zero or negative prices occur")
CHECKS = {
    "check_required_columns": _check(
        "required_columns", "rows", _TOTAL, "TRUE", "all required columns are present", ""
    )
    + " UNION ALL "
    + _check("required_columns", "missing_columns", "0", "TRUE", "all required columns are present", ""),
    "check_negative_prices": _check(
        "negative_or_zero_prices", "invalid_price_rows", _counts["negative"], _zero("negative"), *_positive
    )
    + " UNION ALL "
    + _check("negative_or_zero_prices", "missing_price_rows", _counts["price"], _zero("negative"), *_positive),
    "check_duplicate_rows": _count_and_share(
        "duplicate_transaction_rows", "duplicates", "copies", _zero("copies"),
        "no row occurs twice", "rows repeat others in full",
    ),
    "check_missing_invoice_date": _count_and_share(
        "missing_invoice_date", "missing_invoice_date", "date", _zero("date"),
        "every row has a readable invoice date", "some rows lack a readable invoice date",
    ),
    "check_missing_stock_code": _count_and_share(
        "missing_stock_code", "missing_stock_code", "code", _zero("code"),
        "every row has a stock code", "some rows lack a stock code",
    ),
    "check_missing_prices_share": _count_and_share(
        "missing_prices_share", "missing_prices", "price", _zero("price"),
        "every row has a price", "some rows lack a price, which distorts revenue and mean price",
    ),
    "check_returns_share": _count_and_share(
        "returns_share", "returns", "returned", "TRUE",
        "returns are counted, their rows are kept", "",
    ),
}
for _name, _sql in CHECKS.items():
    oracle(_name, _sql, "raw", doubles="metric_value")
oracle("run_all_data_checks", " UNION ALL ".join(CHECKS.values()), "raw", doubles="metric_value")
oracle(
    "data_quality_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing_count, "
        f"ROUND(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*), 6) AS missing_share, "
        f"COUNT(DISTINCT {c}) AS unique_count FROM raw"
        for c in RAW.split(", ")
    ),
    "raw",
    doubles="missing_share",
)

oracle(
    "data_quality_sketches",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing_count, "
        f"ROUND(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*), 6) AS missing_share, "
        "TRUE AS unique_count_is_near FROM raw"
        for c in RAW.split(", ")
    ),
    "raw",
    doubles="missing_share",
)

# Answers: mart, features, baselines -----------------------------------------------------

MART_DOUBLES = "sales_qty avg_unit_price revenue returns_qty net_sales_qty"
FEATURE_DOUBLES = (
    "lag_7 lag_14 lag_28 rolling_mean_7 rolling_mean_28 rolling_std_28 rolling_median_28 "
    "avg_unit_price_lag_7 price_change_abs price_change_pct"
)
KEYS = "sales_date, stock_code, market_id, net_sales_qty"
oracle("mart_daily_sales", "SELECT * FROM mart", "mart", doubles=MART_DOUBLES)
oracle("mart_refreshed", "SELECT * FROM mart", "mart", doubles=MART_DOUBLES)
oracle("feature_view", "SELECT * FROM features", "features", doubles=f"{MART_DOUBLES} {FEATURE_DOUBLES}")
oracle("feature_matrix", "SELECT * FROM matrix", "matrix", doubles=f"{MART_DOUBLES} {FEATURE_DOUBLES}")
oracle(
    "feature_view_dense",
    "SELECT * FROM dense_features",
    "dense_features",
    doubles=f"net_sales_qty avg_unit_price revenue {FEATURE_DOUBLES}",
)
for _name, _columns, _doubles in (
    ("lag_features", "lag_7, lag_14, lag_28, invoices_cnt_lag_7, customers_cnt_lag_7", "lag_7 lag_14 lag_28"),
    ("rolling_mean", "rolling_mean_7, rolling_mean_28", "rolling_mean_7 rolling_mean_28"),
    ("rolling_std_28", "rolling_std_28", "rolling_std_28"),
    ("rolling_median_28", "rolling_median_28", "rolling_median_28"),
    (
        "rolling_features",
        "rolling_mean_7, rolling_mean_28, rolling_std_28, rolling_median_28",
        "rolling_mean_7 rolling_mean_28 rolling_std_28 rolling_median_28",
    ),
    (
        "price_features",
        "avg_unit_price_lag_7, price_change_abs, price_change_pct",
        "avg_unit_price_lag_7 price_change_abs price_change_pct",
    ),
    ("days_since_last_sale", "days_since_last_sale", ""),
    ("zero_sales_streak", "zero_sales_streak", ""),
):
    oracle(_name, f"SELECT {KEYS}, {_columns} FROM features", "features", doubles=f"net_sales_qty {_doubles}")
oracle("calendar_features", f"SELECT {KEYS}, {MONDAY} FROM mart", "mart", doubles="net_sales_qty")
_generic = """SELECT market_id, date, sales,
  LAG(sales, 1) OVER w AS lag_1, LAG(sales, 7) OVER w AS lag_7,
  AVG(sales) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_mean_3,
  AVG(sales) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS rolling_mean_14
FROM (SELECT market_id, sales_date AS date, SUM(net_sales_qty) AS sales FROM mart GROUP BY ALL)
WINDOW w AS (PARTITION BY market_id ORDER BY date)"""
for _name in ("lag_rolling_generic", "lag_rolling_split_groups"):
    oracle(_name, _generic, "mart", doubles="sales lag_1 lag_7 rolling_mean_3 rolling_mean_14")
for _name in BASELINES:
    oracle(_name, f"SELECT {KEYS}, {_name} FROM baselines", "baselines", doubles=f"net_sales_qty {_name}")
oracle(
    "baselines_all", "SELECT * FROM baselines", "baselines", doubles="net_sales_qty " + " ".join(BASELINES)
)
oracle(
    "seasonal_naive",
    f"SELECT {KEYS}, LAG(net_sales_qty, 14) OVER ({SERIES}) AS seasonal_naive FROM mart",
    "mart",
    doubles="net_sales_qty seasonal_naive",
)
oracle(
    "moving_average_forecast",
    f"SELECT {KEYS}, AVG(net_sales_qty) OVER ({SERIES} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) "
    "AS moving_average FROM mart",
    "mart",
    doubles="net_sales_qty moving_average",
)
oracle("baseline_metrics", "SELECT * FROM scores", "scores", doubles="value")
oracle(
    "baseline_metrics_common_rows",
    score_rows(
        f"held{YEAR}", BASELINES, " AND ".join(f"{b} IS NOT NULL" for b in BASELINES)
    ),
    f"held{YEAR}",
    doubles="value",
)
_BEST = "SELECT baseline, metric, value FROM scores WHERE metric = 'wmape' ORDER BY value, baseline LIMIT 1"
oracle("best_baseline", _BEST, "scores", doubles="value")
oracle(
    "compare_baseline_with_best",
    "SELECT 'model' AS source, metric, value FROM scores "
    "WHERE metric = 'wmape' AND baseline = 'moving_average_28' "
    f"UNION ALL SELECT baseline, metric, value FROM ({_BEST})",
    "scores",
    doubles="value",
)

# Answers: validation --------------------------------------------------------------------

for _name in ("train_holdout_split", "train_holdout_by_month"):
    oracle(
        _name,
        f"SELECT {KEYS}, CASE WHEN sales_date < start THEN 'train' ELSE 'holdout' END AS role FROM mart, late28",
        "mart",
        "late28",
        doubles="net_sales_qty",
    )


def folds_sql(splits: int, horizon: int, gap: int = 0) -> str:
    first = f"(n - ({splits} - s.split + 1) * {horizon})"
    return f"""
SELECT CAST(s.split AS INTEGER) AS split,
  MIN(day) AS train_start,
  MAX(CASE WHEN pos = {first} - 1 - {gap} THEN day END) AS train_end,
  MAX(CASE WHEN pos = {first} THEN day END) AS valid_start,
  MAX(CASE WHEN pos = {first} + {horizon} - 1 THEN day END) AS valid_end
FROM placed, (SELECT UNNEST(RANGE(1, {splits + 1})) AS split) s GROUP BY s.split"""


cte("folds", folds_sql(3, 28), "placed")
oracle("make_time_splits", "SELECT * FROM folds", "folds")
oracle("make_time_series_folds", folds_sql(4, 28, 7), "placed")
_roles = """SELECT m.sales_date, m.stock_code, m.market_id, m.net_sales_qty{split},
  CASE WHEN m.sales_date <= f.train_end THEN 'train' ELSE 'valid' END AS role
FROM mart m JOIN folds f ON (m.sales_date BETWEEN f.train_start AND f.train_end)
  OR (m.sales_date BETWEEN f.valid_start AND f.valid_end)"""
oracle("assign_folds", _roles.format(split=", f.split"), "mart", "folds", doubles="net_sales_qty")
oracle(
    "split_by_fold", _roles.format(split="") + " WHERE f.split = 2", "mart", "folds", doubles="net_sales_qty"
)

# Every row once per fold and role, and each metric from those rows.
cte(
    "fold_rows",
    """
SELECT b.*, f.split,
  CASE WHEN b.sales_date <= f.train_end THEN 'train' ELSE 'valid' END AS role
FROM baselines b JOIN folds f ON (b.sales_date BETWEEN f.train_start AND f.train_end)
  OR (b.sales_date BETWEEN f.valid_start AND f.valid_end)""",
    "baselines",
    "folds",
)
oracle(
    "baseline_metrics_by_fold",
    " UNION ALL ".join(
        f"SELECT split, role, '{c}' AS baseline, '{m}' AS metric, CAST({e} AS DOUBLE) AS value "
        f"FROM fold_rows WHERE {c} IS NOT NULL GROUP BY split, role"
        for c in BASELINES
        for m, e in metric_sql(ACTUAL, c).items()
    ),
    "fold_rows",
    doubles="value",
)

# Answers: metrics -----------------------------------------------------------------------

_F = f"forecast{YEAR}"
for _name, _metric in (
    ("mae", "mae"),
    ("rmse", "rmse"),
    ("wmape", "wmape"),
    ("forecast_bias", "bias"),
    ("service_level_proxy", "service_level_proxy"),
    ("stockout_risk_rate", "stockout_risk_rate"),
):
    oracle(
        _name,
        f"SELECT market_id, CAST({SIX[_metric]} AS DOUBLE) AS {_name} FROM {_F} GROUP BY market_id",
        _F,
        doubles=_name,
    )
oracle(
    "stockout_risk_rate_threshold",
    f"SELECT market_id, {metric_sql(ACTUAL, PREDICTED, '10')['stockout_risk_rate']} "
    f"AS stockout_risk_rate FROM {_F} GROUP BY market_id",
    _F,
    doubles="stockout_risk_rate",
)
oracle(
    "metrics_table",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {_F}" for m, e in SIX.items()
    ),
    _F,
    doubles="value",
)
oracle(
    "evaluate",
    "SELECT " + ", ".join(f"{e} AS {m}" for m, e in SIX.items()) + f" FROM {_F}",
    _F,
    doubles=" ".join(SIX),
)

# Answers: segments ----------------------------------------------------------------------

oracle("segment_stats", "SELECT * FROM stats", "stats", doubles=STATS_DOUBLES)
oracle(
    "abc_segment",
    "SELECT stock_code, market_id, revenue, value_share, cumulative_share, abc_segment FROM abc",
    "abc",
    doubles="revenue value_share cumulative_share",
)
oracle(
    "xyz_segment", f"SELECT *, {XYZ} FROM stats", "stats", doubles=STATS_DOUBLES + " coefficient_of_variation"
)
for _name in ("abc_xyz_segments", "abc_xyz_compat"):
    oracle(_name, "SELECT * FROM segments", "segments", doubles=SEGMENT_DOUBLES)

# Answers: model -------------------------------------------------------------------------

MODEL_FEATURES = [
    "avg_unit_price",
    "weekday",
    "month",
    "year",
    "is_weekend",
    "is_price_missing",
    "lag_7",
    "lag_14",
    "lag_28",
    "invoices_cnt_lag_7",
    "customers_cnt_lag_7",
    "rolling_mean_7",
    "rolling_mean_28",
    "rolling_std_28",
    "rolling_median_28",
    "avg_unit_price_lag_7",
    "price_change_abs",
    "price_change_pct",
    "days_since_last_sale",
    "zero_sales_streak",
]
oracle(
    "feature_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COUNT({c}) AS known_rows FROM matrix" for c in MODEL_FEATURES
    ),
    "matrix",
)
oracle(
    "prepare_train_test",
    f"SELECT {KEYS}, {', '.join(MODEL_FEATURES)}, "
    "CASE WHEN sales_date < start THEN 'train' ELSE 'holdout' END AS role FROM matrix, late28",
    "matrix",
    "late28",
    doubles=f"net_sales_qty avg_unit_price {FEATURE_DOUBLES}",
)

# What SQL knows of the model without training it.
_LATE = f"FROM matrix, late{YEAR} WHERE sales_date >= start"
oracle(
    "predict_non_negative",
    f"SELECT {KEYS}, TRUE AS usable {_LATE}",
    "matrix",
    f"late{YEAR}",
    doubles="net_sales_qty",
)
oracle(
    "evaluate_model",
    f"""SELECT COUNT(*) AS rows, SUM(ABS(net_sales_qty)) AS actual, TRUE AS mae_within_rmse,
  TRUE AS wmape_is_mae_share, TRUE AS rates_add_up {_LATE}""",
    "matrix",
    f"late{YEAR}",
    doubles="actual",
)
oracle(
    "compare_with_best_baseline",
    "SELECT 'model' AS source, 'wmape' AS metric, TRUE AS positive, CAST(NULL AS DOUBLE) AS baseline_value "
    f"UNION ALL SELECT baseline, metric, value > 0, value FROM ({_BEST})",
    "scores",
    doubles="baseline_value",
)
for _name, _known in (("feature_importance", "sums_to_one"), ("feature_split_counts", "any_split")):
    oracle(
        _name,
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, COUNT({c}) AS known_rows, TRUE AS {_known} FROM matrix"
            for c in MODEL_FEATURES
        ),
        "matrix",
    )
oracle(
    "modeling_run",
    f"""SELECT sales_date, COUNT(*) AS rows, SUM(net_sales_qty) AS actual_sales,
  TRUE AS forecast_not_negative {_LATE} GROUP BY sales_date""",
    "matrix",
    f"late{YEAR}",
    doubles="actual_sales",
)

# Answers: inventory ---------------------------------------------------------------------

oracle(
    "safety_stock",
    "SELECT stock_code, market_id, CAST(1.5 AS DOUBLE) * demand_std * SQRT(9) AS safety_stock FROM policy",
    "policy",
    doubles="safety_stock",
)
oracle(
    "reorder_point",
    "SELECT stock_code, market_id, avg_daily_demand * 9 + CAST(1.5 AS DOUBLE) * demand_std * SQRT(9) "
    "AS reorder_point FROM policy",
    "policy",
    doubles="reorder_point",
)
_A, _P = "GREATEST(net_sales_qty, 0)", "GREATEST(forecast_net_sales_qty, 0)"
oracle(
    "stockout_risk_proxy",
    f"SELECT sales_date, stock_code, market_id, {_A} > {_P} * 0.5 OR {_A} > {_P} AS stockout_risk FROM {_F}",
    _F,
)
oracle(
    "excess_stock_proxy",
    f"SELECT sales_date, stock_code, market_id, {_P} > {_A} AS excess_stock FROM {_F}",
    _F,
)
oracle("inventory_metrics", f"SELECT {METRICS10} FROM policy", "policy", doubles=METRICS10_DOUBLES)
cte("policy28", policy_sql("forecast28"), "forecast28")
oracle("inventory_metrics_28", f"SELECT {METRICS10} FROM policy28", "policy28", doubles=METRICS10_DOUBLES)
oracle("inventory_policy_table", "SELECT * FROM policy", "policy", doubles=POLICY_DOUBLES)
oracle("inventory_policy_half_stock", policy_sql(_F, 14, 2.05, 0.5), _F, doubles=POLICY_DOUBLES)
oracle(
    "service_level_z",
    """SELECT stock_code, market_id, service_level, z_score,
  z_score * demand_std * SQRT(7) AS safety_stock,
  avg_daily_demand * 7 + z_score * demand_std * SQRT(7) AS reorder_point
FROM policy_stats, (VALUES (CAST(0.9 AS DOUBLE), CAST(1.28 AS DOUBLE)), (0.95, 1.65), (0.98, 2.05),
  (0.99, 1.65)) AS levels(service_level, z_score)""",
    cte("policy_stats", "SELECT stock_code, market_id, avg_daily_demand, demand_std FROM policy", "policy"),
    doubles="service_level z_score safety_stock reorder_point",
)
oracle("risk_table_by_source", "SELECT * FROM by_source", "by_source", doubles=POLICY_DOUBLES)
for _name, _rate in (
    ("top_stockout_products", "stockout_risk_rate"),
    ("top_overstock_products", "overstock_risk_rate"),
):
    oracle(
        _name,
        f"SELECT * FROM policy ORDER BY {_rate} DESC, ROUND(forecast_error, 9) DESC, "
        "avg_daily_demand DESC, stock_code, market_id LIMIT 20",
        "policy",
        doubles=POLICY_DOUBLES,
    )
oracle(
    "scenario_grid",
    """SELECT stock_code, market_id, avg_daily_demand, demand_std, lead_time_days, service_level, z_score,
  z_score * demand_std * SQRT(lead_time_days) AS suggested_safety_stock,
  avg_daily_demand * lead_time_days + z_score * demand_std * SQRT(lead_time_days)
    AS suggested_reorder_point
FROM policy_stats, (VALUES (CAST(3 AS INTEGER)), (7), (14)) AS leads(lead_time_days),
  (VALUES (CAST(0.9 AS DOUBLE), CAST(1.28 AS DOUBLE)), (0.95, 1.65), (0.98, 2.05))
    AS levels(service_level, z_score)""",
    "policy_stats",
    doubles="avg_daily_demand demand_std service_level z_score suggested_safety_stock suggested_reorder_point",
)
oracle(
    "risk_summary",
    """SELECT COUNT(*) AS groups, COUNT(CASE WHEN stockout_risk_flag THEN 1 END) AS stockout_groups,
  COUNT(CASE WHEN overstock_risk_flag THEN 1 END) AS overstock_groups FROM policy""",
    "policy",
)

# Answers: dashboard and reports ---------------------------------------------------------

oracle("group_metrics", "SELECT * FROM group_errors", "group_errors", doubles="wmape mae rmse bias")
oracle("choose_inventory_source", "SELECT * FROM model_source", "model_source", doubles=POLICY_DOUBLES)
oracle(
    "row_errors",
    f"""SELECT sales_date, stock_code, market_id, net_sales_qty AS actual_sales,
  forecast_net_sales_qty AS forecast_sales, net_sales_qty - forecast_net_sales_qty AS forecast_error,
  ABS(net_sales_qty - forecast_net_sales_qty) AS abs_forecast_error FROM {_F}""",
    _F,
    doubles="actual_sales forecast_sales forecast_error abs_forecast_error",
)
for _name in ("dashboard_dataset", "published_dashboard"):
    oracle(_name, "SELECT * FROM dashboard", "dashboard", doubles=DASHBOARD_DOUBLES)
oracle(
    "dashboard_by_source",
    dashboard_sql("model_source"),
    "model_source",
    *_DASH,
    doubles=DASHBOARD_DOUBLES,
)
oracle(
    "sales_overview",
    """SELECT sales_date, SUM(revenue) AS revenue, SUM(quantity) AS quantity,
  COUNT(DISTINCT invoice) AS invoices_cnt, COUNT(DISTINCT stock_code) AS active_products
FROM fact WHERE sales_date IS NOT NULL GROUP BY sales_date""",
    "fact",
    doubles="revenue quantity",
)
_ERR = f"SUM(ABS({ACTUAL} - {PREDICTED})) AS abs_error"
oracle(
    "error_by_market",
    f"""SELECT *, abs_error / NULLIF(SUM(abs_error) OVER (), 0) AS abs_error_share
FROM (SELECT market_id, {FOUR}, {_ERR} FROM {_F} GROUP BY market_id)""",
    _F,
    doubles="wmape mae rmse bias abs_error abs_error_share",
)
cte(
    "segmented",
    f"""SELECT r.*, s.abc_xyz_segment FROM {_F} r
LEFT JOIN segments s ON s.stock_code = r.stock_code AND s.market_id = r.market_id""",
    _F,
    "segments",
)
oracle(
    "error_by_segment",
    f"SELECT abc_xyz_segment, {FOUR}, {_ERR} FROM segmented GROUP BY abc_xyz_segment",
    "segmented",
    doubles="wmape mae rmse bias abs_error",
)
oracle(
    "error_by_product",
    f"SELECT stock_code, {FOUR}, {_ERR} FROM {_F} GROUP BY stock_code ORDER BY abs_error DESC, stock_code LIMIT 20",
    _F,
    doubles="wmape mae rmse bias abs_error",
)
oracle(
    "daily_actual_vs_forecast",
    f"SELECT sales_date, SUM({ACTUAL}) AS actual_sales, SUM({PREDICTED}) AS forecast_sales "
    f"FROM {_F} GROUP BY sales_date",
    _F,
    doubles="actual_sales forecast_sales",
)
oracle(
    "abc_xyz_matrix",
    "SELECT abc_segment, "
    + ", ".join(f"COUNT(CASE WHEN xyz_segment = '{x}' THEN 1 END) AS {x}_groups" for x in "XYZ")
    + ", "
    + ", ".join(
        f"COALESCE(SUM(CASE WHEN xyz_segment = '{x}' THEN revenue END), 0) "
        f"/ (SELECT SUM(revenue) FROM segments) AS {x}_revenue_share"
        for x in "XYZ"
    )
    + " FROM segments GROUP BY abc_segment",
    "segments",
    doubles="X_revenue_share Y_revenue_share Z_revenue_share",
)
oracle(
    "risk_matrix",
    """SELECT p.market_id, s.abc_xyz_segment, COUNT(*) AS groups,
  AVG(CASE WHEN stockout_risk_flag THEN 1.0 ELSE 0.0 END) AS stockout_share,
  AVG(CASE WHEN overstock_risk_flag THEN 1.0 ELSE 0.0 END) AS overstock_share
FROM policy p LEFT JOIN segments s ON s.stock_code = p.stock_code AND s.market_id = p.market_id
GROUP BY p.market_id, s.abc_xyz_segment""",
    "policy",
    "segments",
    doubles="stockout_share overstock_share",
)
cte(
    "segment_scores",
    " UNION ALL ".join(
        f"SELECT s.abc_xyz_segment, '{name}' AS source, {metric_sql(ACTUAL, column)['wmape']} AS wmape "
        f"FROM held{YEAR} r LEFT JOIN segments s ON s.stock_code = r.stock_code AND s.market_id = r.market_id "
        f"WHERE {column} IS NOT NULL GROUP BY s.abc_xyz_segment"
        for name, column in (("model", "moving_average_28"), ("naive", "naive_last_value"))
    ),
    f"held{YEAR}",
    "segments",
)
oracle(
    "model_vs_baseline_by_segment",
    """SELECT *, FIRST_VALUE(source) OVER (PARTITION BY abc_xyz_segment ORDER BY wmape, source) AS best_source
FROM segment_scores""",
    "segment_scores",
    doubles="wmape",
)
oracle(
    "revenue_vs_error",
    """SELECT g.*, s.revenue FROM group_errors g
JOIN stats s ON s.stock_code = g.stock_code AND s.market_id = g.market_id""",
    "group_errors",
    "stats",
    doubles="wmape mae rmse bias revenue",
)
oracle(
    "top_revenue_products",
    """SELECT stock_code, SUM(revenue) AS revenue,
  SUM(revenue) / (SELECT SUM(revenue) FROM mart) AS revenue_share
FROM mart GROUP BY stock_code ORDER BY revenue DESC, stock_code LIMIT 10""",
    "mart",
    doubles="revenue revenue_share",
)
oracle(
    "dashboard_filters",
    """SELECT * FROM dashboard WHERE sales_date BETWEEN DATE '2001-01-01' AND DATE '2001-12-31'
  AND market_id IN ('NATION_1', 'NATION_2', 'NATION_3') AND abc_segment IN ('A', 'B')
  AND abs_forecast_error BETWEEN 5 AND 50""",
    "dashboard",
    doubles=DASHBOARD_DOUBLES,
)
oracle(
    "sql_chain",
    """SELECT f.stock_code, f.market_id, COUNT(*) AS rows_cnt, MAX(f.zero_sales_streak) AS streak,
  MAX(i.suggested_reorder_point) AS reorder_point
FROM features f JOIN policy i ON i.stock_code = f.stock_code AND i.market_id = f.market_id
GROUP BY f.stock_code, f.market_id""",
    "features",
    "policy",
    doubles="reorder_point",
)
