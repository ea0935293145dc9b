"""Registered queries of the warehouse operators, each with the SQL that gives the same rows.

The driver's tables carry no nulls, so a `dirty` raw table is made from lineitem and orders by
expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed import COLUMN_MAPPING, REASON_CANCELLED, REASON_NO_CUSTOMER, REASON_PRICE, REASON_QUANTITY, SENTINELS
from .functions.dates import clean_dates
from .functions.numbers import number_text
from .operators import aggregate, archive, clean, distinct, quality, sequence, writes
from .operators.profile import profile, roles_table
from .plans import steps
from .plans.steps import since
from .schema import DATED, DWD, LAYOUTS, ODS, RuntimeSchema
from .session import scratch
from .sources.files import read_orders, read_unknown
from .sources.warehouse import Layout, Warehouse, Watch
from .streaming import intake
from .streaming import open_days as days_open

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_DIRTY = """
SELECT concat(CASE WHEN o_orderstatus = 'P' AND l_linenumber = 1 THEN 'C' ELSE '' END, CAST(l_orderkey AS {text})) AS invoice_no,
  CAST(l_partkey AS {text}) AS stock_code,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_returnflag END AS description,
  CASE WHEN l_partkey % 89 = 0 THEN NULL ELSE CAST(CASE WHEN l_linenumber = 7 THEN -l_quantity WHEN l_linenumber = 6 THEN 0 ELSE l_quantity END AS INT) END AS quantity,
  l_shipdate AS invoice_date,
  CAST(CASE WHEN l_suppkey % 50 = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(10, 4)) AS unit_price,
  CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE CAST(o_custkey AS {text}) END AS customer_id,
  l_linestatus AS country
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
DIRTY_SQL = _DIRTY.format(text="VARCHAR", lineitem="lineitem", orders="orders")
_REASON_SQL = f"""CASE WHEN coalesce(starts_with(invoice_no, 'C'), false) THEN '{REASON_CANCELLED}' WHEN customer_id IS NULL THEN '{REASON_NO_CUSTOMER}'
  WHEN quantity <= 0 THEN '{REASON_QUANTITY}' WHEN quantity IS NOT NULL AND unit_price <= 0 THEN '{REASON_PRICE}' END"""
_ODS_COLUMNS = "invoice_no, stock_code, description, quantity, invoice_date, unit_price, customer_id, country"
_CLEAN_SQL = f"SELECT *, CAST(quantity * unit_price AS DECIMAL(12, 4)) AS order_amount FROM dirty WHERE {_REASON_SQL} IS NULL AND quantity > 0 AND unit_price > 0"
_ROUND = "round_even({} * 10000, 0) / 10000"
RULES = RuntimeSchema(
    cancel_rules=[{"column": "invoice_no", "method": "string_startswith", "value": "C", "reason": REASON_CANCELLED}],
    required_columns=[{"column": "customer_id", "reason": REASON_NO_CUSTOMER}],
    validations=[{"column": "quantity", "operator": "gt", "value": 0, "reason": REASON_QUANTITY}, {"column": "unit_price", "operator": "gt", "value": 0, "reason": REASON_PRICE}],
    computed_columns=[{"name": "order_amount", "expression": "quantity * unit_price"}],
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw orders with missing and impossible values. Columns are pruned into both scans; the join is by order key."""
    return spark.sql(_DIRTY.format(text="STRING", lineitem="{lineitem}", orders="{orders}"), lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))


def _register(sql: str, dirty_view: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH dirty AS ({DIRTY_SQL}), clean AS ({_CLEAN_SQL}) {sql}" if dirty_view else sql
        return f

    return add


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_first_match(dirty(spark, sf_dir))[0]


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = aggregate.daily_sales(_clean(spark, sf_dir), "invoice_date")
    return daily.withColumn("daily_sales_amount", F.col("daily_sales_amount").cast("decimal(18,4)"))


_DAILY_SQL = f"""SELECT CAST(invoice_date AS DATE) AS stat_date, count(DISTINCT invoice_no) AS daily_order_count, count(DISTINCT customer_id) AS daily_customer_count,
  CAST(coalesce(sum(order_amount), 0) AS DECIMAL(18, 4)) AS daily_sales_amount,
  {_ROUND.format('(CAST(sum(order_amount) AS DOUBLE) / count(DISTINCT invoice_no))')} AS daily_avg_order_amount
  FROM clean WHERE invoice_date IS NOT NULL GROUP BY 1"""


@_register(f"SELECT {_ODS_COLUMNS} FROM dirty", True)
def ods_scan(spark, sf_dir):
    return dirty(spark, sf_dir)


@_register(f"SELECT {_ODS_COLUMNS} FROM dirty WHERE invoice_date >= TIMESTAMP '1997-06-01'", True)
def ods_since(spark, sf_dir):
    return since(dirty(spark, sf_dir), "invoice_date", "1997-06-01")


@_register(f"SELECT count(*) AS total, {', '.join(f'count(*) - count({c}) AS {c}_nulls' for c in _ODS_COLUMNS.split(', ') if c != 'description')} FROM dirty", True)
def quality_nulls(spark, sf_dir):
    return quality.null_counts(dirty(spark, sf_dir), [c for c in _ODS_COLUMNS.split(", ") if c != "description"])


@_register("SELECT count(*) AS total, count(DISTINCT invoice_no) AS unique_keys, count(*) - count(DISTINCT invoice_no) AS duplicate_rows FROM dirty", True)
def quality_duplicates(spark, sf_dir):
    return quality.duplicates(dirty(spark, sf_dir), "invoice_no")


@_register("SELECT count(*) FILTER (unit_price < 0) AS negative_price, count(*) FILTER (unit_price = 0) AS zero_price, count(*) FILTER (quantity < 0) AS negative_quantity, count(*) FILTER (quantity = 0) AS zero_quantity FROM dirty", True)
def quality_abnormal(spark, sf_dir):
    return quality.abnormal_amounts(dirty(spark, sf_dir))


@_register(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, (count(*) - count({c})) / nullif(CAST(count(*) AS DOUBLE), 0) AS null_rate FROM dirty" for c in ("description", "stock_code", "country")), True)
def quality_null_rates(spark, sf_dir):
    return quality.null_rates(dirty(spark, sf_dir), ["description", "stock_code", "country"])


@_register(
    """SELECT count(*) AS total, count(*) - count(quantity) AS quantity_nulls, count(*) - count(description) AS description_nulls, count(DISTINCT invoice_no) AS unique_keys,
  CASE WHEN (count(*) - count(description)) / CAST(count(*) AS DOUBLE) > 0.3 THEN 'description' ELSE '' END AS warned,
  CASE WHEN count(*) = 0 THEN 'failed' WHEN count(*) > least(count(invoice_no), count(quantity), count(invoice_date), count(unit_price)) THEN 'warning' ELSE 'passed' END AS status FROM dirty""",
    True,
)
def quality_verdict(spark, sf_dir):
    found = quality.classic_check(dirty(spark, sf_dir))
    return found.select("total", "quantity_nulls", "description_nulls", "unique_keys", F.array_join("warnings", ",").alias("warned"), "status")


@_register("SELECT count(*) - count(event_type) AS event_type_nulls, count(*) AS total, count(DISTINCT event_id) AS unique_keys, count(*) - count(DISTINCT event_id) AS duplicate_rows, 'passed' AS status FROM events")
def quality_by_schema(spark, sf_dir):
    schema = RuntimeSchema(id_columns=["event_id"], quality_critical_nulls=["event_type"], quality_null_rate_columns=[])
    return quality.schema_check(table(spark, sf_dir, "events"), schema).select("event_type_nulls", "total", "unique_keys", "duplicate_rows", "status")


@_register("SELECT max(ts) AS newest, date_diff('day', CAST(max(ts) AS DATE), DATE '2030-01-01') AS age_days FROM events")
def quality_freshness(spark, sf_dir):
    return quality.stale_days(table(spark, sf_dir, "events"), "ts", F.lit("2030-01-01").cast("date")).withColumn("age_days", F.col("age_days").cast("long"))


@_register(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (abs({c} - m) > 2 * s) AS outliers FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)" for c in ("l_quantity", "l_extendedprice"))
)
def quality_outliers(spark, sf_dir):
    return quality.outliers(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 2.0)


@_register("SELECT 'tax' AS rule, count(*) FILTER (NOT l_tax <= l_discount) AS violations FROM lineitem UNION ALL SELECT 'price', count(*) FILTER (NOT l_extendedprice >= l_quantity) FROM lineitem")
def quality_cross_columns(spark, sf_dir):
    return quality.violations(table(spark, sf_dir, "lineitem"), {"tax": F.col("l_tax") <= F.col("l_discount"), "price": F.col("l_extendedprice") >= F.col("l_quantity")})


@_register(f"SELECT {_ODS_COLUMNS}, order_amount FROM clean", True)
def clean_first_detail(spark, sf_dir):
    return _clean(spark, sf_dir)


@_register(f"SELECT {_ODS_COLUMNS}, {_REASON_SQL} AS rejected_reason FROM dirty WHERE {_REASON_SQL} IS NOT NULL", True)
def clean_first_rejected(spark, sf_dir):
    return clean.clean_first_match(dirty(spark, sf_dir))[1]


@_register(f"SELECT {_ODS_COLUMNS} FROM dirty WHERE {_REASON_SQL} IS NULL AND NOT coalesce(quantity > 0 AND unit_price > 0, false)", True)
def clean_first_lost(spark, sf_dir):
    return clean.clean_first_match(dirty(spark, sf_dir))[2]


_RULE_SQL = [("coalesce(starts_with(invoice_no, 'C'), false)", REASON_CANCELLED), ("customer_id IS NULL", REASON_NO_CUSTOMER), ("coalesce(quantity <= 0, false)", REASON_QUANTITY), ("coalesce(unit_price <= 0, false)", REASON_PRICE)]


@_register(f"SELECT {_ODS_COLUMNS}, CAST(quantity * unit_price AS DECIMAL(21, 4)) AS order_amount FROM dirty WHERE NOT ({' OR '.join(f'({c})' for c, _ in _RULE_SQL)})", True)
def clean_all_detail(spark, sf_dir):
    return clean.clean_all_matches(dirty(spark, sf_dir), RULES)[0]


@_register(" UNION ALL ".join(f"SELECT {_ODS_COLUMNS}, '{r}' AS rejected_reason FROM dirty WHERE {c}" for c, r in _RULE_SQL), True)
def clean_all_rejected(spark, sf_dir):
    return clean.clean_all_matches(dirty(spark, sf_dir), RULES)[1]


@_register(f"SELECT rejected_reason, count(*) AS n FROM ({' UNION ALL '.join(f'''SELECT '{r}' AS rejected_reason FROM dirty WHERE {c}''' for c, r in _RULE_SQL)}) GROUP BY 1", True)
def rejected_archive(spark, sf_dir):
    return clean.clean_all_matches(dirty(spark, sf_dir), RULES)[1].groupBy("rejected_reason").agg(F.count(F.lit(1)).alias("n"))


def _rejected(df: DataFrame, **rules) -> DataFrame:
    return clean.clean_all_matches(df, RuntimeSchema(**rules))[1]


@_register(f"SELECT {_ODS_COLUMNS}, 'r' AS rejected_reason FROM dirty WHERE coalesce(starts_with(invoice_no, 'C'), false)", True)
def rule_startswith(spark, sf_dir):
    return _rejected(dirty(spark, sf_dir), cancel_rules=[{"column": "invoice_no", "method": "string_startswith", "value": "C", "reason": "r"}])


@_register("SELECT *, 'r' AS rejected_reason FROM orders WHERE lower(o_orderstatus) = 'f'")
def rule_string_equals(spark, sf_dir):
    return _rejected(table(spark, sf_dir, "orders"), cancel_rules=[{"column": "o_orderstatus", "method": "string_equals", "value": "f", "reason": "r"}])


@_register("SELECT *, 'r' AS rejected_reason FROM customer WHERE c_nationkey = 7")
def rule_column_equals(spark, sf_dir):
    rules = [{"column": "c_nationkey", "method": "column_equals", "value": 7, "reason": "r"}, {"column": "c_nationkey", "method": "column_equals", "value": "8", "reason": "never"}]
    return _rejected(table(spark, sf_dir, "customer"), cancel_rules=rules)


@_register(f"SELECT {_ODS_COLUMNS}, 'description 为空' AS rejected_reason FROM dirty WHERE description IS NULL", True)
def required_null(spark, sf_dir):
    return _rejected(dirty(spark, sf_dir), required_columns=["description"])


def _validate(op: str, negated: str) -> None:
    def run(spark, sf_dir):
        return _rejected(dirty(spark, sf_dir), validations=[{"column": "quantity", "operator": op, "value": 10, "reason": op}])

    run.__name__ = f"validate_{op}"
    _register(f"SELECT {_ODS_COLUMNS}, '{op}' AS rejected_reason FROM dirty WHERE {negated}", True)(run)


for _op, _negated in (("gt", "quantity <= 10"), ("gte", "quantity < 10"), ("lt", "quantity >= 10"), ("lte", "quantity > 10"), ("eq", "quantity IS DISTINCT FROM 10"), ("neq", "quantity = 10")):
    _validate(_op, _negated)


@_register("SELECT *, 'c_acctbal gte 0' AS rejected_reason FROM customer WHERE c_acctbal < 0")
def validate_balance(spark, sf_dir):
    return _rejected(table(spark, sf_dir, "customer"), validations=[{"column": "c_acctbal", "operator": "gte", "value": 0}])


def _computed(spark, sf_dir, *columns: tuple[str, str]) -> DataFrame:
    schema = RuntimeSchema(computed_columns=[{"name": n, "expression": e} for n, e in columns])
    return clean.with_computed(table(spark, sf_dir, "lineitem"), schema).select("l_orderkey", "l_linenumber", *[n for n, _ in columns])


@_register("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS amount FROM lineitem")
def computed_amount(spark, sf_dir):
    return _computed(spark, sf_dir, ("amount", "l_quantity * l_extendedprice"))


@_register("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def computed_chain(spark, sf_dir):
    return _computed(spark, sf_dir, ("net", "l_extendedprice * (1 - l_discount)"), ("gross", "net * (1 + l_tax)"))


@_register("SELECT l_orderkey, l_linenumber, l_quantity / nullif(CAST(l_linenumber - 1 AS DOUBLE), 0) AS share FROM lineitem")
def computed_div(spark, sf_dir):
    return _computed(spark, sf_dir, ("share", "l_quantity / (l_linenumber - 1)"))


@_register(_DAILY_SQL, True)
def daily_sales(spark, sf_dir):
    return _daily(spark, sf_dir)


def _money(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles as decimals, so that sums do not depend on the order of rows."""
    return df.withColumns({c: F.col(c).cast("decimal(18,4)") for c in columns})


@_register(
    f"""SELECT CAST(l_shipdate AS DATE) AS _stat_date, CAST(sum(CAST(l_quantity AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS l_quantity_sum, {_ROUND.format('(CAST(sum(CAST(l_quantity AS DECIMAL(18, 4))) AS DOUBLE) / count(*))')} AS l_quantity_avg,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS l_extendedprice_sum, {_ROUND.format('(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) / count(*))')} AS l_extendedprice_avg FROM lineitem GROUP BY 1"""
)
def adaptive_daily(spark, sf_dir):
    return _adaptive(_money(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), ["l_shipdate"], ["l_quantity", "l_extendedprice"])


def _adaptive(df: DataFrame, dates: list[str], metrics: list[str]) -> DataFrame:
    return aggregate.adaptive(df, RuntimeSchema(date_columns=dates, numeric_columns=metrics)).result


@_register(f"SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS o_totalprice_sum, {_ROUND.format('(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 4))) AS DOUBLE) / count(*))')} AS o_totalprice_avg FROM orders")
def adaptive_global(spark, sf_dir):
    return _adaptive(_money(table(spark, sf_dir, "orders"), "o_totalprice"), [], ["o_totalprice"])


@_register("SELECT min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, 4 AS metrics FROM lineitem")
def adaptive_figures(spark, sf_dir):
    rows = _money(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return aggregate.adaptive_figures(aggregate.adaptive(rows, RuntimeSchema(date_columns=["l_shipdate"], numeric_columns=["l_quantity", "l_extendedprice"])))


@_register(
    f"""SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS _stat_date, CAST(sum(CAST(l_quantity AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS l_quantity_sum,
  {_ROUND.format('(CAST(sum(CAST(l_quantity AS DECIMAL(18, 4))) AS DOUBLE) / count(*))')} AS l_quantity_avg FROM lineitem GROUP BY 1"""
)
def adaptive_null_group(spark, sf_dir):
    rows = _money(table(spark, sf_dir, "lineitem"), "l_quantity").withColumn("day", F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")))
    return _adaptive(rows, ["day"], ["l_quantity"])


@_register("SELECT CAST(ts AS DATE) AS _stat_date, CAST(sum(user_id) AS BIGINT) AS user_id_sum, round_even(avg(user_id) * 10000, 0) / 10000 AS user_id_avg, count(DISTINCT event_type) AS event_type_distinct FROM events GROUP BY 1")
def categorical_distinct(spark, sf_dir):
    schema = RuntimeSchema(date_columns=["ts"], numeric_columns=["user_id"], categorical_columns=["event_type"])
    return aggregate.adaptive(table(spark, sf_dir, "events"), schema, categories=True, cardinality={"event_type": 10}).result


_MONTHLY_SQL = "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS o_totalprice FROM orders GROUP BY 1"


def _monthly(spark, sf_dir):
    return aggregate.monthly_rollup(_money(table(spark, sf_dir, "orders"), "o_totalprice"), "o_orderdate", "o_totalprice")


@_register(_MONTHLY_SQL)
def monthly_rollup(spark, sf_dir):
    return _monthly(spark, sf_dir)


@_register(f"WITH m AS ({_MONTHLY_SQL}) SELECT (SELECT month FROM m ORDER BY o_totalprice DESC, month LIMIT 1) AS peak_month, (SELECT month FROM m ORDER BY o_totalprice, month LIMIT 1) AS trough_month")
def peak_month(spark, sf_dir):
    return aggregate.peak_and_trough(_monthly(spark, sf_dir), "o_totalprice")


@_register(
    f"""SELECT count(*) AS days, CAST(sum(daily_sales_amount) AS DECIMAL(28, 4)) AS sales, CAST(sum(daily_order_count) AS BIGINT) AS orders, CAST(sum(daily_customer_count) AS BIGINT) AS customers,
  max(daily_sales_amount) AS most_sales, max(daily_order_count) AS most_orders, CAST(sum(daily_sales_amount) AS DOUBLE) / count(*) AS mean_sales,
  coalesce(CAST(sum(daily_sales_amount) AS DOUBLE) / nullif(CAST(sum(daily_order_count) AS DOUBLE), 0), 0) AS order_value FROM ({_DAILY_SQL})""",
    True,
)
def grand_summary(spark, sf_dir):
    return aggregate.grand_totals(_daily(spark, sf_dir))


def _by_day(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("o_orderdate").cast("date").alias("stat_date")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("most"))


@_register(
    """WITH old AS (SELECT CAST(o_orderdate AS DATE) AS stat_date, count(*) AS n, max(o_orderkey) AS most FROM orders WHERE o_orderdate < TIMESTAMP '1995-07-01' GROUP BY 1),
  fresh AS (SELECT CAST(o_orderdate AS DATE) AS stat_date, count(*) AS n, max(o_orderkey) AS most FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderkey % 2 = 0 GROUP BY 1)
  SELECT * FROM old WHERE stat_date NOT IN (SELECT stat_date FROM fresh) UNION ALL SELECT * FROM fresh"""
)
def upsert_daily(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = _by_day(orders.where("o_orderdate < timestamp_ntz '1995-07-01'"))
    return writes.upsert(old, _by_day(orders.where("o_orderdate >= timestamp_ntz '1995-01-01' and o_orderkey % 2 = 0")), "stat_date")


@_register(
    """WITH batch AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1994-03-01' AND TIMESTAMP '1996-09-30' AND o_orderkey % 3 = 0)
  SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate NOT BETWEEN (SELECT min(o_orderdate) FROM batch) AND (SELECT max(o_orderdate) FROM batch) UNION ALL SELECT * FROM batch"""
)
def range_replace(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    batch = orders.where("o_orderdate between timestamp_ntz '1994-03-01' and timestamp_ntz '1996-09-30' and o_orderkey % 3 = 0")
    return writes.replace_range(orders, batch, "o_orderdate")


@_register("SELECT l_orderkey, l_linenumber, l_quantity AS quantity FROM lineitem")
def numeric_string_clean(spark, sf_dir):
    text = F.concat(F.lit(" $"), F.col("l_quantity").cast("decimal(18,2)").cast("string"), F.lit("% "))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", number_text(text).alias("quantity"))


@_register("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS day FROM orders")
def date_parse_lenient(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("31/31/31")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return clean_dates(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("day")), ["day"])


@_register("SELECT user_id AS run_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def runlog_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"), "event_id")
    return writes.latest_runs(events).select("run_id", "status", "event_id")


@_register(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IN {SENTINELS}) AS hits FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey")))
def sentinel_scan(spark, sf_dir):
    return aggregate.sentinels(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"], SENTINELS)


def _roles_sql(table_: str, **roles: str) -> str:
    """Roles from the share of different values among the known ones, where that decides: of whole numbers and of texts without a date's or an id's name."""
    rule = {"whole": "CASE WHEN d > 0.95 * n THEN 'id' ELSE 'numeric' END", "text": "CASE WHEN d > 0.98 * n THEN 'id' ELSE 'categorical' END"}
    one = "SELECT '{c}' AS column_name, {r} AS role, n AS known, d AS different FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS d FROM {t})"
    return " UNION ALL ".join(one.format(c=c, r=rule.get(r, f"'{r}'"), t=table_) for c, r in roles.items())


@_register(_roles_sql("customer", c_custkey="whole", c_name="text", c_nationkey="whole", c_acctbal="numeric", c_mktsegment="text"))
def profile_roles(spark, sf_dir):
    return roles_table(table(spark, sf_dir, "customer"), None)


@_register(_roles_sql("events", event_id="whole", ts="date", user_id="whole", event_type="text", value="numeric", props="text"))
def profile_roles_events(spark, sf_dir):
    return roles_table(table(spark, sf_dir, "events"), None)


@_register(f"SELECT column_name, role, known FROM ({_roles_sql('lineitem', l_orderkey='whole', l_partkey='whole', l_quantity='numeric', l_shipdate='date', l_returnflag='text', l_linestatus='text')})")
def profile_one_scan(spark, sf_dir):
    """Roles by a sample's values and the figures of all rows, in one scan."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    return roles_table(rows, whole=True).select("column_name", "role", "known")


# Files and tables: what is written by Spark is read back through the file layer, the store and the steps.

_FILE_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@_register(f"SELECT {_FILE_COLUMNS} FROM orders")
def file_folder(spark, sf_dir):
    """A folder of delimited files with a header each."""
    path = scratch(spark, "folder")
    table(spark, sf_dir, "orders").select(*_FILE_COLUMNS.split(", ")).repartition(3).write.option("header", True).option("sep", ";").csv(path)
    return read_unknown(spark, path)


@_register("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 4 = 2 THEN n_regionkey END AS region FROM nation")
def file_layouts(spark, sf_dir):
    """One folder: columns in other orders, a title in one file, other separators, a column that one file alone has."""
    path, nation = scratch(spark, "layouts"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    shapes = [(["id", "name"], ",", None), (["name", "id"], ";", None), (["region", "id", "name"], "\t", "Nations by region"), (["id", "name"], "|", None)]
    for k, (columns, sep, title) in enumerate(shapes):
        own = nation.where(F.col("id") % 4 == k)
        lines = own.select(F.concat(F.lit("2"), F.lpad("id", 3, "0")).alias("at"), F.concat_ws(sep, *columns).alias("line"))
        ahead = spark.createDataFrame([("1", sep.join(columns)), *([("0", title)] if title else [])], "at string, line string")
        lines.unionByName(ahead).coalesce(1).sortWithinPartitions("at").select("line").write.mode("append").text(path)
    return read_unknown(spark, path)


@_register("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Zürich ' || chr(65533) ELSE c_name END AS name FROM customer")
def file_replacement_signs(spark, sf_dir):
    """Text that holds replacement signs is read as it is."""
    path = scratch(spark, "signs")
    name = F.when(F.col("c_custkey") % 5 == 0, F.lit("Zürich \ufffd")).otherwise(F.col("c_name"))
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name")).write.option("header", True).csv(path)
    return read_unknown(spark, path)


@_register("SELECT c_custkey AS id, 'Zoë Müller-' || c_name AS name, c_nationkey AS nation FROM customer")
def file_encodings(spark, sf_dir):
    """Files of three encodings in one folder, none of them declared."""
    path, rows = scratch(spark, "encodings"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Zoë Müller-"), "c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    for k, encoding in enumerate(("ISO-8859-1", "UTF-16LE", "UTF-8")):
        rows.where(F.col("id") % 3 == k).repartition(2).write.mode("append").option("header", True).option("encoding", encoding).csv(path)
    return read_unknown(spark, path)


def _text_file(spark: SparkSession, rows: DataFrame, ahead: list[str], behind: list[str], encoding: str = "UTF-8") -> str:
    """One delimited file: lines, the rows in the order of their first column, lines."""
    path = scratch(spark, "file")
    lines = rows.select(F.col(rows.columns[0]).cast("double").alias("at"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))
    more = spark.createDataFrame([(-2.0 + i / 10, x) for i, x in enumerate(ahead)] + [(1e18 + 1e6 * i, x) for i, x in enumerate(behind)], "at double, line string")
    lines.unionByName(more).coalesce(1).sortWithinPartitions("at").select("line").write.option("encoding", encoding).text(path)
    return path


@_register("SELECT r_regionkey, r_name FROM region")
def file_title_and_total(spark, sf_dir):
    """A title line before the header and a total at the end are no rows; NA is missing."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.lit("NA").alias("gone"), F.lit("").alias("empty"))
    return read_unknown(spark, _text_file(spark, rows, ["Regions of the year", "r_regionkey,r_name,gone,empty"], ["Total,,,", "Total,7,,"]))


@_register("SELECT n_nationkey AS col_0, n_name AS col_1, n_regionkey AS col_2 FROM nation WHERE n_nationkey % 3 <> 0")
def file_headerless(spark, sf_dir):
    """No header; rows with too many fields are left out."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 3 == 0, F.lit("1,2,3")).otherwise(F.col("n_regionkey").cast("string")))
    return read_unknown(spark, _text_file(spark, rows.withColumn("n_nationkey", F.col("n_nationkey")).orderBy("n_nationkey").withColumnRenamed(rows.columns[2], "last"), ["100,SOMEWHERE,7"], [])).where("col_0 < 100")


def _orders_file(spark: SparkSession, sf_dir: str) -> str:
    """The raw table as a delimited file under its source names, dates as month/day/year."""
    path = scratch(spark, "orders")
    rows = dirty(spark, sf_dir).withColumn("invoice_date", F.date_format("invoice_date", "M/d/yyyy H:mm"))
    rows.select(*[F.col(c).alias(n) for n, c in COLUMN_MAPPING.items()]).write.option("header", True).csv(path)
    return path


@_register(f"SELECT {_ODS_COLUMNS} FROM dirty", True)
def file_orders(spark, sf_dir):
    """Eight fixed columns, ids as text, strict dates."""
    return steps.to_ods(read_orders(spark, _orders_file(spark, sf_dir)))


def _store(spark: SparkSession, dated: dict[str, str] | None = None, **layouts: Layout) -> Warehouse:
    return Warehouse(spark, scratch(spark, "warehouse"), dated, layouts=layouts)


@_register("SELECT o_orderkey, o_custkey FROM orders")
def store_append(spark, sf_dir):
    store, rows = _store(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    store.create("t", rows.schema)
    for part in (0, 1):
        store.append("t", rows.where(F.col("o_orderkey") % 2 == part).withColumn("o_custkey", F.col("o_custkey").cast("string")))
    return store.read("t")


@_register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 = 3")
def store_replace(spark, sf_dir):
    store, rows = _store(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    store.append("t", rows)
    store.replace("t", rows.where("o_orderkey % 7 = 3"))
    return store.read("t")


@_register(ORACLE_SQL["range_replace"])
def store_range_replace(spark, sf_dir):
    """On a table partitioned by month: the months of the batch alone are rewritten."""
    store = _store(spark, {"t": "o_orderdate"})
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    store.append("t", orders)
    store.replace_range("t", orders.where("o_orderdate between timestamp_ntz '1994-03-01' and timestamp_ntz '1996-09-30' and o_orderkey % 3 = 0"), "o_orderdate")
    return store.read("t").select("o_orderkey", "o_orderdate")


@_register(ORACLE_SQL["upsert_daily"])
def store_upsert(spark, sf_dir):
    store, orders = _store(spark), table(spark, sf_dir, "orders")
    store.upsert("t", _by_day(orders.where("o_orderdate < timestamp_ntz '1995-07-01'")), "stat_date")
    store.upsert("t", _by_day(orders.where("o_orderdate >= timestamp_ntz '1995-01-01' and o_orderkey % 2 = 0")), "stat_date")
    return store.read("t")


@_register("SELECT r_regionkey AS k, r_name AS name FROM region")
def store_dynamic_load(spark, sf_dir):
    store = _store(spark)
    store.append("t", table(spark, sf_dir, "nation"))
    store.dynamic_load("t", table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))
    return store.read("t")


def _transformed(spark: SparkSession, sf_dir: str) -> Warehouse:
    store = _store(spark)
    store.create("ods_orders", ODS)
    store.replace("ods_orders", dirty(spark, sf_dir))
    done = steps.transform(store)
    if done["status"] != "success":
        raise RuntimeError(done["error"])
    return store


@_register(f"SELECT {_ODS_COLUMNS}, order_amount FROM clean", True)
def step_transform(spark, sf_dir):
    return _transformed(spark, sf_dir).read("dwd_orders").drop("etl_time")


@_register(f"SELECT {_REASON_SQL} AS rejected_reason, count(*) AS n FROM dirty WHERE {_REASON_SQL} IS NOT NULL GROUP BY 1", True)
def step_rejected(spark, sf_dir):
    return _transformed(spark, sf_dir).read("rejected_orders").groupBy("rejected_reason").agg(F.count(F.lit(1)).alias("n"))


@_register(
    f"""SELECT 'customers' AS run_id, 'r' AS rejected_reason, c_custkey AS id, c_name AS name, CAST(NULL AS DECIMAL(10, 4)) AS price, CAST(NULL AS TIMESTAMP) AS at FROM customer WHERE c_nationkey = 7
  UNION ALL SELECT 'orders', {_REASON_SQL}, CAST(replace(invoice_no, 'C', '') AS BIGINT), NULL, unit_price, invoice_date FROM dirty WHERE {_REASON_SQL} IS NOT NULL""",
    True,
)
def archive_two_runs(spark, sf_dir):
    """Rejected rows of two runs with other columns; the second is run twice, and replaces its own."""
    store, now = _store(spark), datetime(2024, 1, 1)
    customers = _rejected(table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey").cast("long")).withColumn("name", F.col("c_name")), cancel_rules=[{"column": "c_nationkey", "method": "column_equals", "value": 7, "reason": "r"}])
    orders = clean.clean_first_match(dirty(spark, sf_dir))[1].withColumn("id", F.replace("invoice_no", F.lit("C"), F.lit("")).cast("long"))
    steps.archive(store, customers, "customers", now)
    for rows in (orders.limit(10), orders):
        steps.archive(store, rows.select("id", F.col("unit_price").alias("price"), F.col("invoice_date").alias("at"), "rejected_reason"), "orders", now)
    return archive.unfolded(store.read("rejected_orders"), {"id": "bigint", "name": "string", "price": "decimal(10,4)", "at": "timestamp_ntz"})


@_register(f"SELECT {_REASON_SQL} AS rejected_reason, sum(unit_price) AS price, min(invoice_date) AS first FROM dirty WHERE {_REASON_SQL} IS NOT NULL GROUP BY 1", True)
def archive_by_reason(spark, sf_dir):
    """Figures over archived rows, from their fields."""
    rows = _transformed(spark, sf_dir).read("rejected_orders")
    return rows.groupBy("rejected_reason").agg(F.sum(archive.field("unit_price", "decimal(10,4)")).cast("decimal(38,4)").alias("price"), F.min(archive.field("invoice_date", "timestamp_ntz")).alias("first"))


def _catalogued(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Clean detail by month and customer, and customers, both in buckets by customer."""
    store = _store(spark, {"dwd_orders": "invoice_date"}, dwd_orders=LAYOUTS["dwd_orders"], customers=Layout(bucketed="customer_id"))
    store.append("dwd_orders", _clean(spark, sf_dir).select("invoice_no", "stock_code", "quantity", "invoice_date", "customer_id", "order_amount"))
    store.append("customers", table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), "c_name", "c_nationkey"))
    return store


@_register("SELECT c_name, c_nationkey, count(*) AS lines, sum(order_amount) AS amount FROM clean JOIN customer ON customer_id = CAST(c_custkey AS VARCHAR) GROUP BY c_name, c_nationkey, customer_id", True)
def catalog_customers(spark, sf_dir):
    """A join and a sum by customer over bucketed tables: no shuffle."""
    store = _catalogued(spark, sf_dir)
    by = store.read("dwd_orders").join(store.read("customers"), "customer_id").groupBy("customer_id", "c_name", "c_nationkey")
    return by.agg(F.count(F.lit(1)).alias("lines"), F.sum("order_amount").cast("decimal(38,4)").alias("amount")).drop("customer_id")


@_register("SELECT invoice_no, stock_code, quantity FROM clean WHERE invoice_no IN (SELECT max(invoice_no) FROM clean)", True)
def catalog_invoice(spark, sf_dir):
    """The lines of one invoice, found by the files' Bloom filters."""
    rows = _catalogued(spark, sf_dir).read("dwd_orders")
    wanted = rows.agg(F.max("invoice_no")).first()[0]
    return rows.where(F.col("invoice_no") == F.lit(wanted)).select("invoice_no", "stock_code", "quantity")


@_register("SELECT 'customers' AS name, 3 AS columns, count(*) AS rows FROM customer UNION ALL SELECT 'dwd_orders', 6, count(*) FROM clean", True)
def catalog_tables(spark, sf_dir):
    """The catalogue's tables with their columns, and their rows."""
    store = _catalogued(spark, sf_dir)
    counted = [store.read(n).agg(F.lit(n).alias("name"), F.lit(c).alias("columns"), F.count(F.lit(1)).alias("rows")) for n, c in store.tables()]
    return reduce(DataFrame.unionByName, counted)


@_register("SELECT CAST(invoice_date AS DATE) AS day, count(*) AS lines FROM clean WHERE invoice_date >= TIMESTAMP '1996-02-10' AND invoice_date < TIMESTAMP '1996-03-05' GROUP BY 1", True)
def catalog_days(spark, sf_dir):
    """Days of a dated table: other months' partitions are not read."""
    span = _catalogued(spark, sf_dir).between("dwd_orders", "1996-02-10", "1996-03-05")
    return span.groupBy(F.col("invoice_date").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("lines"))


@_register(f"SELECT * REPLACE (CAST(daily_avg_order_amount AS DECIMAL(18, 4)) AS daily_avg_order_amount) FROM ({_DAILY_SQL})", True)
def step_aggregate(spark, sf_dir):
    store = _transformed(spark, sf_dir)
    steps.aggregate_daily(store)
    return store.read("dws_sales_daily").drop("etl_time")


@_register("SELECT CAST(ts AS DATE) AS _stat_date, round_even(sum(value) * 100, 0) / 100 AS value_sum, count(DISTINCT event_type) AS event_type_distinct FROM events GROUP BY 1")
def step_auto(spark, sf_dir):
    """A table of unknown shape: roles by profile, days, sums, distinct counts of the categories with few values."""
    events = table(spark, sf_dir, "events").drop("props", "event_id", "user_id")
    store, schema = _store(spark), profile(events)
    store.dynamic_load("ods_orders", events)
    for step in (steps.auto_transform, steps.auto_aggregate):
        step(store, schema)
    return store.read("dws_adaptive").select("_stat_date", (F.rint(F.col("value_sum") * 100) / 100).alias("value_sum"), "event_type_distinct")


@_register("SELECT event_type, window_start AS start, window_start + INTERVAL 1 DAY AS \"end\", count(*) AS rows FROM (SELECT *, date_trunc('day', ts) AS window_start FROM events) GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Event-time windows with a watermark, from a stream that reads the table's file once."""
    events = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("one"))
    path, out, state = (scratch(spark, n) for n in ("events", "windows", "state"))
    events.write.parquet(path)
    rows = intake.windowed(intake.read_stream(spark, path, events.schema), "ts", "one", "1 hour", "1 day", ["event_type"])
    # every row may be late for others, so the windows are put out as they stand at the end of the one batch
    query = rows.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("append").parquet(out)).option("checkpointLocation", state).trigger(once=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select("event_type", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "rows")


@_register(
    """SELECT count(*) AS total, count(*) - count(quantity) AS quantity_nulls, count(*) - count(description) AS description_nulls, count(*) FILTER (unit_price = 0) AS zero_price, count(*) FILTER (quantity < 0) AS negative_quantity,
  CASE WHEN (count(*) - count(description)) / CAST(count(*) AS DOUBLE) > 0.3 THEN 'description' ELSE '' END AS warned,
  CASE WHEN count(*) = 0 THEN 'failed' WHEN count(*) > least(count(invoice_no), count(quantity), count(invoice_date), count(unit_price)) THEN 'warning' ELSE 'passed' END AS status FROM dirty""",
    True,
)
def quality_while_loading(spark, sf_dir):
    """The check's figures, observed while the raw table is loaded."""
    store, watch = _store(spark, DATED), Watch(quality.classic_figures())
    store.create("ods_orders", ODS)
    store.replace("ods_orders", dirty(spark, sf_dir), watch)
    found = quality.classic_judged(watch.found)
    row = [found[c] for c in ("total", "quantity_nulls", "description_nulls", "zero_price", "negative_quantity")]
    return spark.createDataFrame([(*row, ",".join(found["warnings"]), found["status"])], "total long, quantity_nulls long, description_nulls long, zero_price long, negative_quantity long, warned string, status string")


@_register("SELECT strftime(invoice_date, '%Y-%m') AS span, country, count(DISTINCT customer_id) AS customers FROM clean GROUP BY 1, 2", True)
def customers_by_month(spark, sf_dir):
    """Different customers of each month and country, from bitmaps kept by day."""
    store, rows = _store(spark), _clean(spark, sf_dir)
    store.dynamic_load("daily_customers", distinct.daily_bitmaps(rows, F.col("invoice_date"), F.col("customer_id"), ("country",)))
    return distinct.merged_count(store.read("daily_customers"), F.date_format("day", "yyyy-MM"), ("country",), "customers")


@_register("SELECT true AS near, count(DISTINCT strftime(invoice_date, '%Y-%m')) AS months FROM clean", True)
def customers_estimated(spark, sf_dir):
    """Estimates from sketches kept by day lie within a twentieth of the counts, in every month."""
    rows = _clean(spark, sf_dir)
    month = F.date_format("day", "yyyy-MM")
    found = distinct.merged_estimate(distinct.daily_sketches(rows, F.col("invoice_date"), F.col("customer_id")), month, name="estimate")
    real = rows.groupBy(F.date_format("invoice_date", "yyyy-MM").alias("span")).agg(F.countDistinct("customer_id").alias("customers"))
    both = found.join(real, "span")
    return both.agg(F.bool_and(F.abs(F.col("estimate") - F.col("customers")) <= F.col("customers") * 0.05).alias("near"), F.count(F.lit(1)).alias("months"))


def _fence_sql(column: str, source: str) -> str:
    inner = f"SELECT quantile_disc(CAST({column} AS DOUBLE), 0.25) AS a, quantile_disc(CAST({column} AS DOUBLE), 0.75) AS b FROM {source}"
    return f"SELECT '{column}' AS column_name, a - 0.25 * (b - a) AS low, b + 0.25 * (b - a) AS high, count(*) FILTER ({column} < a - 0.25 * (b - a) OR {column} > b + 0.25 * (b - a)) AS outliers FROM {source}, ({inner}) GROUP BY a, b"


@_register(" UNION ALL ".join(_fence_sql(c, "lineitem") for c in ("l_linenumber", "l_quantity")))
def quality_quantile_outliers(spark, sf_dir):
    """Columns of few values, whose quartiles do not hang on a summary's last rows."""
    return quality.quantile_outliers(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_quantity"], 0.25)


@_register("SELECT o_orderkey, o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS before FROM orders")
def sequence_before(spark, sf_dir):
    """The customer of the order before, over all orders."""
    return sequence.with_before(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", parts=7)


@_register("SELECT step, count(*) AS rows FROM (SELECT event_id - lag(event_id) OVER (ORDER BY event_id) AS step FROM events) WHERE step IS NOT NULL GROUP BY 1")
def sequence_steps(spark, sf_dir):
    return sequence.steps(table(spark, sf_dir, "events"), "event_id", "event_id", 7)


@_register(f"SELECT * REPLACE (CAST(daily_avg_order_amount AS DECIMAL(18, 4)) AS daily_avg_order_amount) FROM ({_DAILY_SQL.replace('FROM clean', 'FROM twice')})".replace("FROM (SELECT", "FROM (WITH twice AS (SELECT * REPLACE (CASE WHEN invoice_date BETWEEN TIMESTAMP '1996-02-10' AND TIMESTAMP '1996-02-20' THEN order_amount * 2 ELSE order_amount END AS order_amount) FROM clean) SELECT", 1), True)
def step_changed_days(spark, sf_dir):
    """After ten days are replaced, only days with fresh rows are summed anew."""
    store, rows = _store(spark, DATED, **LAYOUTS), _clean(spark, sf_dir)
    store.create("dwd_orders", DWD)
    stamped = lambda df, day: df.withColumn("etl_time", F.lit(day).cast("timestamp_ntz"))
    store.replace("dwd_orders", stamped(rows.fillna("", ["description"]), "2024-01-01"))
    steps.aggregate_daily(store, changed=True)
    ten = rows.where("invoice_date between timestamp_ntz '1996-02-10' and timestamp_ntz '1996-02-20'").withColumn("order_amount", (F.col("order_amount") * 2).cast("decimal(12,4)"))
    store.replace_range("dwd_orders", stamped(ten, "2024-01-02"), "invoice_date")
    done = steps.aggregate_daily(store, changed=True)
    if done["status"] != "success" or done["rows"] > 11:
        raise RuntimeError(str(done))
    return store.read("dws_sales_daily").drop("etl_time")


@_register("SELECT CAST(ts AS DATE) AS stat_date, event_type, CAST(sum(user_id) AS BIGINT) AS amount, count(*) AS rows FROM events WHERE CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM events) - 2 GROUP BY 1, 2")
def stream_once(spark, sf_dir):
    """A stream in which every file comes twice: each event counts once, and days are put out when they are over."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("user_id"))
    path, out, state = (scratch(spark, n) for n in ("events", "days", "state"))
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(path)
    days = intake.daily_windows(intake.read_stream(spark, path, events.schema, 1), ["event_id"], "ts", "user_id", "1 day", ["event_type"])
    intake.append_files(days, out, state).awaitTermination()
    last = events.agg(F.max(F.col("ts").cast("date"))).first()[0]
    return spark.read.schema(days.schema).parquet(out).where(F.col("stat_date") < F.date_sub(F.lit(last), 2))


@_register(
    """SELECT CAST(ts AS DATE) AS stat_date, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DECIMAL(38, 4)) AS amount, count(*) AS rows,
  CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS closed FROM events GROUP BY CAST(ts AS DATE)"""
)
def stream_open_days(spark, sf_dir):
    """Days as they stand after a stream of four files, one of which comes twice: totals of open days, and of those that are over."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    path, out, state = (scratch(spark, n) for n in ("events", "open", "state"))
    a, b = events.agg(F.percentile_approx(F.col("ts"), [0.3, 0.7]).alias("q")).first()["q"]
    spans = [F.col("ts") < F.lit(a), F.col("ts").between(F.lit(a), F.lit(b)), F.col("ts").between(F.lit(a), F.lit(b)), F.col("ts") > F.lit(b)]
    for span in spans:
        events.where(span).coalesce(1).write.mode("append").parquet(path)
    days = days_open.open_days(intake.read_stream(spark, path, events.schema, 1), ["event_id"], "ts", "value")
    days_open.follow(days, out, state).awaitTermination()
    found = days_open.latest(spark.read.schema(days.schema).parquet(out))
    return found.withColumn("amount", F.col("amount").cast("decimal(38,4)"))
