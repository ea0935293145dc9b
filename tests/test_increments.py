"""What is kept, merged or carried from one run to the next: figures, bitmaps, sketches, marks, stream state, rows before."""

import datetime

import pytest
from pyspark.sql import functions as F

from stratum.operators import distinct, quality, sequence
from stratum.plans import steps
from stratum.schema import DATED, DWD, LAYOUTS, ODS
from stratum.sources.warehouse import Warehouse, Watch
from stratum.streaming import intake

AT = datetime.datetime.fromisoformat


def raw(spark, rows):
    return spark.createDataFrame([(i, "s", d, q, AT(t) if t else None, p, c, "F") for i, d, q, t, p, c in rows], "invoice_no string, stock_code string, description string, quantity int, invoice_date timestamp_ntz, unit_price double, customer_id string, country string")


def test_figures_while_loading_are_those_of_the_check(spark, tmp_path):
    rows = raw(spark, [("1", None, 1, "2024-01-01", 2.0, "7"), ("2", None, None, "2024-02-01", 0.0, "8"), ("3", "d", -1, None, -1.0, None)])
    store, watch = Warehouse(spark, str(tmp_path), DATED), Watch(quality.classic_figures())
    store.create("ods_orders", ODS)
    assert store.replace("ods_orders", rows, watch) == 3
    found, want = quality.classic_judged(watch.found), quality.classic_check(store.read("ods_orders")).first().asDict()
    assert found == {k: v for k, v in want.items() if k not in ("unique_keys", "duplicate_rows")} and found["status"] == "warning" and found["warnings"] == ["description"]
    assert store.replace_range("ods_orders", rows.where("invoice_no = '2'"), "invoice_date", watch) == 1 and watch.found["total"] == 1
    assert store.replace("ods_orders", rows.where("false"), watch) == 0 and quality.classic_judged(watch.found)["status"] == "failed"


def test_bitmaps_and_sketches_of_days_merge(spark):
    rows = spark.range(20_000).selectExpr("date_add(date '2024-01-01', cast(id % 90 as int)) as day", "(id * 7919) % 70000 as n", "if(id % 3 = 0, 'a', 'b') as shop")
    month = F.date_format("day", "yyyy-MM")
    daily = distinct.daily_bitmaps(rows.unionByName(rows.limit(5).withColumn("n", F.lit(None).cast("long"))), F.col("day"), F.col("n"), ("shop",))
    found = {(r.span, r.shop): r.numbers for r in distinct.merged_count(daily, month, ("shop",)).collect()}
    want = {(r.m, r.shop): r.n for r in rows.groupBy(month.alias("m"), "shop").agg(F.countDistinct("n").alias("n")).collect()}
    assert found == want and len(found) == 6
    sketches = distinct.daily_sketches(rows, F.col("day"), F.concat(F.lit("c"), "n"))
    for r in distinct.merged_estimate(sketches, month).collect():
        real = rows.where(month == r.span).select("n").distinct().count()
        assert abs(r["values"] - real) < 0.05 * real


def test_one_extreme_value_does_not_hide_others(spark):
    rows = spark.createDataFrame([(float(i % 20), 1.0) for i in range(1000)] + [(500.0, 1.0)] * 5 + [(1e12, None)], "v double, w double")
    by_quartiles = {r.column_name: r for r in quality.quantile_outliers(rows, ["v", "w"]).collect()}
    assert by_quartiles["v"].outliers == 6 and by_quartiles["w"].outliers == 0 and -15 <= by_quartiles["v"].low < 0
    assert {r.column_name: r.outliers for r in quality.outliers(rows, ["v"]).collect()} == {"v": 1}
    empty = quality.quantile_outliers(rows.where("false"), ["v"]).first()
    assert empty.low is None and empty.outliers == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_before_equal_a_plain_lag(spark, parts):
    rows = spark.range(60_000).selectExpr("(id * 7919) % 60000 as at", "id % 1000 as v").unionByName(spark.createDataFrame([(None, 5)], "at long, v long"))
    found = sequence.with_before(rows.repartition(5), "at", "v", parts=parts)
    plain = sorted(((r["at"], r.v) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = {(at, v): b for (at, v), b in zip(plain, [None, *(v for _, v in plain)])}
    assert {(r["at"], r.v): r.before for r in found.collect()} == want
    assert sequence.progressive(rows.where("at is not null").withColumn("v", F.col("at")), "at", "v") and not sequence.progressive(rows, "at", "v")
    assert sequence.with_before(rows.where("false"), "at", "v").count() == 0 and not sequence.progressive(rows.where("false"), "at", "v")


def test_changed_days_alone_are_summed_anew(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path), DATED, layouts=LAYOUTS)
    store.create("dwd_orders", DWD)
    rows = [(str(i), "d", 1, f"2024-{1 + i % 6:02d}-{1 + i % 9:02d}", 2.0, "c") for i in range(120)]
    detail = raw(spark, rows).withColumns({"order_amount": F.lit(2), "etl_time": F.lit(AT("2024-07-01")).cast("timestamp_ntz")})
    store.replace("dwd_orders", detail)
    assert steps.aggregate_daily(store, changed=True)["rows"] == 18 and steps.mark(store, "dws_sales_daily") == AT("2024-07-01")
    assert steps.aggregate_daily(store, changed=True)["status"] == "skipped"
    fresh = detail.where("month(invoice_date) = 2 and day(invoice_date) = 2").withColumns({"order_amount": F.lit(5), "etl_time": F.lit(AT("2024-07-02")).cast("timestamp_ntz")})
    store.replace_range("dwd_orders", fresh, "invoice_date")
    days = steps.touched(store.parted("dwd_orders"), steps.mark(store, "dws_sales_daily"))
    plan = steps.of_days(store.parted("dwd_orders"), days)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan
    again = steps.aggregate_daily(store, changed=True)
    assert again["rows"] == 1
    daily = {str(r.stat_date): float(r.daily_sales_amount) for r in store.read("dws_sales_daily").collect()}
    n = fresh.count()
    assert len(daily) == 18 and daily["2024-02-02"] == 5.0 * n and sum(daily.values()) == 2.0 * (120 - n) + 5.0 * n


def test_repeated_files_and_late_rows(spark, tmp_path):
    """A file that comes twice counts once; a row within the delay counts, one beyond it does not."""
    schema = "id long, at timestamp, amount long"
    row = lambda i, t, n: (i, AT(t), n)
    batches = [
        [row(1, "2024-01-01 10:00", 5), row(2, "2024-01-01 11:00", 7)],
        [row(1, "2024-01-01 10:00", 5), row(2, "2024-01-01 11:00", 7)],
        [row(3, "2024-01-02 09:00", 1), row(4, "2024-01-01 23:00", 2)],
        [row(5, "2024-01-05 00:00", 3)],
        [row(6, "2024-01-01 12:00", 100), row(7, "2024-01-08 00:00", 1)],
        [row(8, "2024-01-12 00:00", 1)],
    ]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        days = intake.daily_windows(intake.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1), ["id"], "at", "amount", "1 day")
        intake.append_files(days, out, state).awaitTermination()
    found = {str(r.stat_date): (r.amount, r.rows) for r in spark.read.parquet(out).collect()}
    assert found["2024-01-01"] == (14, 3) and found["2024-01-02"] == (1, 1)
