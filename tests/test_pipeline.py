import datetime
import json
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.fixed import SUMMARY_EMPTY
from stratum.operators import archive
from stratum.plans import alerts, report, steps
from stratum.schema import DATED, ODS, RuntimeSchema, from_yaml, load_cache, load_yaml, merge, save_cache, spark_type
from stratum.sources.warehouse import Layout, NoSuchTable, Warehouse, identifier
from stratum.streaming import intake
from tests.test_files import ORDERS, put


def test_store(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    one, two = spark.createDataFrame([(1, "a")], "d int, v string"), spark.createDataFrame([(2, "b"), (4, "c")], "d int, v string")
    with pytest.raises(NoSuchTable):
        store.replace("t", one)
    assert store.append("t", one) == 1 and store.append("t", two) == 2 and store.read("t").count() == 3
    assert store.replace("t", two) == 2 and {r.v for r in store.read("t").collect()} == {"b", "c"}
    assert store.upsert("t", spark.createDataFrame([(2, "x"), (3, "y")], "d int, v string"), "d") == 2
    assert {r.v for r in store.read("t").collect()} == {"x", "y", "c"}
    assert store.replace_range("t", spark.createDataFrame([(2, "p"), (3, "q")], "d int, v string"), "d") == 2
    assert {r.v for r in store.read("t").collect()} == {"p", "q", "c"}
    assert store.replace("t", one.limit(0)) == 0 and store.read("t").count() == 0
    assert store.dynamic_load("t", one.withColumnRenamed("v", "w")) == 1 and store.read("t").columns == ["d", "w"]
    assert store.tables(["t", "gone"]) == [("t", 2)]
    for bad in ("1t", "a-b", "t\n", ""):
        with pytest.raises(ValueError):
            identifier(bad)


def test_a_failed_write_is_not_seen(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    schema = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("v", T.StringType())])
    store.create("t", schema)
    assert store.append("t", spark.createDataFrame([("1", "a")], "k string, v string")) == 1
    assert dict(store.read("t").dtypes)["k"] == "bigint"
    with pytest.raises(Exception, match="must not be null"):
        store.replace("t", spark.createDataFrame([(None, "b")], "k long, v string"))
    with pytest.raises(ValueError, match="missing columns"):
        store.append("t", spark.createDataFrame([(2,)], "k long"))
    assert [r.v for r in store.read("t").collect()] == ["a"]
    assert store.replace("t", spark.createDataFrame([(3, "c")], schema)) == 1 and store.replace("t", spark.createDataFrame([(4, "d")], schema)) == 1
    assert [r.v for r in store.read("t").collect()] == ["d"] and not list(tmp_path.glob("_staging*"))


def test_range_replace_of_a_dated_table(spark, tmp_path):
    """Only the days of the batch are rewritten; part of an edge day outside the span stays, a day without new rows goes."""
    at = lambda *rows: spark.createDataFrame([(datetime.datetime.fromisoformat(d) if d else None, v) for d, v in rows], "d timestamp_ntz, v string")
    store = Warehouse(spark, str(tmp_path), {"t": "d"}, grain="day")
    store.append("t", at(("2024-01-01 08:00", "a"), ("2024-01-02 08:00", "b"), ("2024-01-02 20:00", "c"), ("2024-01-03 08:00", "d"), ("2024-01-04 23:00", "e"), ("2024-01-09 08:00", "f"), (None, "g")))
    untouched = {p.name for p in tmp_path.glob("t/_part=2024-01-0[19]/*.parquet")}
    assert store.replace_range("t", at(("2024-01-02 12:00", "x"), ("2024-01-04 12:00", "y"), (None, "z")), "d") == 3
    assert sorted(r.v for r in store.read("t").collect()) == ["a", "b", "e", "f", "g", "x", "y", "z"]
    assert {p.name for p in tmp_path.glob("t/_part=2024-01-0[19]/*.parquet")} == untouched and not list(tmp_path.glob("t/_part=2024-01-03"))
    assert store.replace_range("t", at(), "d") == 0 and store.read("t").count() == 8


def test_tables_are_found_again(spark, tmp_path):
    """A catalogue that has forgotten the warehouse learns its tables from their folders."""
    rows = spark.createDataFrame([(datetime.datetime(2024, m, 1), f"c{m}", m) for m in range(1, 7)], "d timestamp_ntz, c string, n int")
    layout = {"t": Layout(bucketed="c", buckets=4, bloom=("c",))}
    store = Warehouse(spark, str(tmp_path / "a"), {"t": "d"}, layouts=layout)
    store.append("t", rows)
    store.append("u", rows)
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    again = Warehouse(spark, str(tmp_path / "b"), {"t": "d"}, layouts=layout)
    assert again.tables(["t", "u", "v"]) == [("t", 3), ("u", 3)] and again.read("t").count() == 6
    assert again.replace_range("t", rows.where("n = 3").withColumn("c", F.lit("new")), "d") == 1
    assert sorted(r.c for r in again.read("t").collect()) == ["c1", "c2", "c4", "c5", "c6", "new"] and store.read("t").where("c = 'new'").count() == 0


def test_joins_by_customer_need_no_exchange(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path), layouts={t: Layout(bucketed="customer", buckets=4) for t in ("sales", "customers")})
    store.append("sales", spark.range(5000).selectExpr("id", "concat('c', id % 300) as customer", "id % 7 as amount"))
    store.append("customers", spark.range(300).selectExpr("concat('c', id) as customer", "id % 5 as region"))
    joined = store.read("sales").hint("merge").join(store.read("customers"), "customer").groupBy("customer").agg(F.sum("amount").alias("amount"), F.max("region").alias("region"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert joined.count() == 300 and joined.agg(F.sum("amount")).first()[0] == sum(i % 7 for i in range(5000))


def test_row_groups_without_an_invoice_are_skipped(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path), layouts={"t": Layout(bloom=("invoice_no",))})
    spark.conf.set("parquet.block.size", "100000")
    try:
        store.append("t", spark.range(60_000).repartition(1).selectExpr("cast(xxhash64(id) as string) as invoice_no", "id"))
    finally:
        spark.conf.unset("parquet.block.size")
    wanted = spark.range(1).selectExpr("cast(xxhash64(777L) as string) as x").first().x
    one = store.read("t").where(F.col("invoice_no") == wanted)
    assert [r.id for r in one.collect()] == [777]
    node = one._jdf.queryExecution().executedPlan()
    one.collect()
    scanned = []

    def walk(plan):
        if "Scan parquet" in plan.nodeName():
            scanned.append(plan.metrics().apply("numOutputRows").value())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.executedPlan()
    walk(node)
    assert scanned and 0 < scanned[0] < 60_000 * 2 / 3


def test_archive_keeps_every_run(spark, tmp_path):
    """Two runs with other columns lie side by side; a run that is repeated replaces its own rows."""
    now = datetime.datetime(2024, 1, 1)
    store = Warehouse(spark, str(tmp_path))
    first = spark.createDataFrame([(1, "a b", "r1"), (2, None, "r2")], "id int, `odd name` string, rejected_reason string")
    second = spark.createDataFrame([(datetime.datetime(2024, 5, 5), [1, 2], "r1")], "at timestamp_ntz, list array<int>, rejected_reason string")
    assert steps.archive(store, first, "run1", now) == 2 and steps.archive(store, second, "run2", now) == 1
    assert steps.archive(store, first.limit(1), "run1", now) == 1
    rows = store.read("rejected_orders")
    assert sorted((r.run_id, r.rejected_reason) for r in rows.collect()) == [("run1", "r1"), ("run2", "r1")]
    back = archive.unfolded(rows, {"id": "int", "odd name": "string", "at": "timestamp_ntz", "list": "array<int>"}).orderBy("run_id").collect()
    assert (back[0].id, back[0]["odd name"], back[0].at) == (1, "a b", None) and (back[1].id, back[1].at, back[1].list) == (None, datetime.datetime(2024, 5, 5), [1, 2])
    assert {r.run_id: r.rows for r in archive.shapes(rows).collect()} == {"run1": 1, "run2": 1}
    plan = rows.where("run_id = 'run2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    assert steps.archive(store, first.where("false"), "run3", now) == 0


def test_figures_are_observed_while_writing(spark, tmp_path):
    """A load counts nothing after it: one job stages, one copies."""
    store = Warehouse(spark, str(tmp_path))
    rows = spark.range(1000).selectExpr("id", "if(id % 10 = 0, null, id) as v")
    store.create("t", rows.schema)
    spark.sparkContext.setJobGroup("observed", "")
    assert store.append("t", rows) == 1000
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed")) == 2


def test_run_log_is_compacted(spark, tmp_path):
    log = steps.RunLog(Warehouse(spark, str(tmp_path)))
    for i in range(3):
        log.end(log.start(f"t{i}"), f"t{i}", {"status": "success"})
    assert len(list(tmp_path.glob("etl_task_logs/*.parquet"))) == 6
    assert log.compact() == 6 and len(list(tmp_path.glob("etl_task_logs/*.parquet"))) < 6 and log.latest().count() == 3


def test_months(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path), {"t": "d"})
    rows = spark.range(400).selectExpr("cast(timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as timestamp_ntz) as d", "id")
    store.append("t", rows)
    assert len(list(tmp_path.glob("t/_part=*"))) == 14
    some = store.between("t", "2024-02-10", "2024-03-05")
    assert sorted(r.id for r in some.collect()) == list(range(40, 64))
    assert "PartitionFilters: [isnotnull(_part" in some._jdf.queryExecution().executedPlan().toString()
    assert store.replace_range("t", rows.where("id between 40 and 70 and id % 2 = 0"), "d") == 16
    assert sorted(r.id for r in store.read("t").collect()) == [i for i in range(400) if not 40 <= i <= 70 or i % 2 == 0]


def test_bad_dates_and_missing_countries_fail_the_step(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"), DATED)
    bad = put(tmp_path / "b.csv", ORDERS + "3,1,x,1,someday,1,1,F\n")
    assert steps.extract(store, bad)["status"] == "failed" and store.read("ods_orders").count() == 0
    null = put(tmp_path / "n.csv", ORDERS + "3,1,x,1,12/3/2010 8:28,1,1,\n")
    assert steps.extract(store, null)["status"] == "success"
    failed = steps.transform(store)
    assert failed["status"] == "failed" and "country" in failed["error"] and store.read("dwd_orders").count() == 0


def test_declared_types_and_encodings(spark, tmp_path):
    csv = put(tmp_path / "d.csv", "day,code,n\n2024-01-01,7,é\n2024-01-02,8,x\n", "latin-1")
    declared = RuntimeSchema(dtypes={"code": {"type": "Numeric", "precision": 10, "scale": 2}}, csv_encodings=["utf-8", "latin-1"])
    store = Warehouse(spark, str(tmp_path / "s"))
    assert steps.auto_extract(store, csv, declared)["status"] == "success"
    assert dict(store.read("ods_orders").dtypes)["code"] == "decimal(10,2)" and "é" in {r.n for r in store.read("ods_orders").collect()}


def test_classic(spark, tmp_path):
    csv = put(tmp_path / "o.csv", ORDERS + "3,1,x,0,12/2/2010 8:28,1,1,F\n4,1,x,2,12/3/2010 8:28,1.25,1,F\n")
    results = steps.classic_pipeline(spark, str(tmp_path / "w"), csv, str(tmp_path / "r"), retries=0).run()
    assert [r["status"] for r in results] == ["success", "passed", "success", "success", "success"]
    assert (results[2]["clean"], results[2]["rejected"], results[2]["lost"]) == (2, 2, 0)
    store = Warehouse(spark, str(tmp_path / "w"))
    assert {str(r.stat_date): float(r.daily_sales_amount) for r in store.read("dws_sales_daily").collect()} == {"2010-12-01": 15.3, "2010-12-03": 2.5}
    assert {r.status for r in steps.RunLog(store).latest().collect()} == {"success"}
    text = open(results[4]["path"], encoding="utf-8").read().split("\n")
    assert text[0].startswith("# ") and "stat_date,daily_order_count,daily_customer_count,daily_sales_amount,daily_avg_order_amount" in text
    again = steps.classic_pipeline(spark, str(tmp_path / "w"), csv, str(tmp_path / "r"), "2010-12-03", True, retries=0).run()
    assert again[0]["rows"] == 1 and store.read("ods_orders").count() == 4 and store.read("rejected_orders").count() == 2 and store.read("dwd_orders").count() == 2
    skipped = steps.extract(store, csv, "2030-01-01", True)
    assert (skipped["status"], skipped["rows"]) == ("skipped", 0)


def test_report_on_the_console(spark, tmp_path, capsys):
    csv = put(tmp_path / "o.csv", ORDERS)
    store = Warehouse(spark, str(tmp_path / "w"), DATED)
    for result in (steps.extract(store, csv), steps.transform(store), steps.aggregate_daily(store)):
        assert result["status"] == "success"
    assert steps.extract(store, csv)["checks"]["status"] == "passed"
    capsys.readouterr()
    summary = steps.report(store, str(tmp_path / "r"), echo=True)["summary"]
    said = capsys.readouterr().out
    assert summary and all(f"{k}: {v}" in said for k, v in summary.items())


def test_failure_alerts(spark, tmp_path):
    heard = []
    channels = alerts.Alerts()
    channels.register(lambda *a: 1 / 0)
    channels.register(lambda *a: heard.append(a))
    p = steps.classic_pipeline(spark, str(tmp_path / "w"), str(tmp_path / "none.csv"), str(tmp_path), retries=1, wait_seconds=0, alerts=channels)
    with pytest.raises(steps.StepFailed):
        p.run()
    assert len(heard) == 1 and p.log.latest().where("status = 'failed'").count() == 2
    p.log.end("x", "t", {"status": "failed", "error": "é" * 2000})
    assert len(p.log.latest().where("run_id = 'x'").first().error_message) == 1000


def test_alerts():
    assert alerts.Alerts().send("t", "c") == 0
    found = alerts.Alerts().register_from_environment({"WECOM_WEBHOOK_URL": "http://x?key=1", "SMTP_HOST": "h"})
    assert len(found.channels) == 2 and not alerts.Alerts().register_from_environment({}).channels
    assert alerts.without_query("http://x/y?key=1") == "http://x/y"


def test_auto(spark, tmp_path):
    lines = ["Order_ID,Order_Date,Amount,Category,Returned"] + [f"{i + 1},2024-01-{i % 9 + 1:02d},\"${i % 5 + 1},000\",{'abc'[i % 3]},{'Yes' if i % 4 else 'No'}" for i in range(60)]
    csv = put(tmp_path / "w.csv", "\n".join(lines) + "\n")
    declared = RuntimeSchema(cancel_rules=[{"column": "Returned", "method": "string_equals", "value": "no", "reason": "r"}], computed_columns=[{"name": "twice", "expression": "Order_ID * 2"}, {"name": "bad", "expression": "__import__('os')"}])
    results = steps.auto_pipeline(spark, str(tmp_path / "s"), csv, str(tmp_path / "r"), declared)
    assert [r["status"] for r in results] == ["success", "passed", "success", "success", "success"]
    assert results[0]["roles"] == {"Order_ID": "id", "Order_Date": "date", "Amount": "numeric", "Category": "categorical", "Returned": "bool"}
    assert (results[2]["clean"], results[2]["rejected"], len(results[2]["warnings"])) == (45, 15, 1)
    assert results[3]["rows"] == 9 and json.load(open(results[4]["path"].replace("data_report", "data_summary").replace(".csv", ".json")))["metrics"] == ["Amount_sum"]


def test_report_stays_inside_its_root(spark, tmp_path):
    with pytest.raises(ValueError):
        report.confined(str(tmp_path / ".." / "x"), str(tmp_path))
    assert steps.report(Warehouse(spark, str(tmp_path / "no")), str(tmp_path))["status"] == "failed"
    store = Warehouse(spark, str(tmp_path / "s"))
    from stratum.schema import DWS

    store.create("dws_sales_daily", DWS)
    assert steps.report(store, str(tmp_path))["summary"] == {"message": SUMMARY_EMPTY}


YAML = """
csv_read: {encodings: [utf-8], dtype_overrides: {A: str}}
source_column_mapping: {A: a}
column_dtypes: {p: {type: Numeric, precision: 10, scale: 4}, q: {type: Integer}, d: {type: DateTime}}
cleaning:
  cancel_rules: [{column: a, method: string_startswith, value: C}]
  required_columns: [{column: b}]
  validations: [{column: q, operator: gt, value: 0}]
  computed_columns: [{name: x, expression: "p * q"}]
quality: {critical_null_columns: [a], null_rate_columns: [b], null_rate_threshold: 0.5}
"""


def test_schema(tmp_path):
    path = put(tmp_path / "s.yaml", YAML)
    declared = from_yaml(load_yaml(path))
    assert (declared.source_mapping, declared.threshold(), declared.dtype_overrides) == ({"A": "a"}, 0.5, {"A": "str"})
    assert spark_type(declared.dtypes["p"]).simpleString() == "decimal(10,4)"
    inferred = RuntimeSchema(date_columns=["d"], source_mapping={"A": "A"}, quality_critical_nulls=["d"])
    both = merge(declared, inferred)
    assert both.date_columns == ["d"] and both.source_mapping == {"A": "a"} and both.quality_critical_nulls == ["a"]
    only = merge(RuntimeSchema(validations=[{"column": "q"}]), inferred)
    assert only.validations and only.quality_critical_nulls == ["d"]
    assert merge(from_yaml(load_yaml(put(tmp_path / "e.yaml", ""))), inferred) == inferred
    save_cache(both, str(tmp_path / "c" / "x.json"))
    assert load_cache(str(tmp_path / "c" / "x.json")) == both and load_cache(str(tmp_path / "no.json")) is None
    assert load_yaml(str(tmp_path / "no.yaml")) is None


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("C1", 1), ("A2", 2), ("A3", None)], "invoice_no string, quantity int")
    df.write.parquet(str(tmp_path / "in"))
    store = Warehouse(spark, str(tmp_path / "s"))
    schema = RuntimeSchema(cancel_rules=[{"column": "invoice_no", "method": "string_startswith", "value": "C"}], required_columns=["quantity"])
    for _ in range(2):
        intake.clean_stream(intake.read_stream(spark, str(tmp_path / "in"), df.schema), store, schema, str(tmp_path / "c")).awaitTermination()
    assert store.read("dwd_orders").count() == 1 and store.read("rejected_orders").count() == 2
    assert ODS.names[0] == "invoice_no" and isinstance(datetime.date.today(), datetime.date)


def test_daily_stream(spark, tmp_path):
    """Days met in a batch are summed anew from all of the detail."""
    detail = spark.createDataFrame([("1", "a", datetime.datetime(2024, 1, 1), 5), ("2", "b", datetime.datetime(2024, 1, 2), 7)], "invoice_no string, customer_id string, invoice_date timestamp_ntz, order_amount int").withColumn("order_amount", F.col("order_amount").cast("decimal(12,4)"))
    store = Warehouse(spark, str(tmp_path / "s"))
    store.append("dwd_orders", detail)
    late = detail.where("invoice_no = '1'").withColumn("invoice_no", F.lit("3"))
    store.append("dwd_orders", late)
    late.write.parquet(str(tmp_path / "in"))
    intake.daily_stream(intake.read_stream(spark, str(tmp_path / "in"), late.schema), store, "invoice_date", str(tmp_path / "c")).awaitTermination()
    assert [(str(r.stat_date), r.daily_order_count, float(r.daily_sales_amount)) for r in store.read("dws_sales_daily").collect()] == [("2024-01-01", 2, 10.0)]
