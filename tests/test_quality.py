from stratum.operators import quality
from stratum.schema import RuntimeSchema

ODS = "invoice_no string, stock_code string, description string, quantity int, invoice_date string, unit_price double, customer_id string, country string"
ROWS = [
    ("1", "a", "d", 1, "2024-01-01", 1.0, "c", "x"),
    ("1", "a", "d", 1, "2024-01-01", 1.0, "c", "x"),
    (None, "a", "d", 1, "2024-01-01", 1.0, "c", "x"),
    ("2", "a", "d", -1, "2024-01-01", 1.0, None, "x"),
    ("3", "a", "d", 1, "2024-01-01", -1.0, "c", "x"),
    ("4", "a", "d", 0, "2024-01-01", 1.0, "c", "x"),
]


def test_counts(spark):
    df = spark.createDataFrame(ROWS, ODS)
    assert quality.null_counts(df, ["invoice_no", "customer_id"]).first().asDict() == {"total": 6, "invoice_no_nulls": 1, "customer_id_nulls": 1}
    assert quality.duplicates(df, "invoice_no").first().asDict() == {"total": 6, "unique_keys": 4, "duplicate_rows": 2}
    assert quality.abnormal_amounts(df).first().asDict() == {"negative_price": 1, "zero_price": 0, "negative_quantity": 1, "zero_quantity": 1}


def test_verdict(spark):
    df = spark.createDataFrame(ROWS, ODS)
    assert quality.classic_check(df).first().status == "warning"
    assert quality.classic_check(df.where("invoice_no is not null")).first().status == "passed"
    assert quality.classic_check(df.limit(0)).first().status == "failed"


def test_null_rates_are_strictly_above(spark):
    rows = [("i", "s", None if i < 3 else "d", 1, "t", 1.0, "c", None if i < 5 else "x") for i in range(10)]
    df = spark.createDataFrame(rows, ODS)
    warned = lambda t: quality.classic_check(df, t).first().warnings
    assert warned(0.30) == ["country"] and warned(0.10) == ["description", "country"] and warned(0.80) == []
    assert {r.column_name: r.null_rate for r in quality.null_rates(df, ["description", "country"]).collect()} == {"description": 0.3, "country": 0.5}
    assert quality.null_rates(df.limit(0), ["country"]).first().null_rate is None


def test_by_schema(spark, monkeypatch):
    df = spark.createDataFrame([(1, None), (2, "b")], "id int, day string")
    schema = RuntimeSchema(id_columns=["id"], quality_critical_nulls=["day", "gone"], quality_null_rate_columns=["day"])
    row = quality.schema_check(df, schema).first()
    assert (row.status, row.warnings, row.unique_keys) == ("warning", ["day"], 2)
    monkeypatch.setenv("QUALITY_NULL_THRESHOLD", "0.6")
    assert quality.schema_check(df, schema).first().warnings == []
    assert RuntimeSchema(quality_null_threshold=0.2).threshold() == 0.2


def test_outliers_and_rules(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(float(i % 3), 5.0) for i in range(50)] + [(100.0, None)], "a double, b double")
    assert {r.column_name: r.outliers for r in quality.outliers(df, ["a", "b"]).collect()} == {"a": 1, "b": 0}
    assert {r.rule: r.violations for r in quality.violations(df, {"low": F.col("a") < F.col("b"), "some": F.col("a") >= 1}).collect()} == {"low": 0, "some": 17}
