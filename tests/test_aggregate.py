import datetime

import pytest

from stratum.operators import aggregate, writes
from stratum.schema import RuntimeSchema

DAILY = "stat_date string, invoice_no string, customer_id string, order_amount double"
ROWS = [
    ("2024-01-01", "1", "a", 100.0),
    ("2024-01-01", "2", "a", 150.0),
    ("2024-01-01", "3", "b", 100.0),
    ("2024-01-02", "4", "c", 50.0),
    ("2024-01-02", "4", "c", 50.0),
    ("2024-01-03", "5", None, 10.0),
]


def test_daily(spark):
    rows = {str(r.stat_date): r for r in aggregate.daily_sales(spark.createDataFrame([*ROWS, (None, "9", "z", 1.0)], DAILY)).collect()}
    assert set(rows) == {"2024-01-01", "2024-01-02", "2024-01-03"}
    one = rows["2024-01-01"]
    assert (one.daily_order_count, one.daily_customer_count, one.daily_sales_amount, one.daily_avg_order_amount) == (3, 2, 350.0, 116.6667)
    assert rows["2024-01-02"].daily_order_count == 1 and rows["2024-01-03"].daily_customer_count == 0


def test_adaptive(spark):
    df = spark.createDataFrame([("2024-01-01", 1, 2.0, "x"), ("2024-01-01", 2, None, "y"), (None, 3, 4.0, "x")], "day string, id int, m double, c string")
    schema = RuntimeSchema(date_columns=["day"], numeric_columns=["id", "m"], id_columns=["id"], categorical_columns=["c"])
    found = aggregate.adaptive(df, schema, categories=True, cardinality={"c": 2})
    rows = {str(r._stat_date): (r.m_sum, r.m_avg, r.c_distinct) for r in found.result.collect()}
    assert found.metrics == ["m"] and rows == {"2024-01-01": (2.0, 2.0, 2), "None": (4.0, 4.0, 1)}
    assert aggregate.adaptive_summary(found) == {"days": 1, "metrics": ["m_sum"], "rows": 2}


def test_adaptive_without_date_or_metric(spark):
    df = spark.createDataFrame([("$1,000", "a"), ("$3", "b")], "m_sum string, c string")
    one = aggregate.adaptive(df, RuntimeSchema(numeric_columns=["m_sum"])).result.first()
    assert (one.m_sum_sum, one.m_sum_avg) == (1003.0, 501.5)
    none = aggregate.adaptive(df, RuntimeSchema())
    assert none.note and none.result.count() == 0


def test_missing_values(spark):
    df = spark.createDataFrame([(None,)], "m double")
    one = aggregate.adaptive(df, RuntimeSchema(numeric_columns=["m"])).result.first()
    assert (one.m_sum, one.m_avg) == (0.0, None)


def test_many_metrics_are_cut(spark):
    df = spark.range(1).selectExpr(*[f"id as m{i}" for i in range(20)])
    assert len(aggregate.metric_columns(df, RuntimeSchema(numeric_columns=df.columns))) == 15
    assert len(aggregate.metric_columns(df, RuntimeSchema(numeric_columns=df.columns, id_columns=df.columns))) == 10


def test_summary(spark):
    rows = [(datetime.date(2024, 1, i + 1), o, 10, s, 50.0) for i, (o, s) in enumerate([(100, 5000.0), (150, 7500.0), (120, 6000.0)])]
    daily = spark.createDataFrame(rows, "stat_date date, daily_order_count long, daily_customer_count long, daily_sales_amount double, daily_avg_order_amount double")
    found = list(aggregate.summary(daily).values())
    assert found == [3, 18500.0, 370, 30, 6166.67, 50.0, 7500.0, 150]
    assert list(aggregate.summary(daily.limit(0))) == ["message"]


def test_writes(spark):
    old = spark.createDataFrame([(i, f"o{i}") for i in range(1, 6)] + [(None, "n")], "d int, v string")
    batch = spark.createDataFrame([(2, "b2"), (4, "b4")], "d int, v string")
    assert {r.v for r in writes.replace_range(old, batch, "d").collect()} == {"o1", "b2", "b4", "o5", "n"}
    assert {r.v for r in writes.upsert(old, batch, "d").collect()} == {"o1", "b2", "o3", "b4", "o5", "n"}
    with pytest.raises(writes.DuplicateKeys):
        writes.assert_unique(batch.union(batch), "d")
    assert writes.replace_range(old, batch.limit(0), "d").count() == 6


def test_figures_of_an_adaptive_summary(spark):
    rows = spark.createDataFrame([("2024-01-05", 1), ("2024-01-02", 2), (None, 3)], "d string, m int")
    dated = aggregate.adaptive_figures(aggregate.adaptive(rows, RuntimeSchema(date_columns=["d"], numeric_columns=["m"]))).first()
    assert (str(dated.first_date), str(dated.last_date), dated.days, dated.metrics) == ("2024-01-02", "2024-01-05", 3, 2)
    plain = aggregate.adaptive_figures(aggregate.adaptive(rows, RuntimeSchema(numeric_columns=["m"]))).first()
    assert (plain.first_date, plain.days, plain.metrics) == (None, 1, 2)
