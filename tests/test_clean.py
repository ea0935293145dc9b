import pytest

from stratum.fixed import REASON_CANCELLED, REASON_NO_CUSTOMER, REASON_PRICE, REASON_QUANTITY
from stratum.operators import clean
from stratum.queries import RULES
from stratum.schema import RuntimeSchema

SCHEMA = "invoice_no string, stock_code string, description string, quantity int, unit_price decimal(10,4), customer_id string"
ROWS = [
    ("A1", "s1", "d", 2, "1.5", "c1"),
    ("A2", "s2", None, 1, "2.0", "c2"),
    ("C-3", "s3", "d", 1, "1.0", "c3"),
    ("A4", "s4", "d", -1, "1.0", "c4"),
    ("A5", "s5", "d", 0, "1.0", None),
    ("A6", "s6", "d", 1, "0.0", "c6"),
]


def frame(spark, rows, schema=SCHEMA):
    from decimal import Decimal

    return spark.createDataFrame([tuple(Decimal(x) if i == 4 and x is not None else x for i, x in enumerate(r)) for r in rows], schema)


def test_first_reason_wins(spark):
    good, bad, lost = clean.clean_first_match(frame(spark, ROWS))
    assert {r.invoice_no: float(r.order_amount) for r in good.collect()} == {"A1": 3.0, "A2": 2.0}
    assert {r.invoice_no: r.rejected_reason for r in bad.collect()} == {"C-3": REASON_CANCELLED, "A4": REASON_QUANTITY, "A5": REASON_NO_CUSTOMER, "A6": REASON_PRICE}
    assert lost.count() == 0


def test_all_matches_give_one_row_a_reason(spark):
    good, bad = clean.clean_all_matches(frame(spark, ROWS), RULES)
    assert good.count() == 2
    assert bad.count() == 5 and bad.select("invoice_no").distinct().count() == 4
    assert {r.rejected_reason for r in bad.where("invoice_no = 'A5'").collect()} == {REASON_NO_CUSTOMER, REASON_QUANTITY}


def test_everything_bad(spark):
    rows = [("C1", "s", "d", -1, "0", None), ("C2", "s", "d", 0, "-1", None)]
    good, bad, lost = clean.clean_first_match(frame(spark, rows))
    assert (good.count(), bad.count(), lost.count()) == (0, 2, 0)


def test_missing_amounts_are_lost_and_missing_numbers_kept(spark):
    rows = [("A1", "s", "d", None, "1", "c"), ("A2", "s", "d", 1, None, "c"), (None, "s", "d", 1, "1", "c"), ("A4", "s", "d", None, "0", "c")]
    good, bad, lost = clean.clean_first_match(frame(spark, rows))
    assert (good.count(), bad.count(), lost.count()) == (1, 0, 3)
    assert good.count() + bad.count() + lost.count() == len(rows)


@pytest.mark.parametrize("op, rejected", [("gt", {1, 5}), ("gte", {1}), ("lt", {5, 9}), ("lte", {9}), ("eq", {None, 1, 9}), ("neq", {5})])
def test_validation_of_nulls(spark, op, rejected):
    df = spark.createDataFrame([(None,), (1,), (5,), (9,)], "x int")
    bad = clean.clean_all_matches(df, RuntimeSchema(validations=[{"column": "x", "operator": op, "value": 5}]))[1]
    assert {r.x for r in bad.collect()} == rejected
    assert {r.rejected_reason for r in bad.collect()} == {f"x {op} 5"}


def test_cancel_methods(spark):
    df = spark.createDataFrame([("Cx", 1), ("cx", 2), (None, None)], "s string, n int")
    hit = lambda **r: {x.s for x in clean.clean_all_matches(df, RuntimeSchema(cancel_rules=[r]))[1].collect()}
    assert hit(column="s", method="string_startswith", value="C") == {"Cx"}
    assert hit(column="s", method="string_equals", value="CX") == {"Cx", "cx"}
    assert hit(column="n", method="column_equals", value=1) == {"Cx"}
    assert hit(column="n", method="column_equals", value="1") == set()
    assert hit(column="n", method="string_startswith", value="2") == {"cx"}
    assert hit(column="gone", method="string_equals", value="x") == set()
    assert hit(column="s", method="unheard", value="x") == set()


def test_default_reasons_and_type_errors(spark):
    df = spark.createDataFrame([(None, "a")], "n int, s string")
    bad = clean.clean_all_matches(df, RuntimeSchema(required_columns=["n"], cancel_rules=[{"column": "s", "method": "string_equals", "value": "A"}]))[1]
    assert {r.rejected_reason for r in bad.collect()} == {"n 为空", "取消: string_equals"}
    with pytest.raises(clean.RuleError):
        clean.clean_all_matches(df, RuntimeSchema(validations=[{"column": "s", "operator": "gt", "value": 0}]))
    assert clean.clean_all_matches(df, RuntimeSchema(validations=[{"column": "s", "operator": "eq", "value": 0}]))[1].count() == 1
    assert clean.clean_all_matches(df, RuntimeSchema(validations=[{"column": "s", "operator": "odd", "value": 0}]))[1].count() == 0


def test_computed_columns(spark):
    df = spark.createDataFrame([(6, 3), (1, 0)], "a int, b int")
    warnings = []
    schema = RuntimeSchema(computed_columns=[{"name": "r", "expression": "a / b"}, {"name": "t", "expression": "r ** 2 + -1"}, {"name": "w", "expression": "sin(a)"}, {"name": "f", "expression": "a // b"}, {"name": "x", "expression": "a.sum()"}])
    out = clean.with_computed(df, schema, warnings.append)
    assert out.columns == ["a", "b", "r", "t", "f"] and len(warnings) == 2
    assert [tuple(r) for r in out.orderBy("a").collect()] == [(1, 0, None, None, None), (6, 3, 2.0, 3.0, 2)]
