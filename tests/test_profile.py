import pytest
from pyspark.sql import functions as F

from stratum.operators.profile import Column, numeric_text, profile, progressive, role, roles_table, sampled, statistics


def of(name, values, kind="string", dates=0.0):
    known = [v for v in values if v is not None]
    return role(Column(name, kind, len(known), len(set(known)), known[:100], dates))


@pytest.mark.parametrize(
    "name, values, kind, dates, expected",
    [
        ("order_date", ["2024-01-01", "2024-01-02", "2024-01-03"] * 3, "string", 1.0, "date"),
        ("created_at", [1, 2, 3], "timestamp_ntz", 0.0, "date"),
        ("fruit", ["apple", "pear", "plum"] * 3, "string", 0.0, "categorical"),
        ("order_date", ["a", "b", "c"] * 3, "string", 0.0, "categorical"),
        ("quantity", [1, 2, 3, 4, 5] * 10, "bigint", 0.0, "numeric"),
        ("price", [1.5, 2.5, 3.5] * 10, "double", 0.0, "numeric"),
        ("amount", ["$1,000", "$2,500.50", "$30"] * 3, "string", 0.0, "numeric"),
        ("rate", ["15%", "20%", "3.5%"] * 5, "string", 0.0, "numeric"),
        ("total", ["1,000", "2,000", "3,500"] * 5, "string", 0.0, "numeric"),
        ("science", ["1e5", "2.5E-3", "7"] * 5, "string", 0.0, "numeric"),
        ("user_id", list(range(1, 101)), "bigint", 0.0, "id"),
        ("id", list(range(1000, 1100)), "int", 0.0, "id"),
        ("transaction_id", [f"t{i}" for i in range(200)], "string", 0.0, "id"),
        ("flag", [True, False] * 6, "boolean", 0.0, "bool"),
        ("flag", ["Yes", "No"] * 6, "string", 0.0, "bool"),
        ("flag", ["0", "1"] * 10, "string", 0.0, "bool"),
        ("flag", ["yes", "no", "maybe"] * 4, "string", 0.0, "bool"),
        ("nothing", [None] * 4, "string", 0.0, "drop"),
    ],
)
def test_roles(name, values, kind, dates, expected):
    assert of(name, values, kind, dates) == expected


def test_progressive():
    assert progressive(list(range(1, 11)))
    assert not progressive([3, 9, 1, 7, 2, 10, 5, 8, 4, 6])
    assert not progressive([1, 2])
    assert not progressive([5, 5, 5, 5])


def test_numeric_text():
    assert not numeric_text([]) and not numeric_text(["a%", "b%"]) and not numeric_text(["1", "2"])


def test_frame(spark):
    rows = [(f"2024-01-{i + 1:02d}", float(i % 7) + 0.5, "abc"[i % 3], i + 1, "yes" if i % 2 else "no", None) for i in range(20)]
    schema = profile(spark.createDataFrame(rows, "order_date string, amount double, category string, user_id bigint, is_returned string, gone string"))
    assert schema.roles() == {"order_date": "date", "amount": "numeric", "category": "categorical", "user_id": "id", "is_returned": "bool", "gone": "drop"}
    assert schema.quality_critical_nulls == ["order_date"] and "gone" not in schema.source_mapping
    assert profile(spark.createDataFrame([], "a string")).roles() == {"a": "drop"}


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(6000).selectExpr("id", "concat('n', id % 97) as v")
    ids = [{r.id for r in sampled(part, 100).collect()} for part in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("id")))]
    assert len(ids[0]) == 100 and ids[0] == ids[1] == ids[2]


def test_roles_of_all_rows_and_of_a_sample(spark):
    """Numbers that are nearly all different in a sample need not be so in the table."""
    df = spark.range(40_000).selectExpr("cast(pmod(hash(id), 20000) as int) as number", "id as key", "concat('c', id % 5) as category", "if(id < 39000, null, 'late') as sparse")
    whole = {r.column_name: r for r in roles_table(df, None).collect()}
    assert whole["number"].role == "numeric" and whole["key"].role == "id" and whole["category"].role == "categorical"
    assert (whole["sparse"].known, whole["sparse"].different, whole["category"].different) == (1000, 1, 5)
    assert profile(df).cardinality["category"] == 5


def test_one_scan_gives_the_roles_of_all_rows(spark):
    for name in ("customer", "orders", "events", "lineitem", "part"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        full = profile(df, None).roles()
        assert profile(df, 500, whole=True).roles() == full
    rows = spark.range(20_000).selectExpr("id", "concat('n', if(id % 50 = 0, 7, id)) as tag", "concat('n', if(id % 45 = 0, 7, id)) as near", "cast(null as string) as nothing")
    full = {c.name: c for c in statistics(rows, None)}
    once = {c.name: c for c in statistics(rows, 1000, whole=True)}
    assert {n: (c.count, role(c)) for n, c in once.items()} == {n: (c.count, role(c)) for n, c in full.items()}
    # near a bound of the ladder values are counted
    assert once["tag"].distinct == full["tag"].distinct and once["near"].distinct == full["near"].distinct


def test_one_scan_is_one_job(spark):
    rows = spark.range(5000).selectExpr("id % 40 as a", "concat('x', id % 9) as b")
    spark.sparkContext.setJobGroup("scan", "")
    profile(rows, 100, whole=True)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("scan")) == 1
