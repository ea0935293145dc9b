"""Days of a stream as they stand, over several runs of one stream."""

import datetime
from decimal import Decimal

from stratum.streaming import intake, open_days

AT = datetime.datetime.fromisoformat
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_open_and_closed_days_over_runs(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(*files):
        for rows in files:
            batch = spark.createDataFrame([(i, AT(t) if t else None, a) for i, t, a in rows], "id string, at timestamp, amount decimal(10,2)")
            batch.coalesce(1).write.mode("append").parquet(source)
        days = open_days.open_days(intake.read_stream(spark, source, batch.schema, 1), ["id"], "at", "amount", "1 day", shards=3)
        open_days.follow(days, out, state).awaitTermination()
        put = spark.read.schema(days.schema).parquet(out)
        return {str(r.stat_date): (float(r.amount), r.rows, r.closed) for r in open_days.latest(put).collect()}, put

    before = spark.conf.get(PROVIDER, None)
    first = [("a", "2024-01-01 10:00:00", Decimal("1.25")), ("b", "2024-01-01 11:00:00", Decimal("2.50")), ("n", None, Decimal("9.00"))]
    found, _ = run(first)
    assert found == {"2024-01-01": (3.75, 2, False)}  # a total before the day is over; a row without time is in no day
    # a file that comes again, a row without amount, and a late one of a day that is still open
    found, _ = run(first, [("c", "2024-01-02 09:00:00", None), ("d", "2024-01-01 08:00:00", Decimal("-1.00"))])
    assert found == {"2024-01-01": (2.75, 3, False), "2024-01-02": (0.0, 1, False)}
    # far ahead: both days are over; what comes for them then is left out
    run([("e", "2024-01-09 00:00:00", Decimal("7.00"))])
    found, put = run([("f", "2024-01-01 12:00:00", Decimal("100.00")), ("g", "2024-01-09 01:00:00", Decimal("0.50"))])
    assert found == {"2024-01-01": (2.75, 3, True), "2024-01-02": (0.0, 1, True), "2024-01-09": (7.5, 2, False)}
    assert put.where("closed").count() == put.where("closed").select("stat_date", "shard").distinct().count()
    assert spark.conf.get(PROVIDER, None) == before


def test_a_stream_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, at timestamp, amount double")
    empty.write.parquet(str(tmp_path / "in"))
    days = open_days.open_days(intake.read_stream(spark, str(tmp_path / "in"), empty.schema), ["id"], "at", "amount")
    open_days.follow(days, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert open_days.latest(spark.read.schema(days.schema).parquet(str(tmp_path / "out"))).count() == 0
