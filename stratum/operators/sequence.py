"""Each row with the value of the row before it, in one order of a whole table, without a task that holds it all.

Rows are range-partitioned by their position and written with the number of their part; within a part the row before is a lag.
The first row of a part takes the last value of the part before, from a table of one row a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def with_before(df: DataFrame, position: str, value: str, name: str = "before", parts: int | None = None) -> DataFrame:
    """df with the value of the row before by position; null for the first row. Positions are different; rows without one come first."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "parts")
    df.repartitionByRange(parts, F.col(position).asc_nulls_first()).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    # positions of a part are held by no other part, so a part's window has its rows and no others
    order = Window.partitionBy("__part").orderBy(F.col(position).asc_nulls_first())
    own = rows.withColumn("__n", F.row_number().over(order)).withColumn(name, F.lag(value).over(order))
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(F.col(position).isNotNull(), F.col(position)))
    ends = rows.groupBy("__part").agg(last.alias("last")).select("__part", F.lag("last.v").over(Window.orderBy("__part")).alias("__ahead"))
    return own.join(ends, "__part").withColumn(name, F.when(F.col("__n") == 1, F.col("__ahead")).otherwise(F.col(name))).drop("__part", "__n", "__ahead")


def steps(df: DataFrame, position: str, value: str, parts: int | None = None) -> DataFrame:
    """step and rows: how often each difference between a row and the one before occurs, over all rows."""
    found = with_before(df, position, value, "__before", parts)
    return found.select((F.col(value) - F.col("__before")).alias("step")).where("step is not null").groupBy("step").agg(F.count(F.lit(1)).alias("rows"))


def progressive(df: DataFrame, position: str, value: str, share: float = 0.8, parts: int | None = None) -> bool:
    """Whether the commonest step of all rows is positive and makes up more than that share of the steps."""
    row = steps(df, position, value, parts).agg(F.max_by("step", F.struct("rows", -F.col("step"))).alias("step"), F.max("rows").alias("most"), F.sum("rows").alias("all")).first()
    return bool(row["all"] and row["all"] >= 2 and row["step"] > 0 and row["most"] / row["all"] > share)
