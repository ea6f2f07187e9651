"""Places of rows in an order, where one value may be that of most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.sources.scratch import written


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """The place (from 1, in ``order``) of each row among those equal in ``by``. Rows are dealt by ranges of ``order``; a place is that within
    the range plus the counts of earlier ranges, so a value that most rows share isn't one task."""
    placed = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_range")) - F.col("_n")).drop("_n")
    before = before.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_r"), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_range") == F.col("_r")]
    own = placed.withColumn("_own", F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order)))
    return own.join(before, same).withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_r", "_own", "_before", *(f"_by_{c}" for c in by))
