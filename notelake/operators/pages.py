"""Deep pages: rows in ranges of their order with counts, so that an offset is found without the rows before it; and pages after a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NEWEST = (("created_at", "desc"),)


def _keys(clauses, tie: str):
    return [F.col(f).desc_nulls_last() if d == "desc" else F.col(f).asc_nulls_first() for f, d in clauses] + [F.col(tie).asc_nulls_first()]


def write_pages(df: DataFrame, path: str, clauses=NEWEST, tie: str = "id", rows: int = 1 << 20) -> None:
    """Store rows by ranges of their order (about ``rows`` each), and the number of rows before each range."""
    n = max(1, -(-df.count() // rows))
    keys = _keys(clauses, tie)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    ranged.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    spark = df.sparkSession
    own = spark.read.parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("n"))  # a row a range
    own.withColumn("before", F.sum("n").over(W.orderBy("_range")) - F.col("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, limit: int = 50, offset: int = 0, clauses=NEWEST, tie: str = "id") -> DataFrame:
    """``limit`` rows from ``offset`` on, in order; only the ranges that hold them are read."""
    met = spark.read.parquet(f"{path}/counts").filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("_range").collect()
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/_range={r['_range']}" for r in met)) if met else spark.read.parquet(f"{path}/rows").limit(0)
    return rows.drop("_range").orderBy(*_keys(clauses, tie)).offset(offset - met[0]["before"] if met else 0).limit(limit)


def page_after(df: DataFrame, last: dict | None, limit: int = 50, clauses=NEWEST, tie: str = "id") -> DataFrame:
    """The ``limit`` rows that follow the row whose keys are ``last`` (none: the first ones). The filter reaches the scan, and no row before it
    is sorted."""
    if last:
        order, options, same = [*clauses, (tie, "asc")], [], F.lit(True)
        for f, d in order:
            c, v = F.col(f), F.lit(last[f])
            beyond = (F.lit(False) if last[f] is None else (c < v) | c.isNull()) if d == "desc" else (c.isNotNull() if last[f] is None else c > v)
            options.append(same & beyond)
            same = same & c.eqNullSafe(v)
        df = df.filter(F.coalesce(reduce(lambda a, b: a | b, options), F.lit(False)))
    return df.orderBy(*_keys(clauses, tie)).limit(limit)
