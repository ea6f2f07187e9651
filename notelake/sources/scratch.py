"""Tables between steps, in the folder that the cluster shares for checkpoints; they outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new name in the shared folder. Where ``spark.checkpoint.dir`` is unset, a local session gets a folder in its warehouse; on a cluster
    that is an error, as executors don't share local folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


#: A Parquet writer looks at what it holds after 100 rows, which are hundreds of MB where a row has some.
_FEW = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}


def written(df: DataFrame, few: bool = False) -> DataFrame:
    """Cut the lineage: the rows as a table in the shared folder, in groups of about 8 MB where rows are ``few`` and large."""
    path = folder(df.sparkSession)
    df.write.options(**(_FEW if few else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where they come in fewer partitions, as those of a few files do; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clear(spark: SparkSession) -> int:
    """Delete the tables that this process made so far; results that read them can't be computed any more. Gives their number."""
    gone = 0
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone
