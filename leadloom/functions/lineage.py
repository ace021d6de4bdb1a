"""Cutting lineage, and ranks and running sums over a whole table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, an own one on a local master; elsewhere an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Bytes of a row group of a cut table: what a writing task holds in memory.
GROUP_BYTES = 16 << 20


def cut(df: DataFrame, name: str, wide_rows: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: later work starts from files that survive a lost executor.

    A writer looks at its size only after a hundred rows; wide_rows: after each, so that GROUP_BYTES bounds a group of rows of megabytes too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    each = {"parquet.page.size.row.check.min": 1} if wide_rows else {}
    df.write.options(**{"parquet.block.size": GROUP_BYTES, "compression": "zstd"} | each).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*written: DataFrame) -> None:
    """Delete the files of cut tables that nothing reads any more."""
    for df in written:
        spark, path = df.sparkSession, getattr(df, "_cut_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over as many tasks as the session shuffles to: for work that costs far more than its rows, which few small files would leave to as few tasks.

    Filters move below a deal; what is dear must therefore be a column or a generator above it.
    """
    session = df.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    return df.repartition(n)


def running_sum(df: DataFrame, order: list[Column], value: Column, into: str) -> DataFrame:
    """df with the running sum of value in the given total order, own row included.

    Rows are dealt by ranges of the order; a range's sum is one row, so that the sums before it are a window over as many rows as there
    are ranges, and the sums within run in every range at once.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumn("_v", value)
    ranged = cut(keyed.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("_v").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(sums.select("_range", "_before")), "_range")  # a row for each range
    return out.withColumn(into, F.sum("_v").over(within) + F.col("_before")).drop("_range", "_before", "_v", *names)


def global_rank(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """df with the number of each row (from 1) in the given total order."""
    return running_sum(df, order, F.lit(1).cast("bigint"), into)
