"""Tables in the folder that driver and executors share, which cut a job's lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where that is unset, as in tests on one machine, a temporary folder takes its place for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/reuselens-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df from a Parquet table at path, or in a new folder: its lineage ends here, so a lost executor costs no more than the stages after it, and its size is known to the joins that follow."""
    path = path or scratch(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, groups: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """rows with name, 0 to n - 1 in each group in the order given, which must tell all rows of a group apart.

    Rows are dealt by ranges of group and order and numbered within a range; counts of ranges, one
    row for each group in a range, are summed for the rest. So a group with most of the rows is
    numbered by many tasks. The dealt rows are written once, as a range may be cut elsewhere when it
    is dealt again.
    """
    dealt = rows.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt)
    own = F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order))
    sums = Window.partitionBy(*groups).orderBy("_part") if groups else Window.partitionBy(F.lit(0)).orderBy("_part")
    counts = dealt.groupBy("_part", *groups).agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_of_{g}") for g in groups), (F.sum("_n").over(sums) - F.col("_n")).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return dealt.withColumn("_own", own).join(before, same).withColumn(name, (F.col("_before") + F.col("_own") - 1).cast("long")).select(*rows.columns, name)
