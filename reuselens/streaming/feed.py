"""The crawl as a stream: files of changes arrive, the newest row of each key is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from ..operators.incremental import upsert


def changes(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files; files_per_batch is what a limit of requests is to a crawler."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _buckets(spark: SparkSession, table: str) -> dict[int, list[tuple[int, str]]]:
    """Bucket to its (version, path), oldest first, of the versions that are complete."""
    fs, root = _fs(spark, table)
    found: dict[int, list[tuple[int, str]]] = {}
    for version in fs.listStatus(root) if fs.exists(root) else ():
        name = version.getPath().getName()
        if not name.startswith("version=") or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(version.getPath(), "_SUCCESS")):
            continue
        for bucket in fs.listStatus(version.getPath()):
            kind, _, number = bucket.getPath().getName().partition("=")
            if kind == "_bucket":
                found.setdefault(int(number), []).append((int(name.partition("=")[2]), bucket.getPath().toString()))
    return {k: sorted(v) for k, v in found.items()}


def keep_newest(stream: DataFrame, table: str, checkpoint: str, key: str, order: tuple[str, ...], buckets: int = 16, every: str | None = None) -> StreamingQuery:
    """Upserts a stream into Parquet files below the folder `table`. Keys are dealt to buckets; a batch writes a new version of the buckets that it touches, and no other.

    A version that is complete is left alone, so a batch that is run again changes nothing. Of each
    bucket the newest version and the one before it are kept, for readers that are under way. Without
    `every` the query ends when all files are read.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fs, done = _fs(spark, f"{table}/version={n}/_SUCCESS")
        if fs.exists(done):
            return
        held = _buckets(spark, table)
        batch = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in batch.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        stored = [held[b][-1] for b in touched if b in held]
        rows = spark.read.option("basePath", table).schema(StructType([f for f in batch.schema.fields if f.name != "_bucket"]).add("version", IntegerType()).add("_bucket", IntegerType())).parquet(*(p for _, p in stored)).drop("version") if stored else batch.limit(0)
        upsert(rows.select(*batch.columns), batch, key, order).write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/version={n}")
        batch.unpersist()
        for old in (p for b in touched for _, p in held.get(b, [])[:-1]):
            where, path = _fs(spark, old)
            where.delete(path, True)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest(spark: SparkSession, table: str, schema: str | StructType | None = None) -> DataFrame:
    """The newest version of each bucket of the table that keep_newest writes; before the first version no rows, with the columns of schema, if it is given."""
    paths = [versions[-1][1] for versions in _buckets(spark, table).values()]
    if not paths:
        return spark.createDataFrame([], schema or StructType())
    return spark.read.option("basePath", table).parquet(*paths).drop("version", "_bucket")
