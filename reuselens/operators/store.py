"""The stored tables: appends, lookups, and scans joined with their dictionaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def clustered(rows: DataFrame, path: str, keys: tuple[str, ...], buckets: int = 64) -> DataFrame:
    """rows from a table below path that is stored in buckets of keys, each in order of them: a join on these keys takes the buckets as they are, and only its other side is shuffled. clustered_again() opens it in another session."""
    name = f"clustered_{uuid.uuid4().hex}"
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def clustered_again(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = 64) -> DataFrame:
    """The table that clustered() stored below path with such a schema, keys and number of buckets."""
    name, by = f"clustered_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def content_id(data: str):
    """An id that the content decides, so that writers need no counter."""
    return F.xxhash64(data)


def tree_data(blobs: DataFrame) -> DataFrame:
    """(id, data) of distinct blobs (data)."""
    return blobs.select(content_id("data").alias("id"), "data").dropDuplicates(["id", "data"])


def files_of(rows: DataFrame, data_id: int, tag_id: int) -> DataFrame:
    """rows (file_index, path_id) as file rows of one blob and tag."""
    return rows.select(F.xxhash64(F.lit(data_id), F.lit(tag_id), "file_index").alias("id"), F.lit(data_id).cast("long").alias("data_id"), "file_index", "path_id", F.lit(tag_id).cast("long").alias("tag_id"))


def tags_of(tags: DataFrame) -> DataFrame:
    """Tag rows (id, tag_name, sha) of tags (repo, tag, sha): a tag of a repository at a commit has one id, whoever writes it."""
    return tags.select(F.xxhash64("repo", "tag", "sha").alias("id"), F.col("tag").alias("tag_name"), "sha").dropDuplicates(["id"])


def names_of(values: DataFrame, value: str) -> DataFrame:
    """Rows (id, name) of the distinct values of a column, for paths and licences; ids come from the values."""
    return values.where(F.col(value).isNotNull()).select(F.xxhash64(value).alias("id"), F.col(value).alias("name")).distinct()


def snippets_of(rows: DataFrame, data_id: int) -> DataFrame:
    """Snippet rows (id, internal_id, licence_id, data_id, data_index) of rows (internal_id, licence, data_index) whose trees are in one blob."""
    return rows.select(F.xxhash64(F.lit(data_id), "data_index").alias("id"), "internal_id", F.xxhash64("licence").alias("licence_id"), F.lit(data_id).cast("long").alias("data_id"), "data_index")


def results(found: DataFrame, scan_id: int, kind: str, path: str) -> None:
    """Adds results of a scan, "shallow" or "deep", to the table at path."""
    append(found.withColumn("scan_id", F.lit(scan_id).cast("long")).withColumn("kind", F.lit(kind)), path, ("scan_id", "kind"))


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """rows with the value that table (key, value) has for their key, else the default. Of repeated keys the largest value counts, so no row is doubled."""
    t = table.groupBy(F.col(key).alias("_k")).agg(F.max(value).alias(value))
    return rows.join(t, rows[key] == t["_k"], "left").drop("_k").withColumn(value, F.coalesce(value, F.lit(default)))


def last_by(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of the last row of a key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_rows(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", rank).where("_n = 1").drop("_n")


def snippets(snippet: DataFrame, licence: DataFrame, trees: DataFrame) -> DataFrame:
    """(internal_id, licence, syms) of snippet rows; trees is (data_id, data_index, syms). A row whose index its blob lacks is dropped; a missing licence is ''."""
    rows = lookup(snippet, licence.select(F.col("id").alias("licence_id"), "licence"), "licence_id", "licence", "")
    return rows.join(trees, ["data_id", "data_index"]).select("internal_id", "licence", "syms")


def files(file: DataFrame, tag: DataFrame, name: DataFrame, trees: DataFrame, licence: str = "") -> DataFrame:
    """(file_id, path, sha, licence, syms) of file rows. Where trees (data_id, data_index, syms) is clustered() by its two ids, it is not shuffled."""
    rows = lookup(file, tag.select(F.col("id").alias("tag_id"), "sha"), "tag_id", "sha", "")
    rows = lookup(rows, name.select(F.col("id").alias("path_id"), F.col("name").alias("path")), "path_id", "path", "")
    rows = rows.withColumnRenamed("file_index", "data_index")
    return rows.join(trees, ["data_id", "data_index"]).select(F.col("id").alias("file_id"), "path", "sha", F.lit(licence).alias("licence"), "syms")
