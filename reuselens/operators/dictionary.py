"""Dictionaries of names with stable ids, and what is coded by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ranked


def fresh_ids(values: DataFrame, value: str, first: int = 1) -> DataFrame:
    """(id, value): the distinct values numbered in their order, without gaps. Ranges of values are numbered by tasks of their own, whatever the values begin with. The numbers depend on the values alone."""
    rows = values.where(F.col(value).isNotNull()).select(value).distinct()
    return ranked(rows, (), (value,), "_id").select((F.col("_id") + first).alias("id"), value)


def insert_or_ignore(existing: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """existing (id, value) and the values that it lacks, numbered after its largest id."""
    new = values.select(value).join(existing.select(value), value, "left_anti")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    added = fresh_ids(new, value).select((F.col("id") + last).alias("id"), value)
    return existing.select("id", value).unionByName(added)


def encode(rows: DataFrame, dictionary: DataFrame, value: str, id_name: str) -> DataFrame:
    """rows with value replaced by its id, 0 where the dictionary lacks it."""
    d = dictionary.select(F.col(value).alias("_v"), F.col("id").alias(id_name))
    return rows.join(d, rows[value] == d["_v"], "left").drop("_v", value).withColumn(id_name, F.coalesce(id_name, F.lit(0)))


def decode(rows: DataFrame, dictionary: DataFrame, value: str, id_name: str) -> DataFrame:
    """rows with the value of an id, '' where the dictionary lacks it."""
    d = dictionary.select(F.col("id").alias("_i"), value)
    return rows.join(d, rows[id_name] == d["_i"], "left").drop("_i", id_name).withColumn(value, F.coalesce(value, F.lit("")))
