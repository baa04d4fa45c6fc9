"""INI files as rows, and the annotation rules that they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import trim_blank


def ini_items(files: DataFrame) -> DataFrame:
    """(path, block, key, value) of files (path, content); the last of repeated keys wins.

    The first of `=`, `[`, `;` and `#` on a line decides: a value follows, a block begins, or the rest
    is a comment. A value is all that follows the first `=`, comments included, without blanks at
    its ends. Keys before any block are in block ''. A block without keys does not appear.
    """
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    w = Window.partitionBy("path").orderBy("line")
    block = F.when(F.col("text").rlike(r"^[^=;#\[]*\["), trim_blank(F.regexp_extract("text", r"^[^=;#\[]*\[([^\]]*)", 1)))
    lines = lines.withColumn("block", F.coalesce(F.last(block, ignorenulls=True).over(w), F.lit("")))
    items = lines.where(F.col("text").rlike(r"^[^=;#\[]*=")).select("path", "block", "line", trim_blank(F.regexp_extract("text", "^([^=]*)=", 1)).alias("key"), trim_blank(F.regexp_extract("text", "^[^=]*=(.*)$", 1)).alias("value"))
    return items.groupBy("path", "block", "key").agg(F.max_by("value", "line").alias("value"))


def ini_value(items: DataFrame, block: str, key: str, default: str) -> DataFrame:
    """(path, value): the default only where the key is missing; an empty value stays empty."""
    found = items.where((F.col("block") == block) & (F.col("key") == key)).select("path", "value")
    return items.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("value", F.lit(default)).alias("value"))


# Values of the format: reasons of a Content block, the first being the default, and the keys of a 3rdParty block.
REASONS = ("FalsePositive", "NoCreativeValue", "AllowedByAuthor", "Other")
THIRD_PARTY = ("vendor", "product", "copyright", "version", "displayName", "displayVersion", "url", "date")


def _get(key: str, default: str | None = ""):
    return F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(default))


def _folder():
    return F.regexp_replace(F.col("path"), r"/?[^/]*$", "").alias("dir")


def rules(items: DataFrame) -> DataFrame:
    """One row per block: (dir, block, type, db_file, search_file, reason, comment, cve, status). dir is the folder of the file; an unknown type gives no rule; a missing one is Content. An unknown reason is the first of REASONS; `Closed` is read as `Close`, all else but `Close` as `Open`. Fields that a type does not have are null."""
    rows = items.groupBy("path", "block").agg(_get("type", "Content").alias("type"), *(_get(k).alias(n) for k, n in (("dbFile", "db_file"), ("searchFile", "search_file"), ("reason", "reason"), ("comment", "comment"), ("id", "cve"), ("status", "status"))))
    rows = rows.where(F.col("type").isin("Content", "3rdParty", "CVE", "Ignore"))
    of = lambda kind, value: F.when(F.col("type").isin(*kind), value)
    return rows.select(
        _folder(), "block", "type", of(("Content",), F.col("db_file")).alias("db_file"), of(("Content",), F.col("search_file")).alias("search_file"),
        of(("Content",), F.when(F.col("reason").isin(*REASONS), F.col("reason")).otherwise(REASONS[0])).alias("reason"), of(("Content", "CVE"), F.col("comment")).alias("comment"),
        of(("CVE",), F.col("cve")).alias("cve"), of(("CVE",), F.when(F.col("status").isin("Close", "Closed"), "Close").otherwise("Open")).alias("status"),
    )


def third_party(items: DataFrame) -> DataFrame:
    """(dir, block, vendor, product, copyright, version, displayName, displayVersion, url, date) of the 3rdParty blocks."""
    rows = items.groupBy("path", "block").agg(_get("type", "Content").alias("type"), *(_get(k).alias(k) for k in THIRD_PARTY))
    return rows.where("type = '3rdParty'").select(_folder(), "block", *THIRD_PARTY)


def file_types(items: DataFrame) -> DataFrame:
    """(path, type): that of the last block in order of names, CVE and unknown ones aside."""
    kinds = items.groupBy("path", "block").agg(F.coalesce(F.max(F.when(F.col("key") == "type", F.col("value"))), F.lit("Content")).alias("type"))
    return kinds.where(F.col("type").isin("Content", "3rdParty", "Ignore")).groupBy("path").agg(F.max_by("type", "block").alias("type"))
