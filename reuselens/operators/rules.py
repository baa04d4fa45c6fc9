"""Annotation rules applied to paths and matches, and licences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import path_ancestors

# Lines that name a licence, and the licence: fixed by what the texts say.
LICENCE_LINES = (("GPL", "GNU General Public License"), ("Apache-2.0", "Apache License"), ("MIT", "MIT License"), ("CC-BY-NC", "CC BY-NC"))


def licence_of(text):
    """The first licence of LICENCE_LINES that a text names, else ''."""
    found = F.lit("")
    for licence, line in reversed(LICENCE_LINES):
        found = F.when(F.contains(text, F.lit(line)), licence).otherwise(found)
    return found


def drop_suppressed(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches (db_file, search_file, ...) without those that a Content rule names."""
    named = rules.where("type = 'Content'").select("db_file", "search_file")
    return matches.join(named, ["db_file", "search_file"], "left_anti")


def suppressed(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """The matches that a Content rule names, with its reason and comment."""
    named = rules.where("type = 'Content'").groupBy("db_file", "search_file").agg(F.min_by("reason", "block").alias("reason"), F.min_by("comment", "block").alias("comment"))
    return matches.join(named, ["db_file", "search_file"])


def drop_ignored(files: DataFrame, folders: DataFrame, path_col: str = "path") -> DataFrame:
    """Files without those in a folder of folders (dir) or below it. Each path meets the rules by its folders' names, so it is an equality join."""
    hit = files.select(F.col(path_col).alias("_path"), F.explode(path_ancestors(F.col(path_col))).alias("_dir")).join(folders.select(F.col("dir").alias("_dir")).distinct(), "_dir", "left_semi").select("_path").distinct()
    return files.join(hit, F.col(path_col) == F.col("_path"), "left_anti")


def cve_status(rules: DataFrame) -> DataFrame:
    return rules.where("type = 'CVE'").select("cve", "comment", "status")
