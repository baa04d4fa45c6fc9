"""What has to be done again: new tags, markers, seeds, upserts, changed content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions


def new_tags(tags: DataFrame, done: DataFrame, with_sha: bool = False) -> DataFrame:
    """tags (repo, tag, sha) that done lacks, by name, or with with_sha by name and commit, so that a moved tag counts as new."""
    return tags.join(done, ["repo", "tag", "sha"] if with_sha else ["repo", "tag"], "left_anti")


def without_marker(repos: DataFrame, markers: DataFrame) -> DataFrame:
    """repos that have no marker of an empty result."""
    return repos.join(markers.select("repo"), "repo", "left_anti")


def seeded(current: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, seeded): current, and of previous what current has no row for."""
    c, p = current.select(key, F.col(value).alias("_c"), F.lit(True).alias("_has")), previous.select(key, F.col(value).alias("_p"))
    return c.join(p, key, "full").select(key, F.when(F.col("_has"), F.col("_c")).otherwise(F.col("_p")).alias(value), F.col("_has").isNull().alias("seeded"))


def upsert(stored: DataFrame, changes: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The newest row of each key; rows keep their child arrays whole, so children are replaced and never merged. One aggregate, combined before the shuffle."""
    rows = stored.unionByName(changes)
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(key, "_r.*")


def stale(repos: DataFrame, stored: DataFrame) -> DataFrame:
    """repos (full_name, pushed_at) that stored lacks or has with another time."""
    s = stored.select(F.col("full_name").alias("_n"), F.col("pushed_at").alias("_p"))
    return repos.join(s, (repos["full_name"] == s["_n"]) & repos["pushed_at"].eqNullSafe(s["_p"]), "left_anti")


def changed_files(now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, reused) of files (path, content_hash) against those of the tag before: only changed ones are parsed."""
    return now.join(before, ["path", "content_hash"], "left_anti"), now.join(before, ["path", "content_hash"], "left_semi")


def since(rows: DataFrame, time_col: str, moment: str) -> DataFrame:
    """The change feed after a moment."""
    return rows.where(F.col(time_col) > F.lit(moment).cast("timestamp"))


def passes_filters(repos: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """The repository records worth a second request: of a language that is searched, with a name and a licence, and not empty of pushes."""
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return repos.where(F.col("language").isin(*languages) & named("full_name") & named("license") & named("last_pushed"))


def resolved_tags(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """(repo, tag, sha) of refs (repo, tag, sha, annotated): an annotated tag gets the commit that its tag object names; objects is (sha, commit_sha). A tag whose object is missing, or names no commit, is dropped."""
    o = objects.groupBy(F.col("sha").alias("_sha")).agg(F.max("commit_sha").alias("_commit"))
    found = refs.join(o, refs["sha"] == o["_sha"], "left").withColumn("sha", F.when(F.col("annotated"), F.col("_commit")).otherwise(F.col("sha")))
    return found.where("sha is not null").select("repo", "tag", "sha")


def cursor(rows: DataFrame, time_col: str, id_col: str) -> DataFrame:
    """(moment, last_id): how far a crawl has come, by time and then id; one row, null for no rows."""
    return rows.agg(F.max(F.struct(F.col(time_col).alias("moment"), F.col(id_col).alias("last_id"))).alias("_c")).select("_c.moment", "_c.last_id")


def after_cursor(rows: DataFrame, at: DataFrame, time_col: str, id_col: str) -> DataFrame:
    """The rows that a cursor has not reached. at has one row, so its values become part of the filter."""
    moment, last = (at.select(c).scalar() for c in ("moment", "last_id"))
    later = (F.col(time_col) > moment) | ((F.col(time_col) == moment) & (F.col(id_col) > last))
    return rows.where(moment.isNull() | later)


def select_repos(repos: DataFrame, languages: tuple[str, ...], need_tags: bool = True) -> DataFrame:
    """(repo, tag, sha) of repos of the languages; with need_tags false also repos without tags, once, with null."""
    rows = repos.where(F.col("language").isin(*languages))
    explode = F.explode if need_tags else F.explode_outer
    return rows.select(F.col("full_name").alias("repo"), explode("tags").alias("t")).select("repo", F.col("t.name").alias("tag"), F.col("t.commit_sha").alias("sha"))


def version_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, op, row) of what leads from one version of a table to another: op is insert, update or delete, row the new columns as a struct, null if the row is gone. Both have the same columns and each key once; null keys are keys."""
    others = [c for c in after.columns if c not in keys]
    b = before.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(F.lit(1), *others).alias("_b"))
    a = after.select(*keys, F.struct(F.lit(1), *others).alias("_a"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    op = F.when(F.col("_b").isNull(), "insert").when(F.col("_a").isNull(), "delete").otherwise("update")
    rows = a.join(b, same, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    key = lambda k: F.when(F.col("_a").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k)
    return rows.select(*map(key, keys), op.alias("op"), F.when(F.col("_a").isNotNull(), F.struct(*(F.col("_a").getField(c).alias(c) for c in others))).alias("row"))


def with_changes(before: DataFrame, feed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The version that a feed of version_changes() makes of the one before."""
    changed = feed.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & before[k].eqNullSafe(F.col(f"_{k}"))
    return before.join(changed, same, "left_anti").unionByName(feed.where("op <> 'delete'").select(*keys, "row.*").select(*before.columns))


def stored_changes(spark: SparkSession, path: str, name: str, first: int, last: int, keys: tuple[str, ...]) -> DataFrame:
    """version_changes() of a stored table between two versions (operators.versions). Versions that share the table's files differ in nothing, and nothing of them is read."""
    a, b = (versions.manifest(spark, path, v)[1]["tables"][name]["folder"] for v in (first, last))
    before, after = versions.load(spark, path, first)[name], versions.load(spark, path, last)[name]
    return version_changes(before.limit(0), after.limit(0), keys) if a == b else version_changes(before, after, keys)
