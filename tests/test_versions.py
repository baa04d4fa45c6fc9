"""Stored versions: atomic saves, claims and change feeds."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from reuselens.operators import catalogue, incremental, versions


def scans(spark, n):
    return spark.createDataFrame([(k, f"scan {k}", "Started" if k % 3 else "Finished") for k in range(n)], "id long, name string, status string")


def test_load_change_save(spark, tmp_path):
    """The tables may be made of those that they replace; what is not named stays and is not written again."""
    path = str(tmp_path / "catalogue")
    assert versions.load(spark, path) == {} and versions.load(spark, path).version == 0
    assert catalogue.save({"group": spark.createDataFrame([(1, "a")], "id long, name string"), "scan": scans(spark, 3)}, path) == 1
    held = catalogue.load(spark, path)
    assert catalogue.save({"group": catalogue.rename(held["group"], 1, "b")}, path, held.version) == 2
    again = catalogue.load(spark, path)
    assert (again.version, again["group"].first().name, again["scan"].count()) == (2, "b", 3)
    # The version before is still there, for who reads it.
    assert held["group"].first().name == "a" and catalogue.load(spark, path, 1)["group"].first().name == "a"
    assert versions.manifest(spark, path, 1)[1]["tables"]["scan"] == versions.manifest(spark, path, 2)[1]["tables"]["scan"]
    catalogue.save({"group": again["group"].where("false")}, path)
    assert catalogue.load(spark, path)["group"].columns == ["id", "name"] and catalogue.load(spark, path)["group"].count() == 0
    with pytest.raises(KeyError):
        versions.load(spark, path, 9)
    assert versions.expire(spark, path, keep=1) == 2 and catalogue.load(spark, path)["scan"].count() == 3


def test_a_save_that_fails_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    catalogue.save({"group": spark.createDataFrame([(1, "a")], "id long, name string"), "scan": scans(spark, 3)}, path)
    bad = spark.range(10).select("id", F.when(F.col("id") < 9, "x").otherwise(F.raise_error(F.lit("broken"))).alias("name"))
    with pytest.raises(Exception, match="broken"):
        catalogue.save({"scan": scans(spark, 5), "group": bad}, path)
    held = catalogue.load(spark, path)
    assert (held.version, held["group"].first().name, held["scan"].count()) == (1, "a", 3)


def test_the_first_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    catalogue.save({"scan": scans(spark, 3)}, path)
    one, two = catalogue.load(spark, path), catalogue.load(spark, path)
    catalogue.save({"scan": catalogue.rename(one["scan"], 0, "first")}, path, one.version)
    with pytest.raises(versions.Conflict):
        catalogue.save({"scan": catalogue.rename(two["scan"], 1, "second")}, path, two.version)
    assert catalogue.update(spark, path, lambda held: {"scan": catalogue.rename(held["scan"], 1, "second")}) == 3
    assert {r.id: r.name for r in catalogue.load(spark, path)["scan"].collect()} == {0: "first", 1: "second", 2: "scan 2"}


def test_put_if_absent(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda k: versions.put_if_absent(spark, str(tmp_path / "x" / "file"), f"text {k}"), range(16)))
    assert sum(done) == 1
    assert (tmp_path / "x" / "file").read_text() == f"text {done.index(True)}"
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.endswith(".crc")] == ["file"]


def test_claims_at_once(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    catalogue.save({"scan": scans(spark, 7)}, path)
    with ThreadPoolExecutor(3) as pool:
        taken = list(pool.map(lambda _: catalogue.claim(spark, path), range(6)))
    assert sorted(t for t in taken if t is not None) == [1, 2, 4, 5] and taken.count(None) == 2
    assert {r.id for r in catalogue.load(spark, path)["scan"].where("status = 'Running'").collect()} == {1, 2, 4, 5}


def test_changes_between_versions(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0), (None, "n", 4.0)], "id long, name string, x double")
    after = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, None, 4.0), (5, None, None)], "id long, name string, x double")
    feed = incremental.version_changes(before, after, ("id",))
    assert {(r.id, r.op, r.row and tuple(r.row)) for r in feed.collect()} == {(2, "update", ("b", 2.0)), (3, "delete", None), (None, "update", (None, 4.0)), (5, "insert", (None, None))}
    made = incremental.with_changes(before, feed, ("id",))
    assert sorted(map(str, made.collect())) == sorted(map(str, after.collect())) and made.columns == after.columns
    assert incremental.version_changes(after, after, ("id", "name")).count() == 0


def test_stored_changes(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = scans(spark, 4)
    versions.save(spark, {"scan": rows}, path)
    versions.save(spark, {"other": rows}, path)
    versions.save(spark, {"scan": rows.where("id > 0")}, path)
    assert incremental.stored_changes(spark, path, "scan", 1, 2, ("id",)).count() == 0
    assert [(r.id, r.op) for r in incremental.stored_changes(spark, path, "scan", 1, 3, ("id",)).collect()] == [(0, "delete")]
