"""The stored window index, and clustered blobs."""

import random

import pytest
from pyspark.sql import functions as F

from reuselens.operators import search, store, versions, windowindex


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "file_id long, syms array<bigint>")


def some(rng, ids):
    shared = [rng.randrange(10**6) for _ in range(40)]
    return {i: [rng.randrange(10**6) for _ in range(rng.randrange(0, 60))] + shared[i % 7 : 20 + i % 15] for i in ids}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_segments(spark, tmp_path):
    path, rng, k = str(tmp_path / "index"), random.Random(1), 8
    old, new, wanted = some(rng, range(0, 30)), some(rng, range(30, 40)), some(rng, range(100, 106))
    wanted[106], wanted[107] = new[33], []
    base, found = frame(spark, old | new), frame(spark, wanted)
    assert windowindex.search_index(spark, path, base, found, k).count() == 0
    assert windowindex.add_segment(frame(spark, old), path, "v1", k) == 1
    assert rows(windowindex.search_index(spark, path, base, found, k)) == rows(search.search(frame(spark, old), found, k))
    # A new tag is a segment of its own; the old one's files are left as they are.
    before = versions.manifest(spark, path)[1]["segments"]["v1"]
    windowindex.add_segment(frame(spark, new), path, "v2", k)
    assert versions.manifest(spark, path)[1]["segments"]["v1"] == before
    want = rows(search.search(base, found, k))
    assert want and rows(windowindex.search_index(spark, path, base, found, k)) == want
    assert rows(search.windows(base, k).select("fp", "file_id")) == rows(windowindex.index_rows(spark, path).select("fp", F.explode("positions").alias("p"), "file_id").select("fp", "file_id"))
    windowindex.merge_segments(spark, path)
    assert list(windowindex.segments(spark, path)) == ["merged"] and rows(windowindex.search_index(spark, path, base, found, k)) == want
    windowindex.remove_segment(spark, path, "merged")
    assert windowindex.index_rows(spark, path).count() == 0 and len(windowindex.segments(spark, path, 2)) == 2
    with pytest.raises(ValueError):
        windowindex.add_segment(base, path, "v3", k + 1)


def test_a_search_reads_the_ranges_that_it_needs(spark, tmp_path):
    path, rng, k = str(tmp_path / "index"), random.Random(2), 8
    files = some(rng, range(20))
    windowindex.add_segment(frame(spark, files), path, "all", k)
    wanted = frame(spark, {1: files[3][:9]})
    plan = windowindex.index_candidates(spark, path, wanted, k)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "range#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.range for r in windowindex.index_rows(spark, path).select("range").distinct().collect()} >= {r[0] for r in search.windows(wanted, k).select((F.col("fp") / 2**windowindex.RANGE_BITS).cast("int")).collect()}


def test_clustered_blobs_are_not_shuffled(spark, tmp_path):
    rng = random.Random(3)
    trees = [(d, i, [rng.randrange(9) for _ in range(4)]) for d in range(50) for i in range(3)]
    kept = spark.createDataFrame(trees, "data_id long, data_index long, syms array<bigint>")
    held = store.clustered(kept, str(tmp_path / "blobs"), ("data_id", "data_index"), 4)
    again = store.clustered_again(spark, str(tmp_path / "blobs"), "data_id bigint, data_index bigint, syms array<bigint>", ("data_id", "data_index"), 4)
    file = spark.createDataFrame([(n, rng.randrange(55), rng.randrange(4), 1, n % 5) for n in range(200)], "id long, data_id long, file_index long, path_id long, tag_id long")
    tag, name = spark.createDataFrame([(1, "sha")], "id long, sha string"), spark.createDataFrame([(1, "p")], "id long, name string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for blobs in (held, again):
            joined = store.files(file, tag, name, blobs)
            assert rows(joined) == rows(store.files(file, tag, name, kept)) != []
            scan = [x for x in joined._jdf.queryExecution().executedPlan().toString().split("\n") if "clustered_" in x or "Bucketed: true" in x]
            plan = joined._jdf.queryExecution().executedPlan().toString().split("\n")
            at = next(k for k, x in enumerate(plan) if "Bucketed: true" in x)
            depth = lambda x: len(x) - len(x.lstrip(" :+-"))
            above, level = [], depth(plan[at])
            for x in reversed(plan[:at]):
                if depth(x) < level:
                    above.append(x)
                    level = depth(x)
            between = above[: next(k for k, x in enumerate(above) if "Join" in x)]
            assert scan and not any("Exchange" in x for x in between)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
