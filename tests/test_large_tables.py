"""What grew faster than its input, or took more of a machine than the work needs."""

import lzma
import random
import time

from reuselens.operators import codec, search, windowindex


def test_short_blobs_are_packed_without_large_tables():
    blobs = [b"%d some words of a short text " % k * (1 + k % 40) for k in range(300)]
    start = time.process_time()
    whole = [lzma.compress(b, preset=5) for b in blobs]
    middle = time.process_time()
    packed = [codec.pack(b, "lzma") for b in blobs]
    took = time.process_time() - middle
    assert took < 0.6 * (middle - start)
    assert [-(-(len(b) + 12) // 4) * 4 for b in whole] == [len(b) for b in packed]
    assert [codec.unpack(b) for b in packed] == blobs
    for n in (0, 1, 4095, 4096, 4097, 70_000):
        assert codec.unpack(codec.pack(b"ab1" * n, "lzma")) == b"ab1" * n


def test_blobs_of_one_piece_are_packed_by_all_tasks(spark):
    blobs = spark.range(0, 64, 1, 1).selectExpr("id", "encode(repeat(string(id), 50), 'UTF-8') as data")
    for found in (codec.round_trips(blobs), codec.sizes(blobs)):
        assert "Exchange hashpartitioning(id" in found._jdf.queryExecution().executedPlan().toString()
    assert codec.round_trips(blobs).where("same").count() == 64 * 8


def reused(files, k):
    """Ranges by the first place of every window."""
    first, hits = {}, set()
    for i, syms in sorted(files.items()):
        for p in range(len(syms) - k + 1):
            at = first.setdefault(tuple(syms[p : p + k]), (i, p))
            if at[0] < i:
                hits.add((at[0], i, at[1], p))
    out = []
    for b, s, x, y in hits:
        if (b, s, x - 1, y - 1) not in hits:
            n = 0
            while (b, s, x + n + 1, y + n + 1) in hits:
                n += 1
            out.append((b, s, x, x + n + k - 1, y, y + n + k - 1))
    return sorted(out)


def test_reuse_carries_no_files_with_windows(spark, monkeypatch):
    """Each window of a shared passage took all symbols of both its files along."""
    monkeypatch.setattr(search, "verified", None)
    rng = random.Random(1)
    for k in (1, 2, 5, 8, 13):
        files = {0: [], 1: [3] * 40, 2: [3] * 25 + [1, 2] * 20}
        for i in range(3, 60):
            syms = [rng.randrange(1, 4 if i % 7 == 0 else 10**6) for _ in range(rng.randrange(0, 40))]
            other = rng.choice(list(files.values()))
            a = rng.randrange(0, len(other) + 1)
            files[i] = syms + other[a : a + rng.randrange(0, 50)] + syms[: rng.randrange(0, 20)]
        found = search.reuse(spark.createDataFrame(list(files.items()), "file_id long, syms array<bigint>"), k)
        assert sorted(tuple(r) for r in found.select("base_id", "search_id", "base_start", "base_end", "search_start", "search_end").collect()) == reused(files, k)


def test_the_index_is_grouped_inside_the_row(spark, tmp_path):
    files = spark.createDataFrame([(1, [1, 2, 3, 1, 2, 3, 1]), (2, []), (3, [3, 1, 2]), (3, [2, 3, 1, 5]), (None, [7, 8, 9])], "file_id long, syms array<bigint>")
    once = files.where("file_id < 3")
    assert "Exchange" not in search.window_index(once, 3)._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in files.collect():
        for w in search.windows(spark.createDataFrame([r], files.schema), 3).collect():
            want.setdefault((w.fp, w.file_id), []).append(w.pos)
    for some in (files, once):
        ids = {r.file_id for r in some.collect()}
        assert {(r.fp, r.file_id): r.positions for r in search.window_index(some, 3).collect()} == {key: sorted(p) for key, p in want.items() if key[1] in ids}


def test_merging_keeps_rows_and_groups_those_of_files_of_several_segments(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    one, two = ([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3])], [(2, [9, 1, 2, 3]), (3, [4, 5, 6]), (None, [1, 2, 3])])
    seen, written = [], windowindex._written
    monkeypatch.setattr(windowindex, "_written", lambda rows, folder: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), written(rows, folder)))
    frame = lambda rows: spark.createDataFrame(rows, "file_id long, syms array<bigint>")
    windowindex.add_segment(frame(one), path, "a", 3)
    windowindex.add_segment(frame(two[1:]), path, "b", 3)
    windowindex.merge_segments(spark, path)
    # Nothing is shuffled but to write the rows in their order.
    assert "Exchange" not in seen[-1] and "Aggregate" not in seen[-1]
    windowindex.add_segment(frame(two[:1]), path, "c", 3)
    windowindex.merge_segments(spark, path, "again")
    assert list(windowindex.segments(spark, path)) == ["again"]
    rows = [(r.file_id, tuple(r.positions)) for r in windowindex.index_rows(spark, path).collect()]
    assert sorted(rows, key=repr) == sorted(wanted_rows(spark, one + two), key=repr)


def wanted_rows(spark, files):
    found = {}
    for i, syms in files:
        for w in search.windows(spark.createDataFrame([(i, syms)], "file_id long, syms array<bigint>"), 3).collect():
            found.setdefault((w.fp, i), set()).add(w.pos)
    return [(i, tuple(sorted(p))) for (_, i), p in found.items()]
