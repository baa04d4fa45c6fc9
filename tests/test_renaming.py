"""Ranges that one renaming explains."""

import random
import time

from reuselens.operators import search


def test_previous_places(spark):
    rng = random.Random(1)
    lists = [[rng.choice("abcdef") for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "id long, names array<string>").select("id", search.previous_places("names").alias("back")).collect()
    for r in got:
        names = lists[r.id]
        assert r.back == [next((d for d in range(1, i + 1) if names[i - d] == x), 0) for i, x in enumerate(names)]


def explained(a, b):
    """Names from the start on that a one-to-one renaming explains."""
    there, back = {}, {}
    for n, (x, y) in enumerate(zip(a, b, strict=True)):
        if there.setdefault(x, y) != y or back.setdefault(y, x) != x:
            return n
    return len(a)


def test_renamed_ranges(spark):
    rng, k = random.Random(2), 5
    base, wanted, ranges = {}, {}, []
    for i in range(120):
        names = [rng.choice("abcdefgh") for _ in range(40)]
        to = dict(zip("abcdefgh", rng.sample("abcdefgh", 8), strict=True)) if rng.random() < 0.6 else {c: rng.choice("abcd") for c in "abcdefgh"}
        other = [to[c] if rng.random() < 0.97 else "z" for c in names]
        shift = rng.randrange(0, 6)
        base[i], wanted[i] = names, ["x", "a", "b", "y", "c", "d"][:shift] + other
        a = rng.randrange(0, 30)
        z = rng.randrange(a + k, 40)
        ranges.append((i, i, a, z, a + shift, z + shift))
    frame = lambda files: spark.createDataFrame([(i, n, [1] * len(n)) for i, n in files.items()], "file_id long, names array<string>, lines array<bigint>")
    found = search.deep_ranges(spark.createDataFrame(ranges, "base_id long, search_id long, base_start long, base_end long, search_start long, search_end long"), frame(base), frame(wanted)).collect()
    assert len(found) == 120 and {r.consistent for r in found} == {True, False}
    for r in found:
        x, y = base[r.base_id][r.base_start : r.base_end + 1], wanted[r.search_id][r.search_start : r.search_end + 1]
        assert (r.n_renamed, r.explained, r.consistent) == (sum(p != q for p, q in zip(x, y, strict=True)), explained(x, y), explained(x, y) == len(x))


def test_previous_places_of_a_long_file(spark):
    """Sorted names are made once a file, not once a name: a file of 20,000 took minutes."""
    names = [str(i * i % 7919) for i in range(20_000)]
    started = time.time()
    back = spark.createDataFrame([(names,)], "names array<string>").select(search.previous_places("names").alias("back")).first().back
    last, wanted = {}, []
    for i, x in enumerate(names):
        wanted.append(i - last.get(x, i))
        last[x] = i
    assert back == wanted
    assert time.time() - started < 20
