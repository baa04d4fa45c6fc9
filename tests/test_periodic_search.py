"""Periodic runs and the self search over them, against brute force."""

import random

from reuselens.operators import search


def runs_of(syms, k):
    """(a, z, period, word) by trying every period."""
    found = {}
    for p in range(1, k // 2 + 1):
        i = 0
        while i + p < len(syms):
            j = i
            while j + p < len(syms) and syms[j] == syms[j + p]:
                j += 1
            if j > i and j + p - i >= k:
                found.setdefault((i, j + p - 1), p)
            i = max(j, i) + 1
    return sorted((a, z, p, min(" ".join(map(str, syms[a + t : a + t + p])) for t in range(p))) for (a, z), p in found.items())


def ranges_of(files, k):
    out = set()
    first = {}
    for i, syms in sorted(files.items()):
        first.setdefault(tuple(syms), i)
    kept = {i: files[i] for i in first.values()}
    runs = {i: runs_of(syms, k) for i, syms in kept.items()}
    for b in kept:
        for s in kept:
            if b >= s:
                continue
            x, y = kept[b], kept[s]
            out |= {(b, s, p[0], p[1], q[0], q[1]) for p in runs[b] for q in runs[s] if p[3] == q[3]}
            for shift in range(-len(y), len(x)):
                i = max(0, -shift)
                while i < len(y) and i + shift < len(x):
                    j = i
                    while j < len(y) and j + shift < len(x) and y[j] == x[j + shift]:
                        j += 1
                    if j - i >= k and not any(a <= i + shift and j - 1 + shift <= z for a, z, *_ in runs[b]):
                        out.add((b, s, i + shift, j - 1 + shift, i, j - 1))
                    i = j + 1
    return sorted(out)


def some_files(rng, n):
    files = {}
    for i in range(n):
        syms = []
        for _ in range(rng.randrange(0, 8)):
            word = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 7))]
            syms += word * rng.choice([1, 1, 2, 5, 9]) + [rng.randrange(100, 10**6) for _ in range(rng.choice([0, 0, 1, 12]))]
        if files and rng.random() < 0.4:
            other = rng.choice(list(files.values()))
            a = rng.randrange(0, len(other) + 1)
            syms = syms[: len(syms) // 2] + other[a : a + rng.randrange(0, 60)] + syms[len(syms) // 2 :]
        files[i] = syms
    return files


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "file_id long, syms array<bigint>")


def test_periodic_runs(spark):
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8, 12):
        files = some_files(rng, 120) | {1000: [], 1001: [7], 1002: [7] * 400, 1003: [7, 8] * 200 + [7], 1004: [1, 2, 3] * 3 + [1]}
        got = {r.file_id: sorted(map(tuple, r.runs)) for r in search.periodic_runs(frame(spark, files), k).collect()}
        assert got == {i: runs_of(syms, k) for i, syms in files.items()}


def test_self_search_with_repeated_words(spark):
    rng = random.Random(2)
    for k in (4, 8, 11):
        files = some_files(rng, 40)
        files |= {100: [5] * 60, 101: [9, 5, 5] + [5] * 30 + [8], 102: [1, 2] * 30 + [9], 103: [9] + [2, 1] * 20, 104: files[3], 105: []}
        got = sorted(tuple(r) for r in search.self_search(frame(spark, files), k).select("base_id", "search_id", "base_start", "base_end", "search_start", "search_end").collect())
        assert got == ranges_of(files, k)


def test_a_repeated_word_gives_a_row_for_each_pair_of_runs(spark):
    """Two runs of 900 and 700 equal symbols agree at 1,500 shifts, and are one row."""
    files = {1: list(range(100, 150)) + [7] * 900 + list(range(200, 250)), 2: list(range(300, 350)) + [7] * 700 + list(range(400, 450))}
    assert [tuple(r) for r in search.self_search(frame(spark, files), 64).collect()] == [(1, 2, 50, 949, 50, 749)]
