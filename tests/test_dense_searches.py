"""Searches whose windows nearly all meet: their ranges are as many as pairs of files, and nothing but files may be shuffled."""

import random

from reuselens.functions import kernels
from reuselens.operators import search, tokens
from reuselens.plans import queries
from reuselens.sources import files


def some(spark, rng, n, first):
    rows = []
    for i in range(n):
        syms = [rng.randrange(0, 2 if i % 5 == 0 else 4) for _ in range(rng.randrange(0, 60))]
        if i % 9 == 0:
            syms = list(range(rng.randrange(100, 150), 6000)) if i % 18 else [7, 8, 9] * rng.randrange(0, 20)
        rows.append((first + i, syms, [f"n{rng.randrange(0, 5)}" if i % 3 else f"m{i}{x % 9}" for x in syms], [k // 4 + 1 for k, _ in enumerate(syms)]))
    return spark.createDataFrame(rows, "file_id long, syms array<bigint>, names array<string>, lines array<bigint>")


def rows_of(found, columns):
    return sorted(tuple(r) for r in found.select(columns).collect())


def test_blocks_give_the_ranges_of_a_search(spark, monkeypatch):
    rng = random.Random(3)
    base, wanted = some(spark, rng, 30, 0).cache(), some(spark, rng, 12, 5).cache()
    for k, block in ((1, 1 << 21), (5, 900), (33, 1 << 21)):
        want = search.search(base, wanted, k)
        want = rows_of(want, want.columns)
        monkeypatch.setattr(kernels, "BASE_BLOCK", block)
        monkeypatch.setattr(kernels, "SEARCH_BLOCK", block)
        monkeypatch.setattr(kernels, "PAIRS", 1000)
        got = search.search_blocks(base, wanted, k)
        assert rows_of(got, got.columns) == want
        monkeypatch.undo()
    empty = wanted.where("file_id < 0")
    assert search.search_blocks(base, empty, 4).isEmpty() and search.search_blocks(empty, wanted, 4).isEmpty()


def test_a_task_of_ranges_has_one_block(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BASE_BLOCK", 400)
    monkeypatch.setattr(kernels, "SEARCH_BLOCK", 200)
    rng = random.Random(4)
    found = search.search_blocks(some(spark, rng, 40, 0), some(spark, rng, 40, 0), 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Files are shuffled once; no windows, and no ranges with what they cover.
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    assert found.rdd.getNumPartitions() > 8


def test_code_searches_shuffle_no_windows(spark, monkeypatch):
    monkeypatch.setattr(search, "merged", None)
    monkeypatch.setattr(search, "verified_ranges", None)
    assert queries.cpp_search(spark, "/root/testdata/sf0.001").count() >= 0


def test_blocks_give_the_rows_of_a_deep_search(spark, monkeypatch):
    rng = random.Random(6)
    base, wanted = some(spark, rng, 20, 0).cache(), some(spark, rng, 10, 5).cache()
    want = search.search_deep(base, wanted, 7)
    columns = want.columns
    want = rows_of(want, columns)
    assert {r[-1] for r in want} == {True, False}
    for side in ("BASE_BLOCK", "SEARCH_BLOCK"):
        monkeypatch.setattr(kernels, side, 500)
    monkeypatch.setattr(search, "deep_ranges", None)
    assert rows_of(search.search_blocks(base, wanted, 7, deep=True), columns) == want
    assert queries.cpp_search_deep(spark, "/root/testdata/sf0.001").columns == columns


def test_words_of_a_line_are_its_tokens():
    rng = random.Random(5)
    parts = ["a", "if", "x1", "12", "1e+5", "->*", "<<=", "(", "}", "@", "::", " ", "  ", "\t", "\x0b", " ", "\n", "//", "/", "*", '"', "'", "#", "é", ".5", "u8", "R"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        if "/*" in text or 'R"' in text:
            continue
        want = [(k, kind, word) for k, body in enumerate(text.split("\n"), 1) for _, kind, word in tokens._found(body)]
        assert [(line, kind, word) for line, _, kind, word in tokens.cpp_tokens(text)] == want
        made = tokens.cpp_flat(text)
        assert list(zip(made["line"], made["name"], made["sym"], strict=True)) == [(line, word, tokens.symbols([kind])[0]) for line, kind, word in want]


def test_deep_scans_carry_paths_without_a_join(spark):
    found = files.typed(spark.createDataFrame([("a.cpp", "int x ;\ny"), ("b.txt", "Hello there"), ("c.cpp", ""), ("d.bin", "z")], "path string, content string"))
    made = files.scan_deep(found)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path, r.source_type, r.names, r.lines) for r in made.collect()) == [("a.cpp", "cpp", ["int", "x", ";", "y"], [1, 1, 1, 2]), ("b.txt", "text", ["hello", "there"], [1, 1])]
