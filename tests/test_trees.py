"""Trees of brackets: reduced, rebuilt, and very deep ones."""

import random
import time

from reuselens.operators import dedup, tokens


def nested_by_scanning(found):
    """nested() by looking through the open brackets each time."""
    parent, end, error, open_ = [], [], [], []
    pairs = {")": "(", "]": "[", "}": "{"}
    for k, (_, _, kind, _) in enumerate(found):
        closes = kind in pairs and any(found[i][2] == pairs[kind] for i in open_)
        while closes and found[open_[-1]][2] != pairs[kind]:
            i = open_.pop()
            error[i], end[i] = True, k - 1
        parent.append(open_[-1] if open_ else -1)
        end.append(k)
        error.append(kind in pairs and not closes or kind == "@")
        if closes:
            end[open_.pop()] = k
        elif kind in pairs.values():
            open_.append(k)
    for i in open_:
        error[i], end[i] = True, len(found) - 1
    return parent, end, error


def test_brackets_of_any_order():
    rng = random.Random(1)
    for _ in range(300):
        found = tokens.cpp_tokens(" ".join(rng.choice("(((()))[]{}}x;@") for _ in range(rng.randrange(0, 60))))
        assert tokens.nested(found) == nested_by_scanning(found)


def test_depth_takes_linear_time():
    times = []
    for n in (20_000, 80_000):
        found = tokens.cpp_tokens("( " * n + "] " * n)
        began = time.time()
        tokens.nested(found)
        times.append(time.time() - began)
    assert times[1] < 16 * times[0] + 1


def test_a_tree_of_ten_thousand_levels(spark):
    n = 10_000
    texts = {1: "( " * n + "x " + ") " * n, 2: "{ " * 40 + "( x ) ( x ) ; " + "} " * 40, 3: "", 4: "a b c", 5: "( ( x ) ( x ) ) ( ( x ) ( x ) )"}
    stream = tokens.cpp_stream(spark.createDataFrame(list(texts.items()), "id long, content string"), "id").cache()
    units, roots = dedup.reduce_tree(stream)
    want = {r.file_id: r.syms for r in tokens.symbol_arrays(stream).collect()}
    units = units.cache()
    # n of the first file, of which (x) is one of others too; 40 of the second; ((x)(x)) of the last.
    assert units.count() == n + 40 + 1
    assert {r.file_id: r.syms for r in dedup.rebuild_tree(units, roots).collect()} == want


def test_random_trees(spark):
    rng = random.Random(2)
    texts = [(k, " ".join(rng.choice("(((())){}[]x;") for _ in range(rng.randrange(0, 80)))) for k in range(80)]
    stream = tokens.cpp_stream(spark.createDataFrame(texts, "id long, content string"), "id").cache()
    units, roots = dedup.reduce_tree(stream)
    held = {}
    for r in sorted(stream.collect(), key=lambda r: (r.file_id, r.pos)):
        held.setdefault(r.file_id, []).append(r)
    assert units.count() == len({tuple(x.sym for x in rows[r.pos : r.end + 1]) for rows in held.values() for r in rows if r.end > r.pos})
    assert {r.file_id: r.syms for r in dedup.rebuild_tree(units, roots).collect()} == {i: [x.sym for x in rows] for i, rows in held.items()}
