"""Trees of many files at once: nesting, reduction and rebuilding in Arrow batches."""

import itertools
import random

from reuselens.functions import kernels
from reuselens.operators import dedup, tokens


def test_brackets_of_many_files_nest_as_those_of_one():
    rng = random.Random(7)
    for _ in range(200):
        found = [tokens.cpp_tokens(" ".join(rng.choice("(((()))[]{}}x;@") for _ in range(rng.randrange(0, 30)))) for _ in range(rng.randrange(1, 15))]
        found += [[], tokens.cpp_tokens("{ ( x ) [ ( ) ] }"), tokens.cpp_tokens("( ]")]
        rng.shuffle(found)
        made = tokens.nested_files([len(some) for some in found], {"kind": [[kind for _, _, kind, _ in some] for some in found]})
        for name, k in (("parent", 0), ("end", 1)):
            assert made[name][0].tolist() == list(itertools.chain.from_iterable(tokens.nested(some)[k] for some in found))


def test_a_subtree_leaves_a_batch_once(spark, monkeypatch):
    """Every file made the names of its subtrees three times, a symbol at a time."""
    monkeypatch.setattr(kernels, "PORTION", 64)
    rng = random.Random(8)
    texts = [(k, "{ " * (k % 4) + " ".join(rng.choice(("( x ) ;", "[ ( x ) ]", "( if x )")) for _ in range(rng.randrange(0, 12))) + " }" * (k % 4)) for k in range(60)]
    stream = tokens.cpp_stream(spark.createDataFrame(texts, "id long, content string"), "id").cache()
    trees = tokens.tree_arrays(stream).coalesce(1).cache()
    one = trees.where("file_id < 4").coalesce(1)
    handed = kernels.tree_groups(trees, roots=False)
    n_rows, n_files = handed.count(), trees.count()
    units, roots = dedup.reduce_tree(trees)
    assert units.count() <= n_rows < sum(1 for r in stream.collect() if r.end > r.pos)
    assert roots.count() == n_files
    # Other portions and other jobs agree on names.
    monkeypatch.undo()
    names = {r.unit: r["items"] for r in units.collect()}
    assert {r.unit: r["items"] for r in dedup.reduce_tree(one)[0].collect()}.items() <= names.items()
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert {r.file_id: r.syms for r in dedup.rebuild_tree(units, roots).collect()} == {r.file_id: r.syms for r in trees.collect()}
