"""Structural dedup: units kept once, and the index that rebuilds what they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..shared import materialise
from .tokens import tree_arrays


def dedup_exact(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(keep_id, n): the smallest id of each distinct text and how many have it. Texts meet as digests."""
    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("_key"))
    return keyed.groupBy("_key").agg(F.min("_id").alias("keep_id"), F.count("*").alias("n")).select("keep_id", "n")


def reduce_lines(docs: DataFrame, id_col: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(units (unit, body), index (file_id, pos, unit)): each distinct line once, and where it stands. unit is the line's digest, so separate runs agree on it."""
    lines = docs.select(F.col(id_col).cast("long").alias("file_id"), F.posexplode_outer(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("pos", "body"))
    lines = lines.withColumn("pos", F.col("pos").cast("long")).withColumn("unit", F.sha2("body", 256))
    return lines.groupBy("unit").agg(F.first("body").alias("body")), lines.select("file_id", "pos", "unit")


def rebuild(units: DataFrame, index: DataFrame) -> DataFrame:
    """(file_id, text): the inverse of reduce_lines."""
    return index.join(units, "unit").groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x.body), "\n").alias("text"))


def _trees(stream: DataFrame) -> DataFrame:
    return stream if "syms" in stream.columns else tree_arrays(stream)


def tree_classes(trees: DataFrame) -> DataFrame:
    """(file_id, n_nodes, n_files): the first of the files of each tree, of tree_arrays(). Trees meet as 128 bits of hashes."""
    keyed = trees.select("file_id", F.size("syms").cast("long").alias("n_nodes"), F.xxhash64("syms", "ends").alias("_h"), F.xxhash64(F.lit("second"), "syms", "ends").alias("_g"))
    return keyed.groupBy("_h", "_g").agg(F.min("file_id").alias("file_id"), F.min("n_nodes").alias("n_nodes"), F.count("*").alias("n_files")).drop("_h", "_g")


def tree_roots(stream: DataFrame) -> DataFrame:
    """(file_id, items): the roots of reduce_tree alone. Files given as tree_arrays() are not shuffled for it."""
    return kernels.tree_groups(_trees(stream), roots=True)


def reduce_tree(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units (unit, items), roots (file_id, items)) of a symbol stream with parent and end, or of its tree_arrays(): each distinct subtree, which is a bracket or a node and what it holds, once. items are (at, sym, unit): a symbol, or a symbol that opens the subtree unit, and its place within what the bracket holds. Names and lines do not count.

    A subtree is a run of its file's symbols, each with the length of what it opens, which tells its shape. Runs are told by hashes of all stretches of 1, 2, 4, ...
    symbols, made by doubling in Arrow batches: two stretches of the largest such size, at
    both ends of a run, cover it, and with its length they name it by 128 bits. So a file takes
    time by its length and the logarithm of that, however deep it is, and separate jobs agree on units.

    A task hands each subtree of a portion of files on once, so what files repeat is not shuffled.
    """
    trees = _trees(stream)
    return kernels.tree_groups(trees, roots=False).groupBy("unit").agg(F.first("items").alias("items")), tree_roots(trees)


def rebuild_tree(units: DataFrame, roots: DataFrame) -> DataFrame:
    """(file_id, syms): the inverse of reduce_tree. In each round the known ways down from one subtree to another double in length, and carry what is known of a file twice as deep: about log2 of the deepest tree's levels rounds. A way of some length ends at each subtree of a file once, so there are never more ways than subtrees in the files."""
    items = materialise(units.select("unit", "items"))
    top = materialise(roots.select("file_id", "items"))
    inside = lambda rows, key: rows.select(key, F.explode(F.filter("items", lambda i: i.unit.isNotNull())).alias("i")).select(key, (F.col("i.at") + 1).alias("at"), F.col("i.unit").alias("unit"))
    # Subtrees of files are stored once, those of each round in a table of their own.
    found = materialise(inside(top, "file_id"))
    ways = inside(items.withColumnRenamed("unit", "_from"), "_from").select("_from", F.col("at").alias("_at"), F.col("unit").alias("_to"))
    while True:
        ways = materialise(ways)
        fresh = materialise(found.join(ways, F.col("unit") == F.col("_from")).select("file_id", (F.col("at") + F.col("_at")).alias("at"), F.col("_to").alias("unit")))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
        then = ways.select(F.col("_from").alias("_via"), F.col("_at").alias("_on"), F.col("_to").alias("_end"))
        ways = ways.join(then, F.col("_to") == F.col("_via")).select("_from", (F.col("_at") + F.col("_on")).alias("_at"), F.col("_end").alias("_to")).distinct()
    # A subtree brings what it holds as arrays; symbols are put in order in Arrow batches.
    part = lambda start: F.struct(start.alias("start"), F.col("items.at").alias("at"), F.col("items.sym").alias("sym")).alias("part")
    every = top.select("file_id", part(F.lit(0).cast("long"))).unionByName(found.join(items, "unit").select("file_id", part(F.col("at"))))
    return kernels.assembled(every.groupBy("file_id").agg(F.collect_list("part").alias("parts")))
