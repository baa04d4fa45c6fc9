"""Filter interaction audit: what each filter removes in every order of the filters."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch, text_or_empty, words_of

FILTERS = ("A", "B", "C", "D", "E")
#: Filters at most: the rows of the result grow with the factorial of their number.
MOST = 6


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, A to E, good, toxic) of every row of docs: whether it fails each of the five filters, and its labels.

    A: under 100 words; B: less than 80 % of the words are distinct; C: more than 10 % of the
    code points are A-Z; D: it holds one of #$%&*|; E: a row with a smaller doc_id has the same text.

    A null text is empty, and a null part is an empty string. A null doc_id counts as larger than any
    other; rows that repeat a doc_id do not fail E by each other. Of repeated labels any that says good,
    or toxic, counts; labels of null ids count for nothing. Texts are read whole, however long, and
    never shuffled: E compares SHA-256 digests, joined with those that more than one row has, so a
    group of copies can be split. Other columns are not read.
    """
    at = scratch(docs.sparkSession)
    text, words = F.col("_text"), F.col("_words")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("_text")).withColumn("_words", words_of(text))
    rows = rows.select(
        "doc_id", "part",
        (F.size(words) < 100).alias("A"),
        (100 * F.size(F.array_distinct(words)) < 80 * F.size(words)).alias("B"),
        (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text)).alias("C"),
        text.rlike(r"[#$%&*|]").alias("D"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
    )
    rows = materialise(rows, f"{at}/measured")
    copies = rows.groupBy(F.col("_digest").alias("_of")).agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(materialise(copies.drop("_n"), f"{at}/copies"), F.col("_digest") == F.col("_of"), "left")
    later = F.col("_first").isNotNull() & (F.col("doc_id").isNull() | (F.col("_first") < F.col("doc_id")))
    rows = rows.select("doc_id", "part", "A", "B", "C", "D", later.alias("E"))
    said = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(materialise(said, f"{at}/labels"), F.col("doc_id") == F.col("_id"), "left")
    return rows.select("doc_id", "part", *FILTERS, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def _state(filters: tuple[str, ...], some) -> str:
    return ",".join(f for f in filters if f in some)


def survivors(rows: DataFrame, filters: tuple[str, ...]) -> dict[str, DataFrame]:
    """Set of filters to the rows that pass them all, each a stored table. The trie of all orders is walked depth first; a set of filters that another order has reached is not made again, so 2 ** n tables serve n! orders. Null verdicts pass."""
    at = scratch(rows.sparkSession)
    made = {"": materialise(rows, f"{at}/all")}

    def visit(before: frozenset) -> None:
        for f in filters:
            after = before | {f}
            if f not in before and _state(filters, after) not in made:
                name = _state(filters, after)
                made[name] = materialise(made[_state(filters, before)].where(~F.coalesce(F.col(f), F.lit(False))), f"{at}/{len(made)}")
                visit(after)

    visit(frozenset())
    return made


def filter_audit(rows: DataFrame, filters: tuple[str, ...] = FILTERS, part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """One row per part, filter_order and step of rows with a boolean column for each filter (true: it fails): kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, counts within the part, zeros included.

    The survivors of every set of filters are stored (survivors()), and one aggregate over all of
    them counts what each further filter removes: the edges of the trie. Every order is a path of
    edges. Names of one letter are joined as they are in filter_order, longer ones by commas.

    Counts combine before the shuffle, so a part with most of the rows is counted by all tasks.
    Null verdicts pass, null parts are an empty string; rows may repeat, and each counts. No rows give
    no parts, so an empty result. Other columns are not read.
    """
    if not 1 <= len(filters) <= MOST or len(set(filters)) < len(filters) or any("," in f for f in filters):
        raise ValueError(f"from one to {MOST} filters of different names without commas")
    spark, at, n = rows.sparkSession, scratch(rows.sparkSession), len(filters)
    slim = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), F.col(good).alias("_good"), F.col(toxic).alias("_toxic"), *filters)
    every = None
    for state, left in survivors(slim, filters).items():
        left = left.withColumn("_state", F.lit(state))
        every = left if every is None else every.unionByName(left)
    fails = lambda f: F.coalesce(F.col(f), F.lit(False))
    edge = lambda f: F.struct(F.lit(f).alias("filter"), F.count_if(fails(f)).alias("removed"), F.count_if(fails(f) & F.col("_good")).alias("good_lost"), F.count_if(fails(f) & F.col("_toxic")).alias("toxic_lost"))
    counts = materialise(every.groupBy("_part", "_state").agg(F.count("*").alias("_left"), F.array(*map(edge, filters)).alias("_edges")), f"{at}/counts")

    # Every edge of the trie, and every step of every order; both are tables of fixed size.
    names = {state: [f for f in filters if f not in state.split(",")] for state in {_state(filters, order[:k]) for order in permutations(filters) for k in range(n)}}
    kind = "array<struct<before string, filter string, after string, orders bigint>>"
    edges = [(state, f, _state(filters, [*state.split(","), f]), math.factorial(n - len(left)) * math.factorial(len(left) - 1)) for state, left in names.items() for f in left]
    steps = [("".join(order) if max(map(len, filters)) == 1 else ",".join(order), k + 1, _state(filters, order[:k]), f) for order in permutations(filters) for k, f in enumerate(order)]
    trie = counts.where("_state = ''").select("_part").withColumn("_e", F.explode(F.array(*(F.struct(*map(F.lit, e)) for e in edges)).cast(kind))).select("_part", "_e.*")
    removed = counts.select(F.col("_part").alias("_p"), F.col("_state").alias("before"), F.explode("_edges").alias("_x")).select("_p", "before", "_x.*")
    after = counts.select(F.col("_part").alias("_p"), F.col("_state").alias("after"), F.col("_left").alias("kept"))
    trie = trie.join(removed.withColumnRenamed("_p", "_part"), ["_part", "before", "filter"], "left").join(after.withColumnRenamed("_p", "_part"), ["_part", "after"], "left")
    trie = materialise(trie.fillna(0, ["kept", "removed", "good_lost", "toxic_lost"]), f"{at}/trie")
    # All that fail a filter are removed where it is the first, those that fail it alone where it is the last.
    alone = F.sum(F.when(F.col("orders") == math.factorial(n - 1), F.when(F.size(F.split("after", ",")) == n, F.col("removed"))))
    of = trie.groupBy("_part", "filter").agg(F.sum(F.when(F.col("before") == "", F.col("removed"))).alias("_fails"), alone.alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    path = spark.createDataFrame(steps, "filter_order string, step int, before string, filter string")
    out = trie.join(of, ["_part", "filter"]).join(path, ["before", "filter"])
    return out.select(F.col("_part").alias("part"), "filter_order", "step", "kept", "removed", (F.col("_fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
