"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch, spaced

#: Characters that the prefix hash reads.
PREFIX = 512
#: Slots of the filters that carry the surviving groups to the next scan: 2 ** 20 bits, 16,384 rows of 64, at any input size.
SLOTS = 1 << 20


def _slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS))


def _survivors(keys: DataFrame) -> DataFrame:
    """(word, bits): the slots of the keys that more than one row has."""
    slot = _slot(*(F.col(c) for c in keys.columns))
    return (
        keys.groupBy(*keys.columns).count().where("count > 1").select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    )


def _marked(rows: DataFrame, filters: DataFrame, name: str, *key: str) -> DataFrame:
    """rows with a boolean column name: whether the key may have another row. The filter has SLOTS / 64 rows at most, so it may be broadcast."""
    slot = _slot(*(F.col(c) for c in key))
    small = F.broadcast(filters.withColumnsRenamed({"word": "_word", "bits": "_bits"}))
    return (
        rows.withColumn("_slot", slot)
        .join(small, F.shiftright("_slot", 6) == F.col("_word"), "left")
        .withColumn(name, F.coalesce(F.expr("(shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1) = 1"), F.lit(False)))
        .drop("_slot", "_word", "_bits")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, with digests text_sha256, and the columns keep.

    Texts are equal when identical after each run of white space became one space. Three scans
    refine the groups. The first counts lengths. The second hashes the prefix of texts whose length
    recurs. The third hashes in full those whose length and prefix recur; only their digests are
    shuffled, texts never are. A filter of fixed size carries the survivors from scan to scan. It
    may let a single text through, which then forms a group of its own, and never loses one.

    Null texts count as empty. Equal ids are one document: all rows of the smallest id stay. A null
    id stays only where its group has no other. An empty table gives an empty result. A text of any length
    is normalised and hashed whole; only digests are shuffled. Other columns are not read but for keep,
    whose names must not be those of the result.
    """
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), spaced(F.coalesce(F.col(text_col), F.lit(""))).alias("_norm"), *keep)
    sized = rows.withColumn("_len", F.octet_length("_norm"))
    lengths = materialise(_survivors(sized.select("_len")), f"{at}/lengths")

    prefixed = _marked(sized, lengths, "_again", "_len").withColumn("_prefix", F.when(F.col("_again"), F.xxhash64(F.substring("_norm", 1, PREFIX))))
    prefixes = materialise(_survivors(prefixed.where("_again").select("_len", "_prefix")), f"{at}/prefixes")

    hashed = _marked(prefixed, prefixes, "_twice", "_len", "_prefix").select(
        "doc_id",
        *keep,
        F.when(F.col("_again") & F.col("_twice"), F.sha2("_norm", 256)).alias("_full"),
        *([F.sha2("_norm", 256).alias("text_sha256")] if digests else []),
    )
    hashed = materialise(hashed, f"{at}/hashed")
    groups = hashed.where("_full is not null").groupBy("_full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialise(groups, f"{at}/groups")  # both sides of the join are then shuffled for it, so a hot group can be split

    extra = [*(["text_sha256"] if digests else []), *keep]
    single = hashed.where("_full is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *extra)
    grouped = hashed.where("_full is not null").join(groups, "_full").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *extra)
    return single.unionByName(grouped)
