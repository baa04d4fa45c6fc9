"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then a seeded choice of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import ranked
from .common import materialise, scratch, text_or_empty, words_of

#: Weights of the sources in the order of their names, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: Words of a block, and documents of a shard on average.
BLOCK, SHARD_ROWS = 256, 256
#: Blocks that a target has at least: sources with smaller targets have blocks of half the words, a quarter, ..., one.
LEAST_BLOCKS = 16
SEED = 11


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """(source, source_size, n, target) of every source of sizes (source, size).

    The targets share `share` times all sizes by weight; a target stops at `repeats` times its
    source's size and what is over is shared anew, until none is above. That is min(cap, level *
    weight) with one level for all, found by taking the sources in the order of cap / weight. The
    windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    ranked = by.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")).withColumn("_cap", repeats * F.col("source_size"))
    ordered = everything.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(ordered), F.lit(0.0)))
    ranked = ranked.withColumn("_level", F.col("_left") / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(ordered), F.lit(0.0))))
    # The first source whose cap is not reached fixes the level; those before it stop at their caps.
    ranked = ranked.withColumn("_fixed", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(everything).getField("_level"))
    target = F.when(F.col("_fixed").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_fixed") * F.col("_w")))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def block_size(target: Column, block: int = BLOCK) -> Column:
    """Words of the blocks of a source with such a target."""
    sizes = [block >> k for k in range(block.bit_length())]
    return F.coalesce(*(F.when(target >= LEAST_BLOCKS * b, b) for b in sizes), F.lit(1)).cast("long")


def sainte_lague(votes: DataFrame, group: str, house: str, unit: float | Column, order: tuple[str, ...]) -> DataFrame:
    """votes (with columns votes and group, and the group's number of seats in house) and its seats by the highest quotients votes / (2 seats + 1). unit is a group's votes for a seat.

    Rounding votes / unit gives the seats that quotients above 2 / unit win; as many as are missing
    then go to the highest quotients that are left, and as many as are too many leave from the
    lowest that were taken. If d seats are off among n members, the divisor that gives the right
    number changes all shares by no more than a factor of 1 + (d + n) / seats, so a member changes
    by its share of d + n and 2 at most: only so many of its quotients are ranked. Of equal quotients the first by order wins a seat that is missing, and
    loses one that is too many.
    """
    v = votes.withColumn("_s", F.floor(F.col("votes") / unit + 0.5).cast("long"))
    v = materialise(v, f"{scratch(v.sparkSession)}/votes")
    sums = v.groupBy(F.col(group).alias("_of")).agg(F.sum("_s").alias("_seats"), F.count("*").alias("_n"), F.sum("votes").alias("_all"))
    v = v.join(sums, F.col(group) == F.col("_of")).withColumn("_d", F.col(house) - F.col("_seats"))
    most = F.when(F.col("votes") > 0, F.ceil((F.abs("_d") + F.col("_n")) * F.col("votes") / F.col("_all")) + 2).otherwise(0)
    seat = F.when(F.col("_d") > 0, F.col("_s") + F.col("_k") - 1).otherwise(F.col("_s") - F.col("_k"))
    near = v.withColumn("_most", F.least(most, F.abs("_d")).cast("long")).where("_most > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_most")))).withColumn("_seat", seat).where("_seat >= 0")
    near = near.withColumn("_q", F.col("votes") / (2 * F.col("_seat") + 1))
    near = near.withColumn("_first", F.when(F.col("_d") > 0, -F.col("_q")).otherwise(F.col("_q")))
    near = ranked(near.select(group, *(c for c in order if c != group), "_first", "_k", "_d"), (group,), ("_first", *order, "_k"), "_at")
    near = near.where(F.col("_at") < F.abs("_d")).groupBy(*(F.col(c).alias(f"_by_{c}") for c in order)).agg(F.sum(F.signum("_d")).cast("long").alias("_change"))
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return v.join(near, same, "left").withColumn("seats", F.col("_s") + F.coalesce("_change", F.lit(0))).drop("_s", "_d", "_change", "_of", "_seats", "_n", "_all", *(f"_by_{c}" for c in order))


def within_room(members: DataFrame, group: str, house: str, room: str, order: tuple[str, ...]) -> DataFrame:
    """members with seats of room at most. What a member has no room for goes to the highest quotients of others of its group that have; it is lost only if none has."""
    at = scratch(members.sparkSession)
    m = materialise(members.withColumn("seats", F.least("seats", room)), f"{at}/held")
    short = m.groupBy(F.col(group).alias("_of")).agg((F.max(house) - F.sum("seats")).alias("_short")).where("_short > 0")
    free = m.where(F.col("seats") < F.col(room)).join(materialise(short, f"{at}/short"), F.col(group) == F.col("_of")).where("votes > 0")
    free = free.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col(room) - F.col("seats"), "_short")))).withColumn("_first", -F.col("votes") / (2 * (F.col("seats") + F.col("_k")) - 1))
    free = ranked(free.select(group, *(c for c in order if c != group), "_first", "_k", "_short"), (group,), ("_first", *order, "_k"), "_at")
    more = free.where("_at < _short").groupBy(*(F.col(c).alias(f"_by_{c}") for c in order)).agg(F.count("*").alias("_more"))
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return m.join(more, same, "left").withColumn("seats", F.col("seats") + F.coalesce("_more", F.lit(0))).drop("_more", *(f"_by_{c}" for c in order))


def _seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, spans, an array of (start, stop, times) over its words, and the columns keep.

    Each source's documents are dealt by a seeded hash to shards of about shard_rows documents. In
    a shard, in seeded order, their words form one line that is cut into blocks of equal size.
    Sources whose blocks have the same size get them by Sainte-Lague over their targets, then a source's
    shards over their words. Blocks have `block` words, but for sources of small targets, so that the
    taken words of a source of a few short documents, too, are near its target.
    Blocks are taken in rounds; the last, partial round takes those with the least seeded hash. A
    block is never taken more often than ceil(target / size), 2 at most, so neither is a document.

    No sum or order ever spans more than one shard, or one row for each source; shards are ranked by
    ranges (shared.ranked), so a source with a third of all rows is spread like any other. Sizes count words; a
    null text has none, and a text of any length is counted whole. A null source is a source. Rows that repeat a
    doc_id count as documents of their own, in an order that their sizes fix. An empty table gives an
    empty result. Columns named in keep are carried along; their names must not be those of the result.
    """
    result = ("doc_id", "source", "size", "source_size", "target", "taken", "spans")
    if set(keep) & set(result):
        raise ValueError(f"columns of the result: {', '.join(sorted(set(keep) & set(result)))}")
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(text_or_empty(text_col))).cast("long").alias("size"), F.struct(F.lit(0), *keep).alias("_kept"))
    sizes = materialise(sizes, f"{at}/sizes")
    targets = source_targets(sizes, weights, share)
    # Blocks a source may take are also bounded by what its shards hold.
    targets = targets.withColumn("votes", F.col("target")).withColumn("words", block_size(F.col("target"), block))
    targets = targets.withColumn("house", F.round(F.sum("target").over(Window.partitionBy("words")) / F.col("words")).cast("long"))
    targets = sainte_lague(targets, "words", "house", F.col("words"), ("source",)).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n") / shard_rows)).cast("int"))
    targets = materialise(targets.select("source", "source_size", "target", "words", F.col("seats").alias("source_seats"), "shards"), f"{at}/targets")

    placed = sizes.join(targets.select(F.col("source").alias("_s"), "shards"), F.col("source").eqNullSafe(F.col("_s")))
    placed = placed.withColumn("_order", _seeded(seed, F.col("doc_id"))).withColumn("shard", F.pmod(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.col("shards")).cast("int"))
    line = Window.partitionBy("source", "shard").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("stop", F.sum("size").over(line)).select("doc_id", "source", "shard", "size", (F.col("stop") - F.col("size")).alias("start"), "stop", "_kept")
    placed = materialise(placed, f"{at}/placed")

    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(targets.select(F.col("source").alias("_s"), "source_size", "target", "words", "source_seats"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shards = shards.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("shard_size") / F.col("source_size")).otherwise(0.0)).withColumn("_group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    shards = sainte_lague(shards, "_group", "source_seats", F.col("words"), ("source", "shard"))
    blocks = F.greatest(F.floor(F.col("shard_size") / F.col("words") + 0.5), F.lit(1)).cast("long")
    shards = shards.withColumn("blocks", blocks).withColumn("room", (F.ceil(F.col("votes") / F.greatest(F.col("shard_size"), F.lit(1))) * F.col("blocks")).cast("long"))
    shards = within_room(shards, "_group", "source_seats", "room", ("source", "shard"))
    shards = materialise(shards.select("source", "shard", "shard_size", "blocks", "seats"), f"{at}/shards")

    # One row per block of a shard: how often it is taken.
    each = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("_key", _seeded(seed, F.col("source"), F.col("shard"), F.col("block")))
    rank = F.row_number().over(Window.partitionBy("source", "shard").orderBy("_key", "block"))
    times = F.floor(F.col("seats") / F.col("blocks")) + F.when(rank <= F.col("seats") % F.col("blocks"), 1).otherwise(0)
    each = each.select("source", "shard", "shard_size", "blocks", "block", times.cast("int").alias("times")).groupBy("source", "shard", "shard_size", "blocks")
    each = each.agg(F.array_sort(F.collect_list(F.struct("block", "times"))).alias("_times")).withColumn("_times", F.col("_times.times"))
    each = materialise(each, f"{at}/blocks")

    taken = placed.join(each.withColumnsRenamed({"source": "_s", "shard": "_h"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    # Block b is the words from b * shard_size div blocks on.
    inside = F.expr(
        """if(size > 0, filter(transform(sequence(((start + 1) * blocks - 1) div shard_size, (stop * blocks - 1) div shard_size),
            b -> struct(greatest(b * shard_size div blocks - start, 0L) as start, least((b + 1) * shard_size div blocks - start, size) as stop, _times[int(b)] as times)), x -> x.times > 0 and x.stop > x.start), array())"""
    )
    taken = taken.withColumn("spans", inside.cast("array<struct<start:bigint,stop:bigint,times:int>>"))
    taken = taken.withColumn("taken", F.expr("aggregate(spans, 0L, (a, x) -> a + (x.stop - x.start) * x.times)"))
    return taken.join(targets.select(F.col("source").alias("_t"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_t"))).select("doc_id", "source", "size", "source_size", "target", "taken", "spans", *(F.col("_kept").getField(c).alias(c) for c in keep))
