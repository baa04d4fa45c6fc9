"""SimHash near-dedup: fingerprints of word shingles, linked by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch
from .components import connected_components
from .seeds import scrambled

#: Fingerprints that one bucket may hold before it is dealt again by finer masks.
BUCKET = 4096
#: Links that a task reduces to a forest at a time.
LINKS = 1 << 20
_SEED = 7
_APART = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, words: int) -> list[bytes]:
    """XXH64 (seed 42) of the shingles of a text, in order; a text shorter than a shingle is one."""
    tokens = text.lower().split()
    if not tokens:
        return []
    line = b" ".join(tokens)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(tokens) - words)
    digest = xxhash.xxh64_digest
    return [digest(line[a:b], 42) for a, b in zip(starts[: last + 1].tolist(), ends[min(words, len(tokens)) - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, words: int, prints: int = 1) -> list[int]:
    """Of the shingles' XXH64: a bit is 1 if more than half of them have it. Further prints take the same of hashes that are a scrambled form of the first ones."""
    return print_of_hashes(shingle_hashes(text, words), prints)


def print_of_hashes(pieces: list[bytes], prints: int = 1) -> list[int]:
    if not pieces:
        return [0] * prints
    total = np.zeros((prints, 64), np.int64)
    for k in range(0, len(pieces), 65536):
        hashes = np.frombuffer(b"".join(pieces[k : k + 65536]), ">u8").astype(np.uint64)
        for p in range(prints):
            bits = np.unpackbits((scrambled(hashes ^ np.uint64(p)) if p else hashes).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            total[p] += bits.sum(axis=0, dtype=np.uint32)
    return [int.from_bytes(np.packbits(2 * t > len(pieces)).tobytes(), "big", signed=True) for t in total]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, prints: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fps, the columns keep) of every row of docs, fps an array of `prints` fingerprints. A null text is an empty one, and a text without words has fingerprints 0; a shorter text is one shingle."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t or b"", words, prints) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64())), *batch.columns[2:]], ["doc_id", "fps", *batch.schema.names[2:]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("__text"), *keep)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"doc_id long, fps array<bigint>{kinds}")


def covering_masks(radius: int, bits: tuple[int, ...], seed: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks over the given bits. Bit i has a random vector m(i) of radius + 1 bits, and mask v keeps the bits whose m(i) has an odd overlap with v.

    The vectors of any radius bits leave some v without overlap, so two values that differ in at
    most radius of the bits agree under at least one mask.
    """
    vectors = np.random.default_rng([seed, *bits]).integers(0, 1 << (radius + 1), len(bits))
    return [sum(1 << b for b, m in zip(bits, vectors.tolist(), strict=True) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, position of a) between values of equal group that differ in at most radius bits; a forest, so no more links than values. The groups are runs, of BUCKET values at most."""
    n, root = len(fps), np.arange(len(fps))
    at = np.arange(n)
    for lag in range(1, BUCKET):
        at = at[at + lag < n]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= radius]
        near = near[root[near] != root[near + lag]]
        for i, j in zip(near.tolist(), (near + lag).tolist(), strict=True):
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            if i != j:
                root[max(i, j)] = min(i, j)
    for i in np.flatnonzero(root != np.arange(n)).tolist():
        root[i] = root[root[i]]
    own = np.flatnonzero(root != np.arange(n))
    return fps[own].view(np.int64), fps[root[own]].view(np.int64), own


def _bucket_links(radius: int):
    """Over rows (p, mask, fp) sorted by p, mask, the bits of fp that it keeps, the bucket, and fp: links as (p, a, b, mask), and the values of buckets beyond BUCKET as (p, fp, null, mask) for the next round."""

    def out(p: np.ndarray, a: np.ndarray, b: np.ndarray | None, mask: np.ndarray):
        empty = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(a, pa.int64()), empty if b is None else pa.array(b, pa.int64()), pa.array(mask, pa.int64())], ["p", "a", "b", "mask"])

    def run(batches):
        held = None  # the last bucket, which the next batch may continue, up to BUCKET values
        large = None  # the bucket that is being handed on
        for batch in batches:
            p, mask, fp = (np.asarray(x) for x in batch.columns)
            if held:
                p, mask, fp = (np.append(x, y) for x, y in zip(held, (p, mask, fp), strict=True))
                held = None
            n = len(fp)
            if not n:
                continue
            key = fp & mask
            cuts = np.flatnonzero((p[1:] != p[:-1]) | (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, size = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [n])))
            over = size > BUCKET
            if large is not None and (p[0], mask[0], key[0]) == large:
                over[0] = True
            group = np.repeat(np.arange(len(starts)), size)
            beyond = over[group]
            if beyond.any():
                yield out(p[beyond], fp[beyond], None, mask[beyond])
            large = (p[-1], mask[-1], key[-1]) if over[-1] else None
            now = ~beyond
            if not over[-1]:
                now &= group != group[-1]
                held = tuple(x[starts[-1] :].copy() for x in (p, mask, fp))
            # Buckets of one value, most of them, have no links.
            now &= size[group] > 1
            if now.any():
                a, b, at = _near(fp[now].view(np.uint64), group[now], radius)
                yield out(p[now][at], a, b, mask[now][at])
        if held:
            a, b, at = _near(held[2].view(np.uint64), np.zeros(len(held[2]), int), radius)
            yield out(held[0][at], a, b, held[1][at])

    return run


def _finer(radius: int, step: int):
    """Over rows (p, fp, fixed): (p, mask, fp) by the covering masks of the bits that fixed leaves free. Masks are made where they are needed, so no table of them travels."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            p, fp, fixed = (np.asarray(x) for x in batch.columns)
            for f in np.unique(fixed).tolist():
                if f not in known:
                    bits = f & (1 << 64) - 1
                    known[f] = np.array([_signed(bits | m) for m in covering_masks(radius, tuple(b for b in range(64) if not bits >> b & 1), _SEED + step)], np.int64)
                some = np.flatnonzero(fixed == f)
                for at in range(0, len(some), 1024):
                    part = some[at : at + 1024]
                    times = len(known[f])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p[part], times)), pa.array(np.tile(known[f], len(part))), pa.array(np.repeat(fp[part], times))], ["p", "mask", "fp"])

    return run


def hamming_links(values: DataFrame, radius: int = 4) -> DataFrame:
    """Links (p, a, b) that connect the distinct values fp of each p which differ in at most radius of their 64 bits, directly or over others.

    Round 1 deals every value to 2 ** (radius + 1) - 1 covering masks, and compares what meets in a
    bucket. A bucket of more than BUCKET values is not compared: its values, which agree on the bits
    of its mask, are dealt again by covering masks of the bits that are left, about half of them. So
    the fourth round at the latest has so few bits left that no bucket can be larger, unless it holds
    more values than there are. Each bucket gives a spanning forest of its links, not all its pairs.
    """
    at = scratch(values.sparkSession)
    found, todo = [], values.select("p", "fp")
    key = F.col("fp").bitwiseAND(F.col("mask"))
    for step in range(6):
        if step:
            dealt = todo.select("p", "fp", "fixed").mapInArrow(_finer(radius, step), "p int, mask long, fp long")
        else:
            dealt = todo.select("p", F.explode(F.array(*(F.lit(_signed(m)) for m in covering_masks(radius, tuple(range(64)), _SEED)))).alias("mask"), "fp")
        # In order of the values, so that buckets which hold the same group link it to the same few values.
        dealt = dealt.repartition("p", "mask", key).sortWithinPartitions("p", "mask", key, "fp")
        made = materialise(dealt.mapInArrow(_bucket_links(radius), "p int, a long, b long, mask long"), f"{at}/{step}")
        found.append(made.where("b is not null").select("p", "a", "b"))
        todo = made.where("b is null").select("p", F.col("a").alias("fp"), F.col("mask").alias("fixed")).distinct()
        if todo.isEmpty():
            break
    else:
        raise RuntimeError("buckets did not shrink")
    links = found[0]
    for x in found[1:]:
        links = links.union(x)
    return links


def _forest(batches):
    """Over links (a, b), LINKS at a time: links of each node to the smallest that it reaches by them, so no more links than nodes."""

    def flush(held):
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(ids)))
        for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            while parent[j] != j:
                parent[j] = j = parent[parent[j]]
            if i != j:
                parent[max(i, j)] = min(i, j)
        for i in range(len(parent)):
            parent[i] = parent[parent[i]]
        root = np.array(parent)
        own = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        n += len(batch)
        if n >= LINKS:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4, prints: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, fps (its fingerprints), the columns keep and component_id, the smallest doc_id that links reach. Documents are linked if any of their `prints` independent fingerprints differ in at most radius bits.

    Null and empty texts have fingerprints 0 and are linked like any other. Equal fingerprints are one
    class throughout, so copies are never compared with each other. Null ids take part, but give a
    component its id only if it has no other. Rows that repeat a doc_id are rows of their own, and
    texts are read whole, however long. An empty table gives an empty result. Other columns of docs
    are not read but for keep, whose names must not be those of the result.
    """
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    rows = materialise(fingerprints(docs, id_col, text_col, words, prints, keep), f"{at}/fps")
    classes = materialise(rows.groupBy("fps").agg(F.min("doc_id").alias("first")), f"{at}/classes")
    # A node of the graph is a value of a print; values of different prints are kept apart by a constant.
    node = lambda p, value: value.bitwiseXOR(F.element_at(F.array(*(F.lit(_signed(_APART * k & (1 << 64) - 1)) for k in range(prints))), p + 1))
    values = classes.select(F.posexplode("fps").alias("p", "fp")).groupBy("p", "fp").agg(F.count("*").alias("n"))
    values = materialise(values, f"{at}/values")
    links = hamming_links(values, radius).select(node(F.col("p"), F.col("a")).alias("a"), node(F.col("p"), F.col("b")).alias("b"))
    # The tables find a dense group many times over. Two passes over what tasks read together leave few links of it.
    for k in range(2):
        links = materialise(links.mapInArrow(_forest, "a long, b long"), f"{at}/forest-{k}")
    if prints > 1:
        # A class ties its values together: those of later prints that have links, or that other classes have too.
        shared = values.where("p > 0 and n > 1").select(node(F.col("p"), F.col("fp")).alias("b"))
        useful = links.select(F.explode(F.array("a", "b")).alias("b")).union(shared).distinct()
        ties = classes.select(F.col("fps")[0].alias("a"), F.posexplode("fps").alias("p", "fp")).where("p > 0").select("a", node(F.col("p"), F.col("fp")).alias("b"))
        links = links.union(ties.join(useful, "b", "left_semi").select("a", "b"))
    roots = connected_components(links)
    of = classes.join(roots, F.col("fps")[0] == F.col("node"), "left").select("fps", "first", F.coalesce("root", F.col("fps")[0]).alias("root"))
    of = materialise(of, f"{at}/roots")
    ids = of.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = materialise(of.join(materialise(ids, f"{at}/ids"), "root").select("fps", "component_id"), f"{at}/components")
    return rows.join(ids, "fps").select("doc_id", "fps", *keep, "component_id")
