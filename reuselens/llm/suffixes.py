"""Suffix-array dedup over bytes: bucket-pointer refinement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seeds import LEAST, ROW, SEGMENT, Rolling, combined, covered, marked, pack, pieces, ranges, repeated_places, scrambled, side_marks, winnow

#: Bytes of the initial buckets' grams.
GRAM = 32
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_MIX = np.uint64(0x2545F4914F6CDD1D)


class Buckets:
    """Bucket identifiers of the suffixes of a byte sequence, by their first q, 2q, ... bytes.

    The identifier of a bucket is a 64-bit value that its content alone decides, so suffixes of
    different tasks that belong together have the same one, and no task needs a table of buckets.
    """

    def __init__(self, which: int, q: int, window: int):
        rng = np.random.default_rng(which + 1)
        self.codes = rng.integers(0, 1 << 64, 256, np.uint64)
        self.rolling, self.q, self.window = Rolling(_BASES[which], 2 * SEGMENT + 2 * window), q, window

    def initial(self, data: np.ndarray) -> np.ndarray:
        return scrambled(self.rolling.grams(self.rolling.prefix(self.codes[data]), self.q))

    def pairs(self, initial: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Buckets by the bytes between start and stop, q to 2 q of them and a few more: those of the first q, refined by those of the grams after them, the last one ending at stop."""
        ids = initial[start]
        for step in (self.q, 2 * self.q):
            ids = self.refined(ids, initial[np.clip(np.minimum(start + step, stop - self.q), 0, len(initial) - 1)])
        return ids

    @staticmethod
    def refined(at: np.ndarray, later: np.ndarray) -> np.ndarray:
        """Buckets of the pairs of bucket identifiers at an offset and at a later one."""
        return scrambled(at * _MIX + later)

    def full(self, initial: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Buckets by the first window bytes, of the given starts. Each round refines the buckets of depth d with the identifiers that the last round gave d bytes later, or fewer in the last round, until the depth is that of the window."""
        depth, ids = self.q, initial
        while depth < self.window:
            step = min(depth, self.window - depth)
            ids = self.refined(ids[:-step], ids[step:])
            depth += step
        return ids[starts]


def _seeds(window: int, q: int):
    def run(batches):
        buckets = Buckets(0, q, window)
        for batch in batches:
            docs, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for held in pieces((x.as_py() for x in batch.column(2)), lambda text: np.frombuffer(text, np.uint8), window):
                data = np.concatenate([u for _, _, u in held])
                bounds = np.concatenate(([0], np.cumsum([len(u) for _, _, u in held])))
                initial = buckets.initial(data)
                seed, lo, hi = winnow(initial, bounds, window, q)
                if not len(seed):
                    continue
                # All suffixes that the seed stands for, refined together by the identifiers of every q-th later offset.
                c = scrambled(((hi - lo) << 8 | (seed - lo)).astype(np.uint64))
                for step in range(0, 2 * window - q, q):
                    c = buckets.refined(c, initial[np.minimum(lo + step, hi + window - q)])
                sides = side_marks(lambda a, b: buckets.pairs(initial, a, b), seed, lo, hi, window, q, len(data))
                of = np.searchsorted(bounds, lo, "right") - 1
                index, offset = (np.array(x) for x in zip(*((k, at) for k, at, _ in held), strict=True))
                doc = docs[index[of]]
                place = pack(lo - bounds[of] + offset[of], hi - lo, marks[index[of]])
                h, c = initial[seed].view(np.int64), c.view(np.int64)
                yield combined(h, c, doc, place, True, sides=sides)

    return run


def _windows(window: int, q: int):
    def run(batches):
        buckets = [Buckets(k, q, window) for k in (0, 1)]
        for batch in batches:
            found = []
            for doc, mark, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = np.frombuffer(text.as_py(), np.uint8)
                first, last = ranges(np.asarray(places.values))
                spans = last - first + 1
                starts = np.repeat(first - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
                starts.sort()
                for at in range(0, len(data), SEGMENT):
                    some = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + SEGMENT)]
                    if len(some):
                        part = data[at : at + SEGMENT + window]
                        keys = [b.full(b.initial(part), some - at).view(np.int64) for b in buckets]
                        found.append((*keys, np.full(len(some), doc), pack(some, 0, np.full(len(some), mark))))
            if found:
                h, c, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
                yield combined(h, c, doc, place, True)

    return run


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) and spans, an array of (start, stop) over its bytes.

    A byte is removed if it lies in a string of `window` bytes that also starts earlier: in a document
    with a smaller doc_id, or in the same document before. Matches never cross documents.

    Suffixes are put in buckets by their first `gram` bytes, and buckets are refined by the bucket
    identifiers of later offsets, reusing those of the round before, until suffixes are told apart
    or agree for `window` bytes. So that not every suffix has to be shuffled, the first buckets hold
    one suffix of about every (window - gram) / 2, chosen by content: each string of `window` bytes
    has one, at the same offset as its copies. A bucket is done when it has one suffix or all its
    suffixes agree on all the strings around. Others are refined by what comes before and after, and
    only where such a bucket still has several suffixes is every suffix around refined to the full
    depth and sorted. Buckets that agree as a whole are told by 64 bits beside the 64 of the first
    ones, full depth by 128 bits.

    Null texts have no bytes. Rows of equal doc_id and start never remove each other; a null id
    comes before all others. Long texts are taken in pieces and read whole. An empty table gives an
    empty result. Other columns of docs are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    hits, filters = repeated_places(base, _seeds(window, gram), _windows(window, gram), window, gram, by_place=True)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def keep(batches):
        for batch in batches:
            rows = []
            for doc_id, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                if not places.is_valid:
                    rows.append((doc_id, len(data), 0, 0, data, []))
                    continue
                gone = covered(np.asarray(places.values), len(data), window)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((doc_id, len(data), int(gone.sum()), len(edges) // 2, kept, [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.binary(), spans_type]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:bigint,stop:bigint>>"
    all_rows = marked(base, filters)
    # Only documents that may have repeats are shuffled to their places.
    untouched = all_rows.where("not _needed").select("_id", "_text", F.lit(None).cast("array<bigint>").alias("places"))
    touched = all_rows.where("_needed").withColumn("row", F.expr(ROW)).join(hits, ["doc", "row"], "left").select("_id", "_text", "places")
    return untouched.mapInArrow(keep, schema).unionByName(touched.mapInArrow(keep, schema))
