"""Substring dedup over words: seed and extend."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, per_worker
from .seeds import LEAST, ROW, SEGMENT, Rolling, combined, covered, marked, pack, pieces, ranges, repeated_places, scrambled, side_marks, winnow

#: Words of a seed.
SEED = 12
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _units():
    """Text to the hashes of its words."""
    table = per_worker(("word hashes",), lambda: Recent(xxhash.xxh64_digest))
    return lambda text: np.frombuffer(b"".join(map(table.__getitem__, text.split())), np.uint64)


def _seeds(window: int, q: int):
    def run(batches):
        units_of = _units()
        first, second = (Rolling(b, 2 * SEGMENT + 2 * window) for b in _BASES)
        for batch in batches:
            docs, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for held in pieces((x.as_py() for x in batch.column(2)), units_of, window):
                units = np.concatenate([u for _, _, u in held])
                bounds = np.concatenate(([0], np.cumsum([len(u) for _, _, u in held])))
                sums = first.prefix(units)
                grams = first.grams(sums, q)
                seed, lo, hi = winnow(grams, bounds, window, q)
                if not len(seed):
                    continue
                # Content of the seed, and of all it may be extended to, left and right.
                h = scrambled(grams[seed])
                c = scrambled(second.part(second.prefix(units), lo, hi + window) ^ scrambled(((hi - lo) << 8 | (seed - lo)).astype(np.uint64)))
                sides = side_marks(lambda a, b: scrambled(first.part(sums, a, b)), seed, lo, hi, window, q, len(units))
                of = np.searchsorted(bounds, lo, "right") - 1
                index, offset = (np.array(x) for x in zip(*((k, at) for k, at, _ in held), strict=True))
                doc = docs[index[of]]
                place = pack(lo - bounds[of] + offset[of], hi - lo, marks[index[of]])
                h, c = h.view(np.int64), c.view(np.int64)
                yield combined(h, c, doc, place, False, sides=sides)

    return run


def _windows(window: int):
    def run(batches):
        units_of = _units()
        rolling = [Rolling(b, 2 * SEGMENT + 2 * window) for b in _BASES]
        for batch in batches:
            found = []
            for doc, mark, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                units = units_of(text.as_py())
                first, last = ranges(np.asarray(places.values))
                spans = last - first + 1
                starts = np.repeat(first - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
                starts.sort()
                for at in range(0, len(units), SEGMENT):
                    some = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + SEGMENT)]
                    if len(some):
                        part = units[at : at + SEGMENT + window]
                        keys = [scrambled(r.part(r.prefix(part), some - at, some - at + window)).view(np.int64) for r in rolling]
                        found.append((*keys, np.full(len(some), doc), pack(some, 0, np.full(len(some), mark))))
            if found:
                h, c, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
                yield combined(h, c, doc, place, False)

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words that stay, one space between them) and spans, an array of (start, stop) over its words.

    A word is removed if it lies in a window of `window` consecutive words that also starts in a
    document with a smaller doc_id. Documents meet on winnowed seeds of `seed` words: any shared
    window has one at the same place. A match is extended over all windows that the seed is chosen
    for, left and right at once where these agree as a whole, else on the sides that agree, window by
    window, and the windows found repeated are merged into maximal passages. A match as a whole is told by 64 bits
    of a hash of all it covers, beside the 64 of its seed; a single window by 128 bits of hashes of its words.

    Copies of a passage are only compared with its first occurrence, so a group of copies costs as
    many rows as it has members. Null texts have no words. Rows of equal doc_id never remove words
    from each other; a null id comes before all others. Long texts are hashed in pieces and read
    whole. An empty table gives an empty result. Other columns of docs are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    hits, filters = repeated_places(base, _seeds(window, seed), _windows(window), window, seed, by_place=False)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def keep(batches):
        for batch in batches:
            rows = []
            for doc_id, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = text.as_py().split()
                if not places.is_valid:
                    rows.append((doc_id, len(words), 0, b" ".join(words).decode("utf-8", "replace"), []))
                    continue
                gone = covered(np.asarray(places.values), len(words), window)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                rows.append((doc_id, len(words), int(gone.sum()), kept.decode("utf-8", "replace"), [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:bigint,stop:bigint>>"
    all_rows = marked(base, filters)
    # Only documents that may have repeats are shuffled to their places.
    untouched = all_rows.where("not _needed").select("_id", "_text", F.lit(None).cast("array<bigint>").alias("places"))
    touched = all_rows.where("_needed").withColumn("row", F.expr(ROW)).join(hits, ["doc", "row"], "left").select("_id", "_text", "places")
    return untouched.mapInArrow(keep, schema).unionByName(touched.mapInArrow(keep, schema))
