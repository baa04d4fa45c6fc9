"""Winnowed seeds of sequences and the windows around them, shared by the operators that look for repeated passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

#: Units that are hashed together; longer sequences are cut into pieces that overlap by a window, which changes costs, not results.
SEGMENT = 1 << 18
#: Slots of the filter that tells which documents a join needs: 2 ** 22 bits, 65,536 rows of 64, at any input size.
SLOTS = 1 << 22
_ROW_BITS, _SPAN_BITS = 25, 7
_U = np.uint64


def scrambled(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Rolling:
    """Polynomial hashes modulo 2 ** 64 of any part of a sequence of 64-bit units."""

    def __init__(self, base: int, size: int):
        self.powers = np.concatenate(([_U(1)], np.cumprod(np.full(size, base, _U))))
        self.inverse = np.concatenate(([_U(1)], np.cumprod(np.full(size, pow(base, -1, 1 << 64), _U))))

    def prefix(self, units: np.ndarray) -> np.ndarray:
        out = np.zeros(len(units) + 1, _U)
        np.cumsum(units * self.powers[: len(units)], out=out[1:])
        return out

    def part(self, prefix: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        return (prefix[stop] - prefix[start]) * self.inverse[start]

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(prefix) - k)
        return self.part(prefix, slice(0, n), slice(k, k + n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x[:0] if rest else x


def winnow(grams: np.ndarray, bounds: np.ndarray, window: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, first, last): each seed and the starts of the windows it is chosen for, over sequences that lie between consecutive bounds.

    The seed of a window is the q-gram with the least scrambled hash, the leftmost of equals, so
    windows of equal content choose equal seeds at equal offsets. The windows of a seed are
    neighbours.
    """
    position = (1 << 31) - 1
    order = (scrambled(grams) & _U(~position & (1 << 64) - 1)) | np.arange(len(grams), dtype=_U)
    chosen = (sliding_min(order, window - q + 1) & _U(position)).astype(np.int64)
    inside = np.zeros(max(len(chosen), int(bounds[-1])) + 1, np.int32)
    length = np.diff(bounds)
    begins = bounds[:-1][length >= window]
    ends = bounds[1:][length >= window] - window + 1
    np.add.at(inside, begins, 1)
    np.add.at(inside, ends, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(starts):
        return starts, starts, starts
    seeds = chosen[starts]
    cut = np.flatnonzero(seeds[1:] != seeds[:-1]) + 1
    return seeds[np.concatenate(([0], cut))], starts[np.concatenate(([0], cut))], starts[np.append(cut - 1, len(starts) - 1)]


def pieces(texts: Iterator, units_of: Callable[[bytes], np.ndarray], window: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (index, offset, units) of about SEGMENT units: short texts together, long ones cut so that every window lies in one piece."""
    held, n = [], 0
    for k, text in enumerate(texts):
        units = units_of(text)
        for at in range(0, max(1, len(units) - window + 1), SEGMENT):
            piece = units[at : at + SEGMENT + window - 1]
            held.append((k, at, piece))
            n += len(piece)
            if n >= SEGMENT:
                yield held
                held, n = [], 0
    if held:
        yield held


def pack(start: np.ndarray, span: np.ndarray | int, row: np.ndarray) -> np.ndarray:
    """Start, number of further starts and row mark of a document in one value; in order of the start."""
    return (start.astype(np.int64) << (_ROW_BITS + _SPAN_BITS)) | (np.asarray(span, np.int64) << _ROW_BITS) | row


#: The mark that tells rows of one doc_id but different texts apart.
ROW = f"pmod(xxhash64(_text), {1 << _ROW_BITS}L)"
#: Null ids come before all others.
LEAST = -(1 << 63)


def side_marks(ids_of: Callable[[np.ndarray, np.ndarray], np.ndarray], seed: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int, q: int, n: int) -> np.ndarray:
    """For each seed the ids, 20 bits each, of the seed with half of what a window has besides on its left and on its right, and the offset of the seed in its first window.

    A window has so much on one side at least. ids_of gives the ids of the content between starts
    and stops; where no window of the seed needs a side, its id means nothing.
    """
    half = (window - q) // 2
    left = ids_of(np.maximum(seed - half, 0), seed + q) >> _U(44)
    right = ids_of(seed, np.minimum(seed + q + half, n)) >> _U(44)
    return ((left << _U(27)) | (right << _U(7)) | (seed - lo).astype(_U)).view(np.int64)


def _later(doc, place, first_doc, first_place, by_place: bool) -> np.ndarray:
    later = doc != first_doc
    return later | ((place >> _ROW_BITS) != (first_place >> _ROW_BITS)) if by_place else later


def combined(h: np.ndarray, c: np.ndarray, doc: np.ndarray, place: np.ndarray, by_place: bool, **more: np.ndarray) -> pa.RecordBatch:
    """The rows in their order, in which each that has an earlier row of equal h and c is marked as late: its place is negative, and its h spreads it over all tasks, as nothing is left to be compared."""
    order = np.lexsort((place, doc, c, h))
    keys, by_doc, by = (h[order], c[order]), doc[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    late = np.empty(len(order), bool)
    late[order] = _later(by_doc, by, by_doc[first], by[first], by_place)
    apart = scrambled((doc ^ place).view(_U)).view(np.int64)
    return _batch(h=np.where(late, apart, h), c=np.where(late, 0, c), doc=doc, place=np.where(late, -1 - place, place), **more)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def judge_contexts(by_place: bool):
    """Over rows (h, c, doc, place, sides) sorted in this order: the rows that have an earlier row of equal h and c, with expand false, and the first rows of those h that have several c, with expand true. Rows whose place is negative are passed on as late ones.

    Only the state of the last group is kept from batch to batch, whatever the size of a group.
    """

    def run(batches):
        last_h = last_c = first_doc = first_place = None
        several, waiting = False, []  # of last_h: whether it has several c, and the first rows of its only c
        for batch in batches:
            h, c, doc, place, sides = (np.asarray(x) for x in batch.columns)
            rows = lambda some, place, expand: _batch(h=h[some], c=c[some], doc=doc[some], place=place[some], sides=sides[some], expand=expand[some])  # noqa: E731, B023
            passed = place < 0
            if passed.any():
                yield rows(passed, -1 - place, np.zeros(len(h), bool))
                h, c, doc, place, sides = (x[~passed] for x in (h, c, doc, place, sides))
            n = len(h)
            if not n:
                continue
            new_h, new_c = np.ones(n, bool), np.ones(n, bool)
            new_h[1:] = h[1:] != h[:-1]
            new_h[0] = last_h is None or h[0] != last_h
            new_c[1:] = c[1:] != c[:-1]
            new_c[0] = new_h[0] or c[0] != last_c
            new_c |= new_h
            first = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
            d0, p0 = np.where(first >= 0, doc[first], first_doc if first_doc is not None else 0), np.where(first >= 0, place[first], first_place if first_place is not None else 0)
            late = _later(doc, place, d0, p0, by_place)
            group = np.cumsum(new_h)  # 0: goes on from the batch before
            count = np.bincount(group, weights=new_c, minlength=group[-1] + 1)
            many = count > 1
            many[0] = several or count[0] > 0
            if group[0] == 0 and many[0] and waiting:
                yield from waiting
                waiting = []
            if group[-1] > 0:
                waiting = []
            expand = ~late & many[group]
            out = late | expand
            if out.any():
                yield rows(out, place, expand)
            several = bool(many[group[-1]])
            if not several:
                keep = ~late & (group == group[-1])
                waiting.append(rows(keep, place, np.ones(n, bool)))
            last_h, last_c, first_doc, first_place = h[-1], c[-1], d0[-1], p0[-1]

    return run


def judge_windows(by_place: bool):
    """Over rows (h, c, doc, place) sorted in this order: (doc, place) of those that have an earlier row of equal h and c. Rows whose place is negative are passed on as late ones."""

    def run(batches):
        key, first_doc, first_place = None, 0, 0
        for batch in batches:
            h, c, doc, place = (np.asarray(x) for x in batch.columns)
            passed = place < 0
            if passed.any():
                yield _batch(doc=doc[passed], place=-1 - place[passed])
                h, c, doc, place = (x[~passed] for x in (h, c, doc, place))
            n = len(h)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            new[0] = key is None or (h[0], c[0]) != key
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            d0, p0 = np.where(first >= 0, doc[first], first_doc), np.where(first >= 0, place[first], first_place)
            late = _later(doc, place, d0, p0, by_place)
            if late.any():
                yield _batch(doc=doc[late], place=place[late])
            key, first_doc, first_place = (h[-1], c[-1]), d0[-1], p0[-1]

    return run


def needed(rows: DataFrame) -> DataFrame:
    """A filter of fixed size (SLOTS / 64 rows at most) over the column doc of rows."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS))
    return rows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("_bits"))


def marked(docs: DataFrame, filters: DataFrame) -> DataFrame:
    """docs with a boolean column _needed: false only for a doc that the filter's rows do not have."""
    small = F.broadcast(filters)
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS))
    return (
        docs.withColumn("_slot", slot)
        .join(small, F.shiftright("_slot", 6) == F.col("_word"), "left")
        .withColumn("_needed", F.coalesce(F.expr("(shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1) = 1"), F.lit(False)))
        .drop("_slot", "_word", "_bits")
    )


def by_document(hits: DataFrame) -> DataFrame:
    """(doc, row, places): a document's places together; a document has no more than its length allows."""
    return hits.groupBy("doc", F.col("place").bitwiseAND((1 << _ROW_BITS) - 1).alias("row")).agg(F.collect_list("place").alias("places"))


def ranges(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of each place."""
    first = places >> (_ROW_BITS + _SPAN_BITS)
    return first, first + ((places >> _ROW_BITS) & ((1 << _SPAN_BITS) - 1))


def covered(places: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n units lie in a window that starts in one of the places."""
    first, last = ranges(places)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last + window, -1)
    return np.cumsum(change[:-1]) > 0


def _open_places(judged: DataFrame, window: int, q: int, at: str) -> DataFrame:
    """(doc, place) of the windows to be looked at: of the rows with expand those halves whose id, with the seed, another row of other content has."""
    half = (window - q) // 2
    start, span, row = "shiftright(place, 32)", f"(shiftright(place, {_ROW_BITS}) & {(1 << _SPAN_BITS) - 1})", f"(place & {(1 << _ROW_BITS) - 1})"
    cut = f"({start} + (sides & 127) - {half})"  # the first window that has half on the right
    put = lambda first, last: f"(shiftleft({first}, 32) | shiftleft({last} - {first}, {_ROW_BITS}) | {row})"
    first, last = start, f"({start} + {span})"
    rows = judged.where("expand").select(
        "h", "c", "doc",
        F.explode(F.expr(f"""array(
            if({first} < {cut}, struct(0 as side, shiftright(sides, 27) as id, {put(first, f"least({last}, {cut} - 1)")} as part), null),
            if({last} >= {cut}, struct(1 as side, shiftright(sides, 7) & {(1 << 20) - 1} as id, {put(f"greatest({first}, {cut})", last)} as part), null))""")).alias("x"),
    ).where("x is not null").select("h", "c", "doc", "x.side", "x.id", F.col("x.part").alias("place"))
    rows = materialise(rows, f"{at}/halves")
    several = rows.groupBy("h", "side", "id").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).where("_a < _b").select("h", "side", "id")
    return rows.join(materialise(several, f"{at}/several"), ["h", "side", "id"]).select("doc", "place")


def repeated_places(docs: DataFrame, seeds_of, windows_of, window: int, q: int, by_place: bool) -> tuple[DataFrame, DataFrame]:
    """(hits, filter): hits (doc, place) are the starts of all windows with an earlier window of equal content; the filter marks the documents that have any.

    docs has _id, doc and _text (binary). seeds_of maps batches (doc, row, text) to seeds (h, c, doc,
    place, sides): h is the seed's content, c that of all windows it is chosen for. windows_of maps batches
    (doc, row, text, places) to windows (h, c, doc, place).

    1. Seeds are dealt by content. Rows of equal h and c agree on all their windows, so all but the
       first are repeats throughout. Where an h has one c only, its first row has no repeat.
    2. The first rows of an h with several c may still share windows. Any window has half of its
       other units on one side of the seed. So for each side, rows that agree on the seed and that
       half are looked at further, and rows that agree with no other are done.
    3. What is left is looked at window by window: each is hashed in full and dealt by its hash.

    Steps 1 and 3 drop later rows of a batch before they are shuffled, as a combiner does, so a passage
    that a third of all documents share arrives as few rows. A sorted group is read row by row and
    never held.
    """
    at = scratch(docs.sparkSession)
    rows = docs.select("doc", F.expr(f"{ROW} as row"), "_text")
    schema = "h long, c long, doc long, place long"
    sort = ("h", "c", "doc", "place")
    seeds = rows.mapInArrow(seeds_of, f"{schema}, sides long").repartition("h").sortWithinPartitions(*sort)
    judged = materialise(seeds.mapInArrow(judge_contexts(by_place), f"{schema}, sides long, expand boolean"), f"{at}/contexts")
    open_ = by_document(_open_places(judged, window, q, at))
    open_ = materialise(open_, f"{at}/open")
    wanted = marked(docs.select("doc", F.expr(f"{ROW} as row"), "_text"), materialise(needed(open_), f"{at}/open-filter")).where("_needed")
    joined = wanted.join(open_, ["doc", "row"]).select("doc", "row", "_text", "places")
    windows = joined.mapInArrow(windows_of, schema).repartition("h").sortWithinPartitions(*sort)
    late = materialise(windows.mapInArrow(judge_windows(by_place), "doc long, place long"), f"{at}/windows")
    hits = judged.where("not expand").select("doc", "place").union(late)
    return materialise(by_document(hits), f"{at}/hits"), materialise(needed(hits), f"{at}/hits-filter")
