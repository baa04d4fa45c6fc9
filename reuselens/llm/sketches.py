"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, whose differences give back the paragraphs that two versions do not share."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Cells of a fingerprint; larger sketches have twice as many, four times, ...
CELLS = 24
#: Sizes that are tried before two sketches count as not to be told apart, and passes over the cells of one.
TRIES, PASSES = 24, 64
#: Code points from which a line is cut, and where: after sentences that end with one of some letters, about one in four. So an edit changes the pieces that it touches and no others.
LINE, CUT = 400, r"(?<=[a-e][.!?])[ \t]+"
#: Rows of a group whose documents are put in order, and groups at most.
ROWS, GROUPS = 2048, 1 << 15


def paragraphs(text: Column) -> Column:
    """Array of the lines of a text that are not blank; a line of more than LINE code points is cut at CUT."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.length(x) > LINE, F.split(x, CUT)).otherwise(F.array(x)))
    return F.filter(F.flatten(lines), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")


def digests(text: Column) -> Column:
    """Array of the distinct 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(paragraphs(text), lambda x: F.xxhash64(x)))


# SQL of arrays of cells, struct(cell, n, key, mark): how many digests a cell holds, those taken away as less than none, and the digests and their marks combined by xor. Cells that hold nothing are left out.


def _let(name: str, value: str, body: str) -> str:
    """body with a name for value, which is computed once: the result of an aggregate over nothing."""
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, nothing) -> {name}, {name} -> {body})"


def _folded(cells: str) -> str:
    """Cells of one place combined. Places and positions are sorted as one number, so runs of a place are slices."""
    start = "filter(transform(o, (v, i) -> if(i > 0 and shiftright(get(o, i - 1), 32) = shiftright(v, 32), -1, i)), v -> v >= 0)"
    one = "aggregate(slice(o, a + 1, coalesce(get(s, k + 1), size(o)) - a), struct(shiftright(get(o, a), 32) as cell, 0L as n, 0L as key, 0L as mark), (t, v) -> " + _let("e", "get(x, int(v & 4294967295L))", "named_struct('cell', t.cell, 'n', t.n + e.n, 'key', t.key ^ e.key, 'mark', t.mark ^ e.mark)") + ")"
    runs = f"filter(transform(s, (a, k) -> {one}), c -> c.n <> 0 or c.key <> 0 or c.mark <> 0)"
    return _let("x", cells, _let("o", "sort_array(transform(x, (c, i) -> shiftleft(c.cell, 32) | i))", _let("s", start, runs)))


def _entries(keys: str, size: str, n: str) -> str:
    """The three cells of each digest, one in each third of the sketch. Which they are depends on the size, so digests that share cells in one sketch part in the next."""
    cell = f"j * ({size} div 3) + pmod(xxhash64(d, j, {size}), {size} div 3)"
    return f"flatten(transform({keys}, d -> transform(array(0L, 1L, 2L), j -> named_struct('cell', {cell}, 'n', {n}, 'key', d, 'mark', xxhash64(d)))))"


def sketch(keys: str, size: str) -> str:
    """SQL for the sketch of an array of distinct digests in size cells, three or a multiple of it."""
    return _folded(_entries(keys, size, "1L"))


def less(left: str, right: str) -> str:
    """SQL for the difference of two sketches of one size."""
    return _folded(f"concat({left}, transform({right}, c -> named_struct('cell', c.cell, 'n', -c.n, 'key', c.key, 'mark', c.mark)))")


def peeled(cells: str, size: str) -> str:
    """SQL for struct(cells, plus, minus, going) of a difference: the digests that only its left, or right, side has, and the cells that are left, none if all digests were found. Each pass takes the digests that are alone in a cell, which its mark proves, out of all their cells."""
    alone = lambda n: f"array_distinct(transform(filter(t.cells, c -> c.n = {n}L and c.mark = xxhash64(c.key)), c -> c.key))"
    rest = _folded(f"concat(t.cells, {_entries('p.plus', size, '-1L')}, {_entries('p.minus', size, '1L')})")
    after = f"if(size(p.plus) + size(p.minus) = 0, named_struct('cells', t.cells, 'plus', t.plus, 'minus', t.minus, 'going', false), named_struct('cells', {rest}, 'plus', concat(t.plus, p.plus), 'minus', concat(t.minus, p.minus), 'going', true))"
    step = _let("p", f"named_struct('plus', {alone('1')}, 'minus', {alone('-1')})", after)
    none = "cast(array() as array<bigint>)"
    return f"aggregate(sequence(1, {PASSES}), named_struct('cells', {cells}, 'plus', {none}, 'minus', {none}, 'going', true), (t, r) -> if(t.going and size(t.cells) > 0, {step}, t))"


def difference(left: str, right: str) -> Column:
    """struct(plus, minus): the digests that only the left, or right, of two arrays of distinct digests has, found by peeling the difference of their sketches.

    The first sketches have at least five cells for four digests of both together; as long as peeling fails
    it is tried again with sketches of twice the size. Null if TRIES sizes do not do, which takes
    digests that share their cells in all of them.
    """
    first = f"shiftleft({CELLS}L, int(greatest(0, ceil(log2(greatest(size({left}) + size({right}), 1) * 1.25 / {CELLS})))))"
    try_ = _let("z", "shiftleft(f, k)", _let("t", peeled(less(sketch(left, "z"), sketch(right, "z")), "z"), "if(size(t.cells) = 0, named_struct('plus', t.plus, 'minus', t.minus), null)"))
    tries = f"aggregate(sequence(0, {TRIES - 1}), cast(null as struct<plus: array<bigint>, minus: array<bigint>>), (found, k) -> if(found is null, {try_}, found))"
    return F.expr(_let("f", first, tries))


def written(keys: str) -> Column:
    """A fingerprint as text: the number of its digests, and its cells, each place, count, digests and marks in hexadecimal digits."""
    cell = "concat(lower(hex(c.cell)), '.', lower(hex(c.n)), '.', lpad(lower(hex(c.key)), 16, '0'), '.', lpad(lower(hex(c.mark)), 16, '0'))"
    return F.expr(f"concat(size({keys}), ':', array_join(transform({sketch(keys, f'{CELLS}L')}, c -> {cell}), ','))")


def likeness(found: str, left: str, right: str) -> Column:
    """Shared paragraphs among all of two arrays of distinct digests, by their difference; 1 if neither has any."""
    differ = f"(size({found}.plus) + size({found}.minus))"
    both = f"(size({left}) + size({right}))"
    return F.expr(f"if({both} = 0, 1D, double({both} - {differ}) / double({both} + {differ}))")


def _groups(docs: DataFrame) -> Column:
    """A number of every row of docs (doc_id, h): rows in falling order of doc_id, null last, then of h, have rising numbers. There are about as many numbers as ROWS go into the rows, GROUPS and some at most.

    The bounds are quantiles of doc_id, one short array whatever the input. An id that is several
    quantiles has so many slices by h, and so have null ids.
    """
    n, n_null = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    groups = max(1, min(GROUPS, -(-(n - n_null) // ROWS)))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / groups for k in range(1, groups + 1)], 8 * groups + 10000)).first()[0] or []
    times = Counter(bounds)
    ids = sorted(times)
    step = max(1, int(len(ids) ** 0.5))
    whole = lambda values: F.from_json(F.lit(json.dumps(values)), "array<bigint>")
    rows = lambda times: F.least((0.5 - F.col("h") / 2.0**64) * times, times - 1).cast("long")
    # How many bounds are below the id: first whole steps, then within one.
    steps = F.size(F.filter(whole(ids[::step]), lambda x: x < F.col("doc_id")))
    below = F.when(steps == 0, 0).otherwise((steps - 1) * step + F.size(F.filter(F.slice(whole(ids), (steps - 1) * step + 1, F.lit(step)), lambda x: x < F.col("doc_id"))))
    hot = [b for b in ids if times[b] > 1]
    of = F.coalesce(F.try_element_at(F.map_from_arrays(whole(hot), whole([times[b] for b in hot])), F.col("doc_id")), F.lit(0)) if hot else F.lit(0)
    # Ids between two bounds come after the upper one, which may be hot.
    slice_ = F.when(of > 0, rows(of)).otherwise(F.lit(GROUPS))
    nulls = max(1, min(GROUPS, -(-n_null // ROWS)))
    return F.when(F.col("doc_id").isNull(), F.lit((len(ids) + 2) * 2 * GROUPS) + rows(F.lit(nulls))).otherwise((len(ids) - below).cast("long") * (2 * GROUPS) + slice_)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with next, the text of the document that follows in falling order of doc_id; the first one follows the last.

    Null ids come last, and rows of equal ids are in order of a hash of their texts, so each row that
    repeats another in both is followed by its like. Documents are put in order within groups of
    neighbours, with one shuffle of their texts: the first row of each group is also sent, as a guest, to
    the group before it.
    """
    docs = docs.withColumn("h", F.xxhash64("text"))
    docs = docs.withColumn("_group", _groups(docs))
    first = docs.groupBy("_group").agg(F.max(F.struct("doc_id", "h")).alias("_first"))
    # One row a group: GROUPS and some, of a few numbers each.
    all_ = Window.partitionBy(F.lit(0))
    guests = first.withColumn("_to", F.coalesce(F.lag("_group").over(all_.orderBy("_group")), F.max("_group").over(all_)))
    guests = F.broadcast(guests.select(F.col("_group").alias("_g"), "_first", "_to"))
    is_first = (F.col("_group") == F.col("_g")) & F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("h") == F.col("_first.h"))
    here = F.struct(F.col("_group").alias("g"), F.lit(False).alias("guest"))
    there = F.struct(F.col("_to").alias("g"), F.lit(True).alias("guest"))
    rows = docs.join(guests, is_first, "left").withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    rows = rows.select(*(c for c in docs.columns if c != "_group"), F.col("_at.g").alias("_g"), F.col("_at.guest").alias("_guest"))
    line = Window.partitionBy("_g").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return rows.withColumn("next", F.lead("text").over(line)).where("not _guest").drop("_g", "_guest", "h")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, n_paragraphs, the columns keep) of every row of docs. Null and empty texts, and blank ones, have no paragraphs. Nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"), F.struct(F.lit(0), *keep).alias("_kept")).withColumn("_keys", digests(F.col("_text")))
    return rows.select("doc_id", written("_keys").alias("fingerprint"), F.size("_keys").cast("long").alias("n_paragraphs"), *(F.col("_kept").getField(c).alias(c) for c in keep))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, edit and step, the digests (plus, minus) of the paragraphs that only the text, or only its edited form, or the next document, has, near_edited and near_next.

    The edited form has the last half of the code points, the middle one left out, replaced by the
    first as many, or all, of the next document (with_next). Fingerprints are sketches of the set of a
    text's paragraphs; the likeness of two texts is the share of paragraphs that both have among all of
    theirs, as peeling the difference of their sketches finds it, with larger sketches as long as
    it fails.

    Null texts are empty. Texts without paragraphs are alike. Equal texts have equal fingerprints. A null
    doc_id comes last, and rows that repeat a doc_id follow each other. A lone document is its own next.
    Texts of any length are taken whole; a group of neighbours is sorted with what memory there is, and spills.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = with_next(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int")), F.substr("next", F.lit(1), F.col("_half"))))
    rows = rows.select("doc_id", "n_chars", "edited", digests(F.col("text")).alias("_own"), digests(F.col("edited")).alias("_edited"), digests(F.col("next")).alias("_next"))
    rows = rows.withColumn("edit", difference("_own", "_edited")).withColumn("step", difference("_own", "_next"))
    return rows.select(
        "doc_id", "n_chars", "edited", written("_own").alias("fingerprint"), written("_edited").alias("edited_fingerprint"), "edit", "step",
        likeness("edit", "_own", "_edited").alias("near_edited"), likeness("step", "_own", "_next").alias("near_next"),
    )
