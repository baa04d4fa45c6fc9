"""Windows of symbols, their fingerprints, and the ranges that two sets of files share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.scalars import U32, exploded, line_slice, mixed_symbol, sliding_hash, sliding_sum
from ..model import WINDOW
from ..shared import materialise


def check_window(k: int, strict: bool = False) -> int:
    if k < 1 or strict and (k < WINDOW or k % WINDOW):
        raise ValueError(f"a window of {k} symbols is not allowed")
    return k


def windows(files: DataFrame, k: int) -> DataFrame:
    """(file_id, pos, fp) of every window of k symbols of files (file_id, syms). The sums are taken inside the row; nothing is shuffled. Shorter files have none."""
    sums = sliding_sum(files.select("file_id", "syms"), F.transform("syms", mixed_symbol), check_window(k), "_sums")
    return exploded(sums, "file_id", F.col("_sums"), "pos", "sum").select("file_id", F.col("pos").cast("long").alias("pos"), F.col("sum").bitwiseAND(U32).alias("fp"))


def windows_deep(files: DataFrame, k: int) -> DataFrame:
    """(file_id, pos, fp, name, line): windows() of deep files (file_id, syms, names, lines), with the name and line of each window's first symbol."""
    sums = sliding_sum(files.select("file_id", "syms", "names", "lines"), F.transform("syms", mixed_symbol), check_window(k), "_sums")
    rows = exploded(sums, "file_id", F.arrays_zip(F.col("_sums").alias("sum"), F.slice("names", F.lit(1), F.size("_sums")).alias("name"), F.slice("lines", F.lit(1), F.size("_sums")).alias("line")), "pos", "w")
    return rows.select("file_id", F.col("pos").cast("long").alias("pos"), F.col("w.sum").bitwiseAND(U32).alias("fp"), "w.name", "w.line")


def window_index(files: DataFrame, k: int) -> DataFrame:
    """(fp, file_id, positions): the inverted index. A row holds the positions of one file, as many as it has symbols at most, so a fingerprint that most files have is many rows."""
    check_window(k)
    # A file is one row, so its positions are grouped inside the row; only those of ids that have several rows meet in a shuffle.
    several = materialise(files.groupBy("file_id").count().where("count > 1").select("file_id"))
    if several.isEmpty():
        return kernels.index_rows(files, k)
    rest = kernels.index_rows(files.join(several, "file_id", "left_semi"), k)
    rest = rest.select("fp", "file_id", F.explode("positions").alias("pos")).groupBy("fp", "file_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    null = kernels.index_rows(files.where("file_id is null"), k)
    return kernels.index_rows(files.where("file_id is not null").join(several, "file_id", "left_anti"), k).unionByName(null).unionByName(rest)


def candidates(base: DataFrame, search: DataFrame, k: int) -> DataFrame:
    """(base_id, search_id, base_pos, search_pos) of windows with equal fingerprints."""
    b = windows(base, k).select(F.col("file_id").alias("base_id"), F.col("pos").alias("base_pos"), "fp")
    s = windows(search, k).select(F.col("file_id").alias("search_id"), F.col("pos").alias("search_pos"), "fp")
    return b.join(s, "fp").select("base_id", "search_id", "base_pos", "search_pos")


def touched(files: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The files that found names in id_col. The semi join is pushed to the scan, so what is derived from a file is made for those files only."""
    return files.join(found.select(F.col(id_col).alias("file_id")).distinct(), "file_id", "left_semi")


def verified(found: DataFrame, base: DataFrame, search: DataFrame, k: int) -> DataFrame:
    """Candidates whose windows are equal symbol by symbol: a fingerprint does not see the order of symbols. Arrays are made for and joined to candidates only."""
    found = materialise(found)
    b = touched(base, found, "base_id").select(F.col("file_id").alias("base_id"), F.col("syms").alias("_b"))
    s = touched(search, found, "search_id").select(F.col("file_id").alias("search_id"), F.col("syms").alias("_s"))
    same = F.slice("_b", F.col("base_pos").cast("int") + 1, F.lit(k)) == F.slice("_s", F.col("search_pos").cast("int") + 1, F.lit(k))
    return found.join(b, "base_id").join(s, "search_id").where(same).select("base_id", "search_id", "base_pos", "search_pos")


def merged(hits: DataFrame, k: int) -> DataFrame:
    """Runs of hits on one diagonal as ranges (base_id, search_id, base_start, base_end, search_start, search_end), ends included."""
    hits = hits.withColumn("_shift", F.col("base_pos") - F.col("search_pos"))
    run = F.col("base_pos") - F.row_number().over(Window.partitionBy("base_id", "search_id", "_shift").orderBy("base_pos"))
    ends = (F.max(c) + k - 1 for c in ("base_pos", "search_pos"))
    b, s = ends
    return (
        hits.withColumn("_run", run).groupBy("base_id", "search_id", "_shift", "_run")
        .agg(F.min("base_pos").alias("base_start"), b.alias("base_end"), F.min("search_pos").alias("search_start"), s.alias("search_end"))
        .select("base_id", "search_id", "base_start", "base_end", "search_start", "search_end")
    )


def hashed_windows(files: DataFrame, k: int) -> DataFrame:
    """(file_id, pos, fp): windows() with 64-bit hashes that, unlike fingerprints, see the order of symbols."""
    rows = sliding_hash(files.select("file_id", "syms"), F.col("syms"), check_window(k), "_hashes")
    return exploded(rows, "file_id", F.col("_hashes"), "pos", "fp").select("file_id", F.col("pos").cast("long").alias("pos"), "fp")


def verified_ranges(ranges: DataFrame, base: DataFrame, search: DataFrame, k: int) -> DataFrame:
    """The longest stretches of at least k symbols within ranges that are equal symbol by symbol. A range takes what it covers from each file as the file is joined."""
    ranges = materialise(ranges)
    length = (F.col("base_end") - F.col("base_start") + 1).cast("int")
    both = ranges
    for side, files in (("base", base), ("search", search)):
        some = touched(files, ranges, f"{side}_id").select(F.col("file_id").alias(f"{side}_id"), "syms")
        both = both.join(some, f"{side}_id").select(*both.columns, F.slice("syms", F.col(f"{side}_start").cast("int") + 1, length).alias(f"_{side}"))
    # Places that differ, with one before and one after all; a stretch lies between two of them.
    other = "concat(array(-1), filter(transform(zip_with(_base, _search, (p, q) -> p = q), (same, i) -> if(same, -2, i)), i -> i >= 0), array(size(_base)))"
    both = both.withColumn("_others", F.expr(other)).withColumn("_id", F.struct("base_id", "search_id", "base_start", "search_start"))
    found = f"filter(transform(_others, (x, i) -> named_struct('a', bigint(if(i = 0, x, get(_others, i - 1)) + 1), 'z', bigint(x - 1))), r -> r.z - r.a + 1 >= {k})"
    rows = exploded(both, "_id", F.expr(found), "_k", "r").select("_id.*", "r.*")
    at = lambda side, x: (F.col(f"{side}_start") + F.col(x)).alias(f"{side}_{'start' if x == 'a' else 'end'}")
    return rows.select("base_id", "search_id", at("base", "a"), at("base", "z"), at("search", "a"), at("search", "z"))


def search(base: DataFrame, wanted: DataFrame, k: int = WINDOW, fast: bool = False, strict: bool = False) -> DataFrame:
    """The ranges that files of wanted share with files of base, both (file_id, syms); with fast only the pairs (base_id, search_id). Windows meet on hashes that see the order of symbols, and ranges of them are verified as a whole, so a range takes its files' symbols once."""
    check_window(k, strict)
    b, s = (hashed_windows(files, k).select(F.col("file_id").alias(f"{side}_id"), F.col("pos").alias(f"{side}_pos"), "fp") for side, files in (("base", base), ("search", wanted)))
    found = verified_ranges(merged(b.join(s, "fp").drop("fp"), k), base, wanted, k)
    return found.select("base_id", "search_id").distinct() if fast else found


def search_blocks(base: DataFrame, wanted: DataFrame, k: int = WINDOW, deep: bool = False) -> DataFrame:
    """The rows of search(), or with deep those of search_deep(), for sets of files whose windows nearly all meet, as those of code by classes of tokens do: the ranges are then as many as pairs of files, and a shuffle of their windows, or of ranges with what they cover, is far larger than the files.

    Both sets are cut into blocks of a bounded number of symbols, and a task has one block of each, so base is read as
    often as wanted has blocks. Nothing is shuffled but files, and a range leaves its task complete. The sets are read
    twice, once for their sizes; store what is dear to make."""
    check_window(k)
    spark = base.sparkSession
    columns = ["file_id", "syms", *(("names", "lines") if deep else ())]
    base, wanted = (files.where("file_id is not null").select(*columns) for files in (base, wanted))
    n, m = (files.agg(F.coalesce(F.sum(F.size("syms")), F.lit(0))).first()[0] for files in (base, wanted))
    # Few symbols are dealt to all tasks, in blocks of a 16th of the full size at least.
    tasks = spark.sparkContext.defaultParallelism
    rows, across = max(-(-n // kernels.BASE_BLOCK), min(tasks, -(-16 * n // kernels.BASE_BLOCK)), 1), max(-(-m // kernels.SEARCH_BLOCK), 1)
    own = lambda count: F.pmod(F.xxhash64("file_id"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    b = base.select("*", own(rows).alias("i"), each(across).alias("j"), F.lit(True).alias("base"))
    s = wanted.select("*", each(rows).alias("i"), own(across).alias("j"), F.lit(False).alias("base"))
    dealt = b.unionByName(s).select((F.col("i") * across + F.col("j")).alias("block"), "base", *columns)
    return kernels.ranges_of_blocks(dealt.repartitionById(rows * across, "block"), k, deep)


def search_all(base: DataFrame, origins: DataFrame, wanted: DataFrame, k: int = WINDOW) -> DataFrame:
    """search() in files of several sets, with the set (file_id, origin) of each base file: one search, however many sets there are."""
    return search(base, wanted, k).join(origins.select(F.col("file_id").alias("base_id"), "origin"), "base_id")


def shares_window(base: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(search_id) of the files of wanted that share a window with any of base."""
    return search(base, wanted, k, fast=True).select("search_id").distinct()


def classes(files: DataFrame) -> DataFrame:
    """(file_id, class_id): files of equal symbols, by the smallest id. Arrays meet as 128 bits of hashes."""
    keyed = files.select("file_id", F.xxhash64("syms").alias("_h"), F.xxhash64(F.lit("second"), "syms").alias("_g"))
    least = keyed.groupBy("_h", "_g").agg(F.min("file_id").alias("class_id"))
    return keyed.join(least, ["_h", "_g"]).select("file_id", "class_id")


def anchors(files: DataFrame, k: int) -> DataFrame:
    """(file_id, pos, fp): of every window of k symbols the part of about half its length with the least hash, so windows of equal content have equal anchors. About one position in k / 4 is one.

    With a column runs (periodic_runs) windows inside a run count only if they are its first or last: within a run all
    others repeat them.
    """
    if "runs" not in files.columns:
        files = files.withColumn("runs", F.expr("cast(array() as array<struct<a: bigint, z: bigint>>)"))
    return kernels.anchor_rows(files, k)


def periodic_runs(files: DataFrame, k: int) -> DataFrame:
    """files (file_id, syms) with runs, an array of (a, z, period, word): all maximal stretches a to z of at least k symbols in which every symbol is the one `period` places before, for the least such period of k / 2 at most. word is the least rotation of what is repeated, so runs of equal words hold windows of each other.

    Symbols are compared with those 1, 2, ... k / 2 places before, for many files at once. A file takes linear time.
    """
    return kernels.run_rows(files, k)


def self_search(files: DataFrame, k: int = WINDOW) -> DataFrame:
    """Ranges between files of one set, base_id < search_id. Files of equal symbols are one class, and only the classes' first files are compared; classes() tells the members.

    The ranges are the longest stretches of at least k equal symbols, but for those inside a periodic run
    (periodic_runs): a pair of runs of one word, which agree at one shift in every period, gives one range, of the
    whole runs. So a repeated word or line gives a row for each pair of its runs and not for all ways to lay them over
    each other, and the rows of two files are as many as the passages they share.

    Files meet on anchors, which any shared window outside of runs has, and the first and last window of a run; each
    pair of files then compares, at each shift, what lies between its anchors. reuse() links each passage with its
    first file only.
    """
    # Symbols are made once, not for the classes' hashes and again for their first files.
    files = materialise(files.select("file_id", "syms"))
    first = files.join(classes(files).where("file_id = class_id").select("file_id"), "file_id", "left_semi")
    known = materialise(periodic_runs(first, k))
    found = materialise(anchors(known, k))
    shared = found.groupBy("fp").agg(F.min("file_id").alias("_a"), F.max("file_id").alias("_z")).where("_a < _z").select("fp")
    found = materialise(found.join(shared, "fp", "left_semi"))
    b, s = (found.select(F.col("file_id").alias(f"{side}_id"), F.col("pos").alias(f"{side}_pos"), "fp") for side in ("base", "search"))
    spans = b.join(s, "fp").where("base_id < search_id").groupBy("base_id", "search_id", (F.col("base_pos") - F.col("search_pos")).alias("shift"))
    spans = spans.agg((F.min("search_pos") - k).alias("low"), (F.max("search_pos") + 2 * k).alias("high"))
    pairs = materialise(spans.groupBy("base_id", "search_id").agg(F.collect_list(F.struct("shift", "low", "high")).alias("spans")))
    runs = exploded(known.where(F.size("runs") > 0), "file_id", F.col("runs"), "_k", "r").select("file_id", "r.a", "r.z", "r.word")
    b, s = (runs.select(F.col("file_id").alias(f"{side}_id"), "word", F.col("a").alias(f"{side}_start"), F.col("z").alias(f"{side}_end")) for side in ("base", "search"))
    columns = ["base_id", "search_id", "base_start", "base_end", "search_start", "search_end"]
    return equal_runs(pairs, known, k).select(columns).unionByName(b.join(s, "word").where("base_id < search_id").select(columns))


def equal_runs(pairs: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """The longest stretches of at least k equal symbols of pairs (base_id, search_id, spans), between low and high of the search file at each span's shift, which is base_pos - search_pos; but for stretches inside a run of files (file_id, syms, runs). A pair of files is one row, which has the symbols that its spans reach once; stretches of many pairs are found together."""
    both = pairs
    for side, shift in (("base", "x.shift"), ("search", "0")):
        runs = ("runs",) if side == "base" else ()
        some = touched(files, pairs, f"{side}_id").select(F.col("file_id").alias(f"{side}_id"), F.col("syms").alias(side), *runs)
        start, end = f"greatest(0, array_min(transform(spans, x -> x.low + {shift})))", f"array_max(transform(spans, x -> x.high + {shift}))"
        part = F.expr(f"slice({side}, int({start}) + 1, int(greatest(0, {end} - {start})))").alias(side)
        both = both.join(some, f"{side}_id").select(*both.columns, *runs, F.expr(f"bigint({start})").alias(f"{side}_from"), part)
    return kernels.equal_spans(both.withColumn("runs", F.expr("transform(runs, r -> named_struct('a', r.a, 'z', r.z))")), k)


def reuse(files: DataFrame, k: int = WINDOW) -> DataFrame:
    """Ranges of files whose windows another file of the set has too, each window linked with the file of the smallest id that has it: (base_id, search_id, base_start, base_end, search_start, search_end). A passage that very many files share gives a row for each, not for each pair.

    The windows of one anchor are a row, with a hash of what they cover. Where all that share an anchor cover the same, its
    first file is that of every window; else the windows of each distinct content, taken once, tell their first files. Ranges
    are verified symbol by symbol as a whole, so no window carries the symbols of its files."""
    spans = materialise(kernels.span_rows(files, check_window(k)))
    shared = spans.groupBy("fp").agg(F.min("file_id").alias("_a"), F.max("file_id").alias("_z")).where("_a < _z").select("fp")
    spans = materialise(spans.join(materialise(shared), "fp", "left_semi"))
    key = ["fp", "content"]
    contents = materialise(spans.groupBy(key).agg(F.min(F.struct("file_id", "first", "n")).alias("x")).select(*key, "x.*"))
    several = materialise(contents.groupBy("fp").count().where("count > 1").select("fp"))
    # A content that no other shares its anchor with is found as a whole in its first file.
    alone = contents.join(several, "fp", "left_anti").select(*key, F.lit(0).cast("long").alias("low"), (F.col("n") - 1).alias("high"), F.col("file_id").alias("base_id"), F.col("first").alias("base_pos"))
    held = contents.join(several, "fp", "left_semi").groupBy("file_id").agg(F.collect_list(F.struct(*key, "first", "n")).alias("spans"))
    w = materialise(kernels.span_windows(files.join(materialise(held), "file_id").select("file_id", "syms", "spans"), k))
    first = w.groupBy("fp", "hash").agg(F.min(F.struct("file_id", "pos")).alias("_f"))
    first = materialise(first.select("fp", "hash", F.col("_f.file_id").alias("base_id"), F.col("_f.pos").alias("base_pos")))
    found = w.select(*key, "at", "hash").join(first, ["fp", "hash"]).withColumn("_shift", F.col("base_pos") - F.col("at"))
    run = F.col("at") - F.row_number().over(Window.partitionBy(*key, "base_id", "_shift").orderBy("at"))
    parts = found.withColumn("_run", run).groupBy(*key, "base_id", "_shift", "_run").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.min("base_pos").alias("base_pos"))
    parts = materialise(parts.select(alone.columns).unionByName(alone))
    hits = spans.select(*key, F.col("file_id").alias("search_id"), "first").join(parts, key).where("search_id > base_id")
    hits = hits.select("base_id", "search_id", "base_pos", (F.col("base_pos") + F.col("high") - F.col("low")).alias("base_last"), (F.col("first") + F.col("low")).alias("search_pos"))
    return verified_ranges(_joined(hits, k), files, files, k)


def _joined(hits: DataFrame, k: int) -> DataFrame:
    """Neighbouring stretches of windows on one diagonal, (base_id, search_id, base_pos, base_last, search_pos), as ranges."""
    shift = F.col("base_pos") - F.col("search_pos")
    w = Window.partitionBy("base_id", "search_id", "_shift").orderBy("base_pos")
    rows = hits.withColumn("_shift", shift).withColumn("_new", (F.col("base_pos") > F.coalesce(F.lag("base_last").over(w), F.lit(-2)) + 1).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w)).groupBy("base_id", "search_id", "_shift", "_run").agg(F.min("base_pos").alias("base_start"), (F.max("base_last") + k - 1).alias("base_end"))
    return rows.select("base_id", "search_id", "base_start", "base_end", (F.col("base_start") - F.col("_shift")).alias("search_start"), (F.col("base_end") - F.col("_shift")).alias("search_end"))


def previous_places(names: Column | str) -> Column:
    """Array of how many places before each name of an array the same name stood last, 0 if it did not. Equal arrays of these are those of names that one renaming makes of each other. The sorted names are bound to a variable, as an expression inside a lambda is made again for each element."""
    order = F.array_sort(F.transform(names, lambda x, i: F.struct(x.alias("n"), i.alias("i"))))
    back = lambda o: F.transform(o, lambda x, k: F.struct(x.i.alias("i"), F.when((k > 0) & (F.get(o, k - 1).n == x.n), x.i - F.get(o, k - 1).i).otherwise(0).alias("back")))
    return F.get(F.transform(F.array(order), lambda o: F.transform(F.array_sort(back(o)), lambda x: x.back)), F.lit(0))


def deep_ranges(ranges: DataFrame, base: DataFrame, search: DataFrame) -> DataFrame:
    """The second phase of a search, over its hits only: ranges with the lines, counted from 1, that they begin and end on; n_renamed, the symbols whose names differ; explained, how many names from the start on one renaming, which gives different names different names, explains; and consistent, whether it explains the whole range. base and search are deep files (file_id, names, lines); they are made for the files of ranges only.

    Names are compared by the places where each stood last (previous_places), which are made once a file; a place before the
    range counts as none. What a range covers is cut out as soon as its file is joined, so no range carries whole files on.
    """
    length = F.col("base_end") - F.col("base_start") + 1
    for side, files in (("base", base), ("search", search)):
        deep = materialise(touched(files, ranges, f"{side}_id").select(F.col("file_id").alias(f"{side}_id"), "names", "lines", previous_places("names").alias("back")))
        start, end = (F.col(f"{side}_{x}").cast("int") + 1 for x in ("start", "end"))
        lines = (F.element_at("lines", x).cast("long").alias(f"{side}_{name}_line") for name, x in (("start", start), ("end", end)))
        parts = (F.slice(x, start, length.cast("int")).alias(f"_{side}_{x}") for x in ("names", "back"))
        ranges = ranges.join(deep, f"{side}_id").select(*ranges.columns, *lines, *parts)
    renamed = F.size(F.filter(F.zip_with("_base_names", "_search_names", lambda x, y: x != y), lambda x: x)).cast("long")
    within = lambda side: F.transform(f"_{side}_back", lambda x, i: F.when(x > i, 0).otherwise(x))
    broken = F.array_position(F.zip_with(within("base"), within("search"), lambda x, y: x != y), F.lit(True))
    ranges = ranges.withColumn("n_renamed", renamed).withColumn("_broken", broken).withColumn("explained", F.when(F.col("_broken") == 0, length).otherwise(F.col("_broken") - 1)).withColumn("consistent", F.col("explained") == length)
    return ranges.drop("_broken", *(f"_{side}_{x}" for side in ("base", "search") for x in ("names", "back")))


def search_deep(base: DataFrame, wanted: DataFrame, k: int = WINDOW) -> DataFrame:
    """search() with lines, renamed symbols and whether one renaming explains them, of deep files (file_id, syms, names, lines)."""
    found = materialise(search(base, wanted, k))
    return deep_ranges(found, base, wanted)


def with_content(ranges: DataFrame, contents: DataFrame, side: str = "base") -> DataFrame:
    """ranges with the lines of contents (file_id, text, licence) that they cover; texts are joined when the ranges are final, and only those of their files."""
    c = touched(contents, ranges, f"{side}_id").select(F.col("file_id").alias(f"{side}_id"), F.col("text").alias("_text"), F.coalesce("licence", F.lit("")).alias("licence"))
    out = ranges.join(c, f"{side}_id", "left")
    return out.withColumn("content", line_slice(F.col("_text"), F.col(f"{side}_start_line"), F.col(f"{side}_end_line"))).drop("_text")


def longest(ranges: DataFrame, n: int) -> DataFrame:
    """The n longest ranges; ties by ids and starts."""
    out = ranges.withColumn("length", F.col("base_end") - F.col("base_start") + 1)
    return out.orderBy(F.desc("length"), "base_id", "search_id", "base_start", "search_start").limit(n)


def coverage(ranges: DataFrame) -> DataFrame:
    """(search_id, n_ranges, n_bases, covered): symbols of a search file that lie in any range, overlaps once."""
    w = Window.partitionBy("search_id").orderBy("search_start", "search_end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("search_end").over(w), F.lit(-1))
    new = F.greatest(F.col("search_end") - F.greatest(F.col("search_start"), reach + 1) + 1, F.lit(0))
    return ranges.withColumn("_new", new).groupBy("search_id").agg(F.count("*").alias("n_ranges"), F.countDistinct("base_id").alias("n_bases"), F.sum("_new").alias("covered"))


def neighbours(ranges: DataFrame) -> DataFrame:
    """ranges with the starts of the range before and after in the same search file; the first and last stay on themselves."""
    w = Window.partitionBy("search_id").orderBy("search_start", "search_end", "base_id", "base_start")
    return ranges.withColumn("previous_start", F.coalesce(F.lag("search_start").over(w), "search_start")).withColumn("next_start", F.coalesce(F.lead("search_start").over(w), "search_start"))
