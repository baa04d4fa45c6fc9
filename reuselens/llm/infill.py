"""Fill-in-the-middle: texts are cut at two random units and their parts put in another order, so that a model learns to fill gaps."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Marks of the prefix, the suffix and the middle; they must not be in a text that is rearranged.
MARKS = ("<P>", "<S>", "<M>")
#: Per cent of the texts that are rearranged, and of those that begin with the suffix.
RATE, SPM = 50, 80
SEED = 42
#: The characters at which the class of text changes, from units to the space before them.
BLANKS = "\x20\t\n\x0b\f\r"
_RESULT = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def scanner(marks: tuple[str, ...]) -> ahocorasick.Automaton:
    """One automaton for all events: a blank counts 0, a mark 1."""
    found = ahocorasick.Automaton()
    for word in BLANKS:
        found.add_word(word, 0)
    for word in marks:
        found.add_word(word, 1)
    found.make_automaton()
    return found


def unit_cuts(text: str, draws: tuple[int, int], automaton: ahocorasick.Automaton) -> tuple[int, int, int, bool]:
    """(n, end of the prefix, end of the middle, whether a mark is in the text) in code points. A unit is a word with the blanks before it, or the blanks that end the text.

    Only events are looked at: a gap between two blanks is one unit if anything is in it and none
    otherwise, so the number of gaps before a place is the rank of its unit, and the k-th gap ends
    where the k-th unit does.
    """
    events = np.fromiter((2 * end + kind for end, kind in automaton.iter(text)), np.int64)
    blanks = events[events & 1 == 0] >> 1
    before, after = np.append(-1, blanks), np.append(blanks, len(text))
    ends = after[after - before > 1]
    if len(blanks) and blanks[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    n = len(ends)
    first, last = sorted(h % (n + 1) for h in draws)
    ends = np.append(0, ends)
    return n, int(ends[first]), int(ends[last]), len(blanks) < len(events)


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be three different texts of which none holds another or begins with what another, or itself, ends with: then the first place where one is found is where it was put."""
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for x in marks:
        for y in marks:
            if x != y and y in x or any(x.endswith(y[:k]) for k in range(1, len(y))):
                raise ValueError(f"{y!r} is in {x!r} or begins with what it ends with")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, seed: int = SEED, rate: int = RATE, spm: int = SPM, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output, and the columns keep.

    The first four numbers of the digest of seed and doc_id choose both cuts and the form, so a rerun
    agrees and rows need not meet: nothing is shuffled. Texts stay with Spark; Python sees a text
    once and gives back four numbers.

    A null text is empty, and an empty text, or one that holds a mark, is plain. A null doc_id counts as
    an empty one. Rows that repeat a doc_id are cut by the same draws, each at its own units. A text of
    any length is scanned whole, at eight bytes for each of its blanks. An empty table gives an empty
    result. Other columns are not read but for keep, whose names must not be those of the result.
    """
    check_marks(marks)
    if set(keep) & set(_RESULT):
        raise ValueError(f"columns of the result: {', '.join(sorted(set(keep) & set(_RESULT)))}")

    @F.arrow_udf("struct<n bigint, prefix bigint, upto bigint, marked boolean>")
    def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        automaton = scanner(marks)
        found = [unit_cuts(t.as_py(), (a.as_py(), b.as_py()), automaton) for t, a, b in zip(texts, first, second, strict=True)]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n", "prefix", "upto", "marked"])

    p, s, m = map(F.lit, marks)
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"), *([F.struct(*keep).alias("_kept")] if keep else []))
    rows = rows.withColumn("_digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    rows = rows.withColumn("_cut", cuts("_text", _draw(F.col("_digest"), 0), _draw(F.col("_digest"), 1)))
    plain = (text == "") | F.col("_cut.marked") | (_draw(F.col("_digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("_digest"), 3) % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    prefix = F.substr(text, F.lit(1), F.col("_cut.prefix").cast("int"))
    middle = F.substr(text, F.col("_cut.prefix").cast("int") + 1, (F.col("_cut.upto") - F.col("_cut.prefix")).cast("int"))
    suffix = F.substr(text, F.col("_cut.upto").cast("int") + 1)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    of = lambda chars: F.when(F.col("form") != "plain", chars)
    return rows.select(
        "doc_id", F.col("_cut.n").alias("n"), "form", of(F.col("_cut.prefix")).alias("prefix_chars"), of(F.col("_cut.upto") - F.col("_cut.prefix")).alias("middle_chars"),
        output.alias("output"), *(F.col("_kept").getField(c).alias(c) for c in keep),
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle made output and form of. Null stays null."""
    p, s, m = marks

    def between(first: str, second: str) -> Column:
        """The three parts of an output that begins with the mark first."""
        head = F.split(F.substr(output, F.lit(len(first) + 1)), F.lit(rf"\Q{second}\E"), 2)
        rest = F.split(head[1], F.lit(rf"\Q{m}\E"), 2)
        return F.array(head[0], rest[0], rest[1])

    psm, spm = between(p, s), between(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], spm[0]))
