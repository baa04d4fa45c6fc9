"""Quality rules whose cutoffs are certified on labelled documents: few good ones are rejected, by exact binomial bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, scratch, text_or_empty, words_of

#: Cutoffs of each signal, all per cent, from the most lenient on: together the k-th ones are rung k of the ladder, which rejects a document if any signal is above its cutoff. So each rung rejects what the one before it does, and more.
LADDER = {
    "symbols": (250, 200, 150, 100, 75, 50, 40, 30, 20, 15, 10),
    "dup_lines": (98, 95, 90, 85, 80, 75, 70, 60, 55, 50, 45),
    "repeats": (49, 48, 47, 46, 45, 44, 42, 40, 38, 36, 35),
    "capitals": (95, 90, 85, 80, 75, 70, 60, 50, 40, 35, 30),
    "shouts": (150, 120, 100, 90, 80, 70, 60, 50, 40, 30, 20),
}
RUNGS = 11
#: Share of the good documents of a stratum that its rung may reject, and the chance that some stratum exceeds it.
RISK, DELTA = 0.02, 0.05
#: Terms of a binomial tail that are summed in a row; a longer tail is several rows.
TERMS = 4096


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """One row per row of docs: its id, the columns keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the signals of LADDER and rung, the first rung that rejects it, RUNGS + 1 if none does.

    Everything is counted inside the row by array functions, whatever the length of a text; nothing is
    shuffled. A null text has no words, and a text without words has all signals at 0.
    """
    text = F.col("_text")
    d = docs.select(F.col(id_col).alias("doc_id"), *keep, text_or_empty(text_col).alias("_text"))
    d = d.withColumn("_words", words_of(text)).withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    windows = F.when(
        F.col("n_words") >= 3,
        F.expr("array_sort(transform(slice(_words, 1, size(_words) - 2), (w, i) -> struct(concat(w, ' ', _words[i + 1], ' ', _words[i + 2]) as w, i as i)))"),
    )
    d = d.withColumn("_lines", lines).withColumn("_windows", windows)
    # Equal windows are neighbours after the sort; a window repeats if either neighbour is equal.
    starts = F.expr("transform(filter(_windows, (x, k) -> (k > 0 and x.w = _windows[k - 1].w) or (k + 1 < size(_windows) and x.w = _windows[k + 1].w)), x -> x.i)")
    d = d.withColumn("_starts", F.when((F.col("n_words") >= 4) & (F.size(F.array_distinct("_windows.w")) < F.size("_windows")), F.array_sort(starts)))
    # Sorted starts: each window adds the words after the end of the one before it.
    covered = F.expr("aggregate(transform(_starts, (s, k) -> if(k = 0, 3, least(3, s - _starts[k - 1]))), 0L, (a, x) -> a + x)")
    d = d.select(
        "doc_id", *keep, "n_words",
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("_n_capitals"),
        F.length(F.regexp_replace(text, "[^!]+", "")).cast("long").alias("_n_shouts"),
    )
    share = lambda part, whole: F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole)).otherwise(0.0)
    d = d.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "n_words").alias("symbols"),
        share("n_dup_lines", "_n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("_n_capitals", "word_chars").alias("capitals"),
        share("_n_shouts", "n_words").alias("shouts"),
    )
    # The first rung of a signal is one more than its cutoffs that are not exceeded.
    rung = F.least(*(sum(((F.col(s) <= float(c)).cast("int") for c in cuts), F.lit(1)) for s, cuts in LADDER.items()))
    return d.withColumn("rung", rung)


#: ln(n!): exact to 20, Stirling's series beyond.
_LN_FACT = "if({n} <= 20, ln(factorial(cast({n} as int))), {n} * ln({n}) - {n} + 0.5 * ln(6.283185307179586D * {n}) + 1D / (12 * {n}) - 1D / (360 * pow({n}, 3)) + 1D / (1260 * pow({n}, 5)))"


def log_term(n: str, j: str, risk: float) -> str:
    """SQL for the logarithm of P(Binomial(n, risk) = j)."""
    fact = lambda x: _LN_FACT.format(n=x)
    return f"({fact(f'double({n})')} - ({fact(f'double({j})')}) - ({fact(f'double({n} - {j})')}) + {j} * ln({risk}D) + ({n} - {j}) * ln({1 - risk}D))"


def binomial_tails(tests: DataFrame, keys: tuple[str, ...], risk: float) -> DataFrame:
    """tests (keys, x, n) with p = P(Binomial(n, risk) <= x), summed term by term, in rows of TERMS terms each; 1 from the mean on, where it is never small."""
    small = tests.where(F.col("x") < F.col("n") * risk).withColumn("_low", F.explode(F.expr(f"sequence(0L, x, {TERMS}L)")))
    part = F.expr(f"aggregate(transform(sequence(_low, least(x, _low + {TERMS - 1})), j -> exp({log_term('n', 'j', risk)})), 0D, (a, t) -> a + t)")
    sums = small.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.sum(part).alias("_p"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return tests.join(sums, same, "left").withColumn("p", F.coalesce("_p", F.lit(1.0))).drop("_p", *(f"_{k}" for k in keys))


def fit_rungs(measured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, certified) of the strata for which a rung could be certified: the strictest that surely rejects at most `risk` of the good documents.

    The holdout is every labelled good document that passes the base rules. In a stratum the rungs
    are tested from the most lenient on: the hypothesis "it rejects more than risk of the good
    documents" falls if the exact binomial probability of so few rejections is at most the
    stratum's level. Tests stop at the first that stands (fixed sequence over nested rungs), so no
    further correction is due within a stratum; across strata delta is shared in proportion to their
    good labels (weighted Bonferroni), which the tests do not look at. With no rejection n good labels
    certify a rung if (1 - risk) ** n is at most the level. A stratum, null included, is judged by
    its own labels only; one without labels has no row.

    A labelled id is one trial of its stratum, however many rows repeat it: the strictest verdict of
    those rows counts. Copies of one text under labelled ids of their own are trials of their own, for
    the share that is bounded is one of documents, copies included, of which the labelled ids are taken
    to be independent draws.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    held = measured.where("not base_failed").join(good, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    held = held.groupBy(stratum, "doc_id").agg(F.min("rung").alias("rung"))
    counts = held.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), F.array(*(F.count_if(F.col("rung") <= k) for k in range(1, RUNGS + 1))).alias("_x"))
    counts = materialise(counts, f"{scratch(measured.sparkSession)}/counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    tests = counts.select("stratum", "n", F.posexplode("_x").alias("k", "x"))
    judged = binomial_tails(tests, ("stratum", "k"), risk).withColumn("passed", F.col("p") <= F.col("n") * delta / total)
    # k counts from 0: the first that stands is the number of rungs certified before it.
    fell = judged.groupBy("stratum").agg(F.coalesce(F.min(F.when(~F.col("passed"), F.col("k"))), F.lit(RUNGS)).cast("int").alias("certified"))
    return fell.where("certified > 0")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keep: tuple[str, ...] = (), risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The measures of every row of docs, with kept: false if the base rules fail or the stratum's certified rung rejects it.

    labels has doc_id and quality (1 is good; null is no label; repeated rows count once). An empty
    table of labels certifies nothing, and the base rules alone decide, as they do in strata without
    enough labels. A null stratum is a stratum. Rows of docs that repeat a doc_id are judged each by its
    own text; of a labelled id they are one trial. Texts of any length are measured whole. An empty table gives an empty result. Columns named in keep
    are carried along, whatever their names but those of the result.
    """
    at = scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), F.struct(F.col(stratum_col).cast("string").alias("stratum"), *(F.col(c) for c in keep)).alias("__kept"))
    # The measures are a few numbers a document: written once, they serve the fit and the verdicts.
    measured = materialise(measure(rows, "doc_id", "__text", "__kept"), f"{at}/measured")
    fitted = fit_rungs(measured.withColumn("__stratum", F.col("__kept.stratum")), labels, "__stratum", risk, delta)
    # One row per certified stratum; both sides have known sizes, so few strata are broadcast and many are not.
    fitted = materialise(fitted, f"{at}/rungs")
    out = measured.join(fitted, F.col("__kept.stratum").eqNullSafe(F.col("stratum")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("rung") > F.col("certified"), F.lit(True))
    return out.select("doc_id", *(F.col("__kept").getField(c).alias(c) for c in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *LADDER, "rung")
