"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import random
import re
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reuselens.llm import audit, infill, sketches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def table(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "a", 0) for i, t in rows], SCHEMA)


def odd_texts():
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "Bé", "ZZ", "#x", "語", "\U0001f600", " ", " z", "end."])
    space = lambda: "".join(rng.choice(" \t\n\x0b\f\r") for _ in range(rng.randrange(1, 4)))
    some = ["".join(word() + space() for _ in range(rng.randrange(0, 30))).strip() for _ in range(60)]
    return [None, "", " ", "\n\t ", "x", " x", "x ", "  x  y  ", *some, *(s + " " for s in some[:10]), *("  " + s for s in some[:10]), some[0], some[0], " ".join(f"w{k}" for k in range(60_000))]


# Fill in the middle


def filled(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    texts = [*odd_texts(), "a <P> b", "a<S>", "<M", "x<" * 9, "<S <P <M"]
    rows = [(k, t) for k, t in enumerate(texts * 3)] + [(None, "no id here"), (7, "an id again"), (7, "an id again")]
    found = infill.fill_in_middle(table(spark, rows), keep=("source",)).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key)
    assert got == sorted(((i, *filled(i, t)) for i, t in rows), key=key)
    assert sorted(r.back for r in found) == sorted(t or "" for _, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"} and {r.source for r in found} == {"a"}
    assert infill.fill_in_middle(table(spark, rows).limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab <PSM>\n\té語", max_size=60), st.integers(0, 2**32), st.integers(0, 2**32))
def test_cuts_are_those_of_the_units(text, a, b):
    units = UNIT.findall(text)
    first, last = sorted(h % (len(units) + 1) for h in (a, b))
    marked = any(m in text for m in infill.MARKS)
    assert infill.unit_cuts(text, (a, b), infill.scanner(infill.MARKS)) == (len(units), len("".join(units[:first])), len("".join(units[:last])), marked)


def test_other_marks_and_names(spark):
    docs = table(spark, [(k, "one two three four") for k in range(40)])
    marks = ("[pre]", "[suf]", "[mid]")
    found = infill.fill_in_middle(docs, marks=marks, rate=100, spm=50).withColumn("back", infill.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.back for r in found} == {"one two three four"} and {r.form for r in found} == {"psm", "spm"}
    for wrong in (("a", "a", "b"), ("", "b", "c"), ("xa", "ay", "c"), ("aba", "x", "y"), ("<<P>>", "<P>", "q")):
        with pytest.raises(ValueError):
            infill.check_marks(wrong)
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs.withColumn("n", F.lit(1)), keep=("n",))


# Filter audit


def fails_of(rows):
    """(part, fails, good, toxic) of rows (doc_id, text, part, good, toxic)."""
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, t, part, good, toxic in rows:
        t = t or ""
        words = [w for w in SPACE.split(t) if w]
        first = smallest.get(t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": first is not None and (i is None or first < i)}
        out.append((part or "", fails, good, toxic))
    return out


def audited(rows):
    of, out = fails_of(rows), {}
    for part in {r[0] for r in of}:
        mine = [r[1:] for r in of if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone, before = [r for r in left if r[0][f]], left
                left = [r for r in left if not r[0][f]]
                total[f] += len(gone)
                every = sum(r[0][f] for r in mine)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in mine)
                out[part, "".join(order), k + 1] = [len(left), len(gone), every - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone), f]
                assert len(before) == len(left) + len(gone)
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = total[out[key][-1]]
    return out


def test_filter_audit(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        n = rng.choice([0, 5, 99, 100, 150])
        words = [rng.choice(["a", "B", "c#"]) if rng.random() < rng.choice([0, 0.3]) else f"w{rng.randrange(10**6)}" for _ in range(n)]
        text = rng.choice([" ", "\n", " \t"]).join(words)
        rows.append((i, text.upper() if rng.random() < 0.2 else text, rng.choice(["en", "de", None, ""])))
    rows += [(200 + k, rows[k % 7][1], "en") for k in range(30)] + [(None, rows[3][1], "en"), (None, "only here", "fr"), (None, None, "fr"), (3, None, "fr"), (3, rows[3][1], "en"), (5, rows[5][1], rows[5][2])]
    said = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 230, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    good, toxic = ({i for i, *x in said if x[k] == 1 and i is not None} for k in (0, 1))
    docs = spark.createDataFrame([(i, t, p, "a", 0) for i, t, p in rows], SCHEMA)
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    out = audit.filter_audit(audit.judged(docs, labels))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): [*r[3:]] for r in out.collect()}
    assert got == audited([(i, t, p, i in good, i in toxic) for i, t, p in rows])
    assert audit.filter_audit(audit.judged(docs.limit(0), labels)).count() == 0
    assert audit.filter_audit(audit.judged(docs, labels.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def test_a_prefix_is_made_once(spark):
    """Any filters may be audited; each set of them is one stored table, in whatever order it is reached, and null verdicts pass."""
    rows = spark.createDataFrame([(1, True, False, None), (2, True, True, True), (3, False, False, False)], "id int, long boolean, short boolean, odd boolean")
    made = audit.survivors(rows, ("long", "short", "odd"))
    assert {k: sorted(r.id for r in v.collect()) for k, v in made.items()} == {"": [1, 2, 3], "long": [3], "short": [1, 3], "odd": [1, 3], "long,short": [3], "long,odd": [3], "short,odd": [1, 3], "long,short,odd": [3]}
    out = audit.filter_audit(rows.selectExpr("*", "'p' as part", "true as good", "false as toxic"), ("long", "short", "odd")).collect()
    assert len(out) == 18 and {r.filter_order for r in out} == {",".join(o) for o in permutations(("long", "short", "odd"))}
    with pytest.raises(ValueError):
        audit.filter_audit(rows, ("a", "a"))


# Fingerprints


def pieces(text):
    lines = [p for line in (text or "").split("\n") for p in (re.split(sketches.CUT, line) if len(line) > sketches.LINE else [line])]
    return {p for p in lines if p.strip(" \t\n\x0b\f\r")}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_edits(spark, rows):
    """rows in falling order."""
    found = sketches.edited_fingerprints(table(spark, random.Random(1).sample(rows, len(rows)))).collect()
    want = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((i, len(t), edited, round(alike(pieces(t), pieces(edited)), 9), round(alike(pieces(t), pieces(after)), 9)))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited, round(r.near_edited, 9), round(r.near_next, 9)) for r in found), key=key) == sorted(want, key=key)
    return found


def prose(rng, n):
    return "\n".join(" ".join(rng.choice(["and", "the", "here.", f"w{rng.randrange(10**4)}", "é語."]) for _ in range(rng.randrange(1, 120))) for _ in range(n))


def test_edited_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(sketches, "ROWS", 7)
    rng = random.Random(3)
    texts = [t for t in odd_texts() if t is None or len(t) < 10_000] + [prose(rng, rng.randrange(1, 60)) for _ in range(60)]
    texts += [texts[-1], texts[-1] + "\nmore", texts[-2], "\n".join(f"line {k}" for k in range(5000)), "\n".join(f"line {k}" for k in range(3, 5003))]
    rows = [(10 * len(texts) - 3 * k, t) for k, t in enumerate(texts)]
    found = check_edits(spark, rows)
    prints = {}
    for r in found:
        prints.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert max(r.near_next for r in found) == 1.0


def test_the_order_of_few_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(sketches, "ROWS", 3)
    check_edits(spark, [(5, "alone\nhere")])
    check_edits(spark, [(9, "a\nb\nc"), (2, None)])
    assert sketches.edited_fingerprints(table(spark, []).limit(0)).count() == 0
    # Equal ids follow each other in order of a hash; a third of the rows has one id, and a third none.
    texts = [f"text {k}\nand {k % 3}" for k in range(60)]
    ids = [40] * 20 + [None] * 20 + list(range(30, 50))
    docs = table(spark, list(zip(ids, texts, strict=True)))
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    check_edits(spark, rows)


def test_differences_are_recovered(spark, monkeypatch):
    """The digests that one side has alone, whatever the sizes, also when the first sketches are far too small."""
    monkeypatch.setattr(sketches, "CELLS", 3)
    rng = random.Random(4)
    cases = []
    for shared, left, right in [(0, 0, 0), (0, 1, 0), (0, 0, 2), (5, 1, 1), (400, 3, 2), (50, 300, 10), (0, 200, 200), (3000, 0, 1), (7, 0, 0)] * 3:
        keys = list(dict.fromkeys(rng.getrandbits(64) - 2**63 for _ in range(shared + left + right)))
        cases.append((keys[: shared + left], keys[left + shared :] + keys[:shared], sorted(keys[shared : shared + left]), sorted(keys[shared + left :])))
    rows = spark.createDataFrame([(a, b, x, y) for a, b, x, y in cases], "a array<bigint>, b array<bigint>, x array<bigint>, y array<bigint>").withColumn("d", sketches.difference("a", "b")).collect()
    assert all(sorted(r.d.plus) == r.x and sorted(r.d.minus) == r.y for r in rows)


def test_small_sketches_fail_and_larger_ones_do(spark):
    """A sketch of three cells cannot hold ten digests: something is left after peeling; one of 48 can."""
    rows = spark.sql("select transform(sequence(1, 10), x -> xxhash64(x)) as a, cast(array() as array<bigint>) as b")
    left = lambda size: rows.select(F.expr(f"size({sketches.peeled(sketches.less(sketches.sketch('a', size), sketches.sketch('b', size)), size)}.cells)")).first()[0]
    assert left("3L") > 0 and left("48L") == 0


def test_fingerprints_of_texts(spark):
    rows = [(1, "a\nb"), (2, "b\n\na\n"), (3, None), (4, ""), (None, " \n"), (5, "c"), (5, "c")]
    got = {(r.doc_id, r.n_paragraphs, r.fingerprint) for r in sketches.fingerprints(table(spark, rows), keep=("source",)).collect()}
    prints = {i: f for i, _, f in got}
    assert len(got) == 6 and prints[1] == prints[2] != prints[5] and prints[3] == prints[4] == prints[None] == "0:"
