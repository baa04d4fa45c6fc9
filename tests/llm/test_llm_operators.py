"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from reuselens.llm import components, exact, licenses, mixing, passages, pieces, quality, seeds, simhash, suffixes, tokenfiles, warc

SCHEMA = "doc_id long, text string, lang string, source string, _norm string, h long, row long, place long, _text string, _words string, mask long, fp long, size long, kept boolean"
WS = re.compile(r"[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t ", "x", "word " * 3000, "é" * 10, "tab\there  two\n\nlines", "\x00 nul", "日本 語"]


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, ["en", "fr", None][k % 3], [None, "a", "b", "c"][k % 4], "clash", 1, 2, 3, "clash", "clash", 4, 5, 6, True) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)


def words(text):
    return [w for w in WS.split(text or "") if w]


def corpus(seed, n=60, length=120, vocabulary=300):
    """Random texts, with copies, near copies, shared passages and repeats in one text."""
    rng = random.Random(seed)
    some = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    shared, texts = [some(70) for _ in range(3)], []
    for k in range(n):
        kind, own = k % 6, some(rng.randrange(1, length))
        if kind == 1 and texts:
            own = rng.choice(texts).split()
        elif kind == 2 and texts:
            own = rng.choice(texts).split()
            own[rng.randrange(len(own))] = "edited"
        elif kind == 3:
            own[len(own) // 2 : len(own) // 2] = rng.choice(shared)[rng.randrange(15) :]
        elif kind == 4:
            own = own[:20] * 6
        elif kind == 5:
            own = ["again"] * rng.randrange(1, 200)
        texts.append(" ".join(own))
    return texts


def rows(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# 1


def print_of(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, odd):
    texts = ODD + ["A B c D e", "A B C", "AÉ bé " * 9]
    got = rows(simhash.fingerprints(table(spark, texts), words=4), "fps")
    assert {k: v[0][0] & (1 << 64) - 1 for k, v in got.items()} == {k: print_of(t, 4) for k, t in enumerate(texts)}


@pytest.mark.parametrize("bucket", [4096, 4])
def test_hamming_links(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:30]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                v ^= 1 << b
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.hamming_links(spark.createDataFrame([(0, v) for v in signed], "p int, fp long"), 4).collect()
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def classes(pairs):
        parent.update({v: v for v in signed})
        for a, b in pairs:
            parent[find(a)] = find(b)
        groups = collections.defaultdict(set)
        for v in signed:
            groups[find(v)].add(v)
        return sorted(map(sorted, groups.values()))

    assert classes([(r.a, r.b) for r in links]) == classes([(a, b) for a in signed for b in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])


def test_masks_cover_the_radius():
    masks = simhash.covering_masks(4, tuple(range(64)), 7)
    assert len(masks) == 31
    rng = random.Random(0)
    assert all(any(sum(1 << b for b in rng_bits) & m == 0 for m in masks) for rng_bits in (rng.sample(range(64), 4) for _ in range(3000)))


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("prints, radius", [(1, 4), (3, 2)])
def test_near_dedup(spark, prints, radius):
    texts = ODD + ["a b c d e f g h i j k l", "a b c d e f g h i j k l"] + corpus(1, 30)
    df = table(spark, texts)
    fps = rows(simhash.fingerprints(df, words=4, prints=prints), "fps")
    ids = sorted(fps)
    near = {i: {j for j in ids if any(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in zip(fps[i][0], fps[j][0], strict=True))} for i in ids}
    want = {}
    for i in ids:
        if i not in want:
            todo, seen = [i], {i}
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            want |= dict.fromkeys(seen, i)
    assert {k: v[0] for k, v in rows(simhash.near_dedup(df, words=4, radius=radius, prints=prints), "component_id").items()} == want


def test_near_dedup_of_null_ids_and_nothing(spark, empty):
    got = simhash.near_dedup(table(spark, ["a b", "a b", "", None], [None, 5, None, None]), words=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(5, 5)] and len(got) == 4
    assert simhash.near_dedup(empty).count() == 0


# 2


def base_of(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places}))


LICENSED = ["Under the MIT License.", "cc BY cc by 4.0", "GNU General Public License, GNU general-public LICENSE", "Licensed under the Apache License, Version 2.0 (the MIT license)", "SPDX-License-Identifier: GPL-2.0-only", "xMIT License", "CC BY-NC-SA 4.0", "https://opensource.org/licenses/MIT"]


def test_license_base(spark, empty):
    texts = ODD + LICENSED
    got = rows(licenses.license_scan(table(spark, texts)), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {k: base_of(t) for k, t in enumerate(texts)}
    assert licenses.license_scan(empty).count() == 0
    assert licenses.license_scan(table(spark, ["a"], [None])).first().doc_id is None


def test_license_rules():
    found = lambda t: {(d.label, d.kind) for d in licenses.detections(licenses.normalised(t.encode()), licenses.gates(), {})}
    assert len(licenses.rules()) > 250
    assert found("SPDX-License-Identifier: GPL-2.0-only") == {("gpl", "tag")}
    assert found("licensed under the GNU Lesser General Public License, version 2.1") == {("lgpl", "grant")}  # the names inside are suppressed
    assert found("CC BY-NC-SA 4.0") == {("cc-by-nc-sa", "version")}
    assert found("see https://opensource.org/licenses/MIT") == {("mit", "address")}
    assert found("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files") == {("mit", "text")}
    assert found("License: BSD-3-Clause") == {("bsd", "field")}
    assert found("subject to the terms and conditions of the Apache License") == {("apache", "terms")}
    assert found("© ACME. All rights reserved.") == {("proprietary", "name")}
    assert found("commit limits") == found("transmit license") == found("") == set()


def sample_of(pattern):
    """A text that a rule's pattern matches: the first choice of each group, optional parts left out, one of each class."""
    p = pattern.decode().removeprefix("(?<= )(?:").removesuffix(")(?= )")
    p = re.sub(r"\[(.)[^\]]*\]\{1,\d+\}", r"\1", p)
    p = re.sub(r"\[(.)[^\]]*\]", r"\1", p)
    while (q := re.sub(r"\(\?:([^()]*)\)(\?|\*|\{0,\d\})?", lambda m: "" if m[2] else m[1].split("|")[0], p)) != p:
        p = q
    return re.sub(r".\?", "", p)


def test_every_rule_finds_its_own_text():
    """Each rule's keyword lets a text through that its pattern matches, and the label is found."""
    for rule in licenses.rules():
        line = licenses.normalised(sample_of(rule.pattern).encode())
        assert re.search(rule.pattern, line) and rule.keyword and rule.keyword in line, rule
        assert rule.label in {d.label for d in licenses.detections(line, licenses.gates(), {})}, rule


def all_detections(line):
    """Without gates, with the suppression as it is told."""
    found = []
    for rule in licenses.rules():
        for m in re.finditer(rule.pattern, line):
            found.append((-rule.priority, m.start() - m.end(), rule.order, line[: m.start()].count(b" ") - 1, line[: m.end()].count(b" "), rule))
    taken = []
    for *_, a, z, rule in sorted(found, key=lambda x: x[:4]):
        if not any(b <= a and z <= y for b, y, _ in taken):
            taken.append((a, z, rule))
    return sorted((a, z, rule.label, rule.kind, rule.confidence) for a, z, rule in taken)


def license_texts(n, seed):
    rng, pool = random.Random(seed), [sample_of(rule.pattern) for rule in licenses.rules()]
    return [" ".join(rng.choice([rng.choice(pool), rng.choice(pool)[: rng.randrange(40)], "some words", rng.choice(LICENSED), "version 2.0", "or"]) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_license_labels_score_and_suppression(spark):
    texts = ODD + LICENSED + license_texts(300, 3)
    got = rows(licenses.license_scan(table(spark, texts)), "detections", "labels", "score", "base_labels")
    for k, text in enumerate(texts):
        found, base = all_detections(licenses.normalised((text or "").encode())), base_of(text)[4]
        detected, labels, score, base_labels = got[k]
        assert sorted((d.start, d.stop, d.label, d.kind, d.confidence) for d in detected) == found
        assert labels == ",".join(sorted({x[2] for x in found} | set(base.split(",")) - {""})) and base_labels == base
        assert score == pytest.approx(1 - np.prod([1 - x[4] for x in found] or [0.5 if base else 1.0]))


def test_maximal_intervals():
    rng = random.Random(4)
    for _ in range(200):
        some = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(20) for _ in range(rng.randrange(30)))]
        taken, want = [], []
        for a, z in some:
            want.append(not any(b <= a and z <= y for b, y in taken))
            if want[-1]:
                taken.append((a, z))
        assert licenses.maximal(some) == want


def test_a_long_text_takes_linear_time():
    import time

    line = licenses.normalised(b"Licensed under the MIT License. SPDX-License-Identifier: Apache-2.0 some other words. " * 120_000)
    began = time.process_time()
    found = licenses.detections(line, licenses.gates(), {})
    assert len(found) == 240_000 and len(licenses.base_places(line)) == 120_000
    assert time.process_time() - began < 60


def test_license_scores(spark):
    got = rows(licenses.license_scan(table(spark, LICENSED)), "score", "labels", "base_labels")
    assert all(0 <= s <= 1 for s, _, _ in got.values())
    assert all(set(b.split(",")) - {""} <= set(x.split(",")) for _, x, b in got.values())
    assert got[6][1] == "cc-by,cc-by-nc-sa"


# 3


def measures_of(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = collections.Counter(windows)
    again = {k + i for k, x in enumerate(windows) if count[x] > 1 for i in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_measures(spark, empty):
    texts = ODD + ["a b c a b c", "a a a a", "l\nl\n l\nl", "#*$ %&|<> x", "a b a b a b c"] + corpus(2, 30, 60, 5)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0)], "doc_id long, quality int")
    got = rows(quality.quality_rules(table(spark, texts), labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {k: measures_of(t) for k, t in enumerate(texts)}
    out = quality.quality_rules(table(spark, texts), labels.limit(0))
    assert out.where("kept = base_failed").count() == 0
    assert out.where("base_failed <> (n_words < 50 or 100 * n_repeat_words > 50 * n_words)").count() == 0
    assert quality.quality_rules(empty, labels).count() == 0


@pytest.mark.parametrize("terms", [4096, 7])
def test_binomial_tails(spark, terms, monkeypatch):
    from math import comb

    monkeypatch.setattr(quality, "TERMS", terms)
    for p in (0.02, 0.1, 0.3):
        cases = [(x, n) for n in (0, 10, 60, 400, 3000) for x in (0, 1, 3, 20, 40, 100) if x <= n]
        got = quality.binomial_tails(spark.createDataFrame(cases, "x long, n long"), ("x", "n"), p).collect()
        assert len(got) == len(cases)
        for r in got:
            exact_p = sum(comb(r.n, j) * p**j * (1 - p) ** (r.n - j) for j in range(r.x + 1))
            assert r.p == pytest.approx(exact_p if r.x < r.n * p else 1.0, rel=1e-8)


def certified_of(rungs, total, risk=quality.RISK, delta=quality.DELTA):
    """The rungs that are certified for a stratum whose good documents fall on these rungs."""
    from math import comb

    n, k = len(rungs), 0
    while k < quality.RUNGS:
        x = sum(r <= k + 1 for r in rungs)
        if x >= n * risk or sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(x + 1)) > delta * n / total:
            break
        k += 1
    return k


def test_rungs_are_certified_by_stratum(spark):
    """Strata with clean good documents, with some good ones that rungs reject, with few labels, without any, and null: each has what its own labels certify."""
    rng, rows_, k = random.Random(6), [], 0
    words_ = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]

    def add(lang, marks, good):
        nonlocal k
        rows_.append((k, " ".join(w + "#" * (i < marks) for i, w in enumerate(words_())), lang, good))
        k += 1

    for _ in range(900):
        add("clean", 0, 1)
    for j in range(700):
        add("some", 20 if j < 20 else 0, 1)  # 33 symbols per 100 words: rung 8 rejects 20 of 700
    for _ in range(30):
        add("few", 0, 1)
    for _ in range(400):
        add(None, 0, 1)
    for lang in ("clean", "some", "few", "none", None):
        for marks in (0, 9, 20, 55):
            add(lang, marks, None)
    docs = spark.createDataFrame([r[:3] for r in rows_], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows_ if r[3]], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    total = len(rows_) - 20
    want = {lang: certified_of([got[r[0]].rung for r in rows_ if r[2] == lang and r[3]], total) if lang != "none" else 0 for lang in ("clean", "some", "few", "none", None)}
    assert want == {"clean": 11, "some": 7, "few": 0, "none": 0, None: 11}
    assert all(r.kept == (r.rung > want[lang]) for i, _, lang, _ in rows_ for r in (got[i],))
    assert [got[r[0]].kept for r in rows_[-20:]] == [True, False, False, False, True, True, True, False, *[True] * 8, True, False, False, False]


def test_few_labels_are_enough(spark):
    """With one stratum 149 good labels certify: 0.98 ** 149 is below 0.05; 148 do not."""
    text = " ".join(f"w{k}" for k in range(60))
    for n, kept in ((149, False), (148, True)):
        docs = spark.createDataFrame([(k, text, "en") for k in range(n)] + [(n, " ".join(w + "#" for w in text.split()), "en")], "doc_id long, text string, lang string")
        got = quality.quality_rules(docs, docs.where(f"doc_id < {n}").select("doc_id", F.lit(1).alias("quality")), keep=("lang",))
        assert [r.kept for r in got.where(f"doc_id = {n}").collect()] == [kept]


# 4 and 6


def passages_of(texts, window):
    seen = {}
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            seen[x] = min(i, seen.get(x, i))
    out = {}
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def substrings_of(texts, window):
    seen, out = set(), {}
    for i, t in sorted(texts):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - window + 1):
            x = data[k : k + window]
            if x in seen:
                gone[k : k + window] = True
            seen.add(x)
        edges = np.diff(np.concatenate(([False], gone)).astype(np.int8))
        out[i] = (len(data), int(gone.sum()), int((edges == 1).sum()), np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes())
    return out


@pytest.mark.parametrize("segment", [1 << 18, 64])
def test_passages(spark, segment, monkeypatch):
    monkeypatch.setattr(seeds, "SEGMENT", segment)
    monkeypatch.setattr(passages, "SEGMENT", segment)
    texts = ODD + corpus(4, 90, 200)
    got = rows(passages.repeated_passages(table(spark, texts)), "n_words", "n_removed", "kept")
    assert got == passages_of(list(enumerate(texts)), 50)


@pytest.mark.parametrize("segment", [1 << 18, 256])
def test_substrings(spark, segment, monkeypatch):
    monkeypatch.setattr(seeds, "SEGMENT", segment)
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    texts = ODD + corpus(5, 90, 200) + ["ab" * 300, "abc" * 100]
    got = rows(suffixes.repeated_substrings(table(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept")
    assert {k: (*v[:3], bytes(v[3])) for k, v in got.items()} == substrings_of(list(enumerate(texts)), 100)


@pytest.mark.parametrize("operator, unit", [(passages.repeated_passages, "n_words"), (suffixes.repeated_substrings, "n_bytes")])
def test_repeats_edge_cases(spark, empty, operator, unit):
    assert operator(empty).count() == 0
    long = " ".join(f"word{k}" for k in range(80))
    got = operator(table(spark, [long, long, long, "other"], [None, 7, 7, 7])).collect()
    assert len(got) == 4
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.n_removed)
    assert by[None] == [0]  # a null id comes first
    assert sorted(by[7])[0] == 0 and sorted(by[7])[1:] == [max(r[unit] for r in got)] * 2


def test_spans_match_what_is_removed(spark):
    texts = corpus(6, 40, 200)
    for r in passages.repeated_passages(table(spark, texts)).collect():
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_bucket_refinement_tells_suffixes_apart():
    data = np.random.default_rng(1).integers(97, 99, 4000).astype(np.uint8)
    b = suffixes.Buckets(0, 32, 100)
    ids = b.full(b.initial(data), np.arange(len(data) - 99))
    strings = [data[k : k + 100].tobytes() for k in range(len(data) - 99)]
    assert len(set(ids.tolist())) == len(set(strings))


# 5


@pytest.mark.parametrize("ids", [[], [5], [50256] * 7, list(range(10000)), [70000, 1], [0] * 4096, [2**32 - 1, 0]])
def test_planes_round_trip(ids):
    assert tokenfiles.unpack_ids(tokenfiles.pack_ids(np.array(ids, np.uint32))).tolist() == ids
    if ids:
        with pytest.raises(Exception):
            tokenfiles.unpack_ids(tokenfiles.pack_ids(np.array(ids, np.uint32))[:-1])


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "▁", "\n", "\n\n", "\t", "é", "日本", "\x00", "the ", "ing", ".", "　", "\r", "😀", "é", "<|endoftext|>", "'s", "1", "\xa0", "!!", "Word", ", "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1 << 17, 40])
def test_token_files(spark, empty, tmp_path, chunk, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfiles, "CHUNK", chunk)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ODD + random_texts(1500, 1)
    tokenizer, at, want = Tokenizer.from_file(path), 0, {}
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[k], at = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), at + len(ids)
    tokenfiles.write_token_files(table(spark, texts), str(tmp_path / "t"), path, 2, shards=3)
    assert rows(tokenfiles.read_token_files(spark, str(tmp_path / "t"), crc=F.crc32("ids")), "start", "n_tokens", "crc") == want
    tokenfiles.write_token_files(table(spark, ["a", "b", "c"], [None, 3, 3]), str(tmp_path / "n"), path, 2)
    assert [r.start for r in tokenfiles.read_token_files(spark, str(tmp_path / "n")).orderBy("start").collect()] == [0, 2, 4]
    tokenfiles.write_token_files(empty, str(tmp_path / "e"), path, 2)
    assert tokenfiles.read_token_files(spark, str(tmp_path / "e")).count() == 0


# 7


def test_exact_dedup(spark, empty):
    texts = ODD + ["a  b", "a b", "a\nb", " a b", "a b ", "x" * 2000 + "1", "x" * 2000 + "2", "x" * 2000 + "1"]
    groups = collections.defaultdict(list)
    for k, t in enumerate(texts):
        groups[WS.sub(" ", t or "")].append(k)
    want = {k: (g[0], len(g), k == g[0], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g}
    assert rows(exact.exact_dedup(table(spark, texts), digests=True), "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact.exact_dedup(empty).count() == 0
    got = exact.exact_dedup(table(spark, ["q", "q", "q", "r"], [None, 4, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 1, True), (-1, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True)]


def test_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact, "SLOTS", 64)
    got = exact.exact_dedup(table(spark, [f"t{k % 150}" for k in range(300)])).collect()
    assert {r.group_size for r in got} == {2} and sum(r.kept for r in got) == 150


# 8


def targets_of(sizes, share=1.5):
    """By rounds, as the rule is told: share by weight, stop at twice the size, share the excess anew."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not above:
            return {s: capped.get(s, level * weight[s]) for s in names}
        for s in above:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]


def test_mix(spark, empty):
    rng = random.Random(2)
    texts = ODD + [" ".join(["w"] * rng.randrange(0, 900)) for _ in range(400)]
    df = table(spark, texts)
    got = mixing.mix(df, shard_rows=20).collect()
    sizes = collections.Counter()
    for r in got:
        assert r["size"] == len(words(texts[r.doc_id]))
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum((s.stop - s.start) * s.times for s in r.spans)
        sizes[r.source] += r["size"]
    want, taken = targets_of(dict(sizes)), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) < 600 for s, t in want.items())
    again = rows(mixing.mix(df.repartition(7), shard_rows=20), "taken")
    assert again == {r.doc_id: (r.taken,) for r in got}
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(table(spark, ["a b", "a b", None], [None, 1, 1])).count() == 3


def test_small_sources_come_near_their_targets(spark):
    docs = [(k, " ".join(["w"] * 200), "big") for k in range(100)] + [(1000 + k, " ".join(["w"] * k), f"site {k}") for k in (0, 1, 3, 40, 100, 700)] + [(2000, "a b", None)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    want, taken = {r.source: r.target for r in got}, collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r["size"]
    assert sum(t > 0 for t in want.values()) == 7
    assert all(abs(taken[s] - t) <= max(1, t / 10) for s, t in want.items())


def test_sainte_lague(spark):
    rng = random.Random(5)
    for house, unit in ((37, 11.0), (100, 7.0), (5, 100.0), (0, 3.0)):
        votes = [(k, float(rng.randrange(0, 90))) for k in range(12)]
        df = spark.createDataFrame(votes, "k int, votes double").withColumn("g", F.lit(0)).withColumn("house", F.lit(house))
        got = {r.k: r.seats for r in mixing.sainte_lague(df.withColumn("votes", F.col("votes") * house * unit / max(1, sum(v for _, v in votes))), "g", "house", unit, ("k",)).collect()}
        seats = dict.fromkeys(got, 0)
        for _ in range(house):
            seats[min(seats, key=lambda k: (-dict(votes)[k] / (2 * seats[k] + 1), k))] += 1
        assert got == seats


# 9


def test_pieces(spark, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + random_texts(2000, 7) + ["word " * 100_000]
    want = {k: (model.encode(t or ""), model.decode(model.encode(t or ""))) for k, t in enumerate(texts)}
    assert rows(pieces.encode_decode(table(spark, texts), path), "ids", "decoded") == want
    assert pieces.encode_decode(empty, path).count() == 0
    got = pieces.encode_decode(table(spark, ["a", None], [None, None]), path, keep=("_text", "h")).collect()
    assert sorted((len(r.ids), r._text, r.h) for r in got) == [(0, "clash", 1), (1, "clash", 1)]


# 10


def test_archives(spark, tmp_path):
    bodies = ["<p>a</p>", "<p>a</p>", None, "", "é" * 70_000, "x\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "y" * 40_000, "y" * 40_000]
    pages = spark.createDataFrame([(k + 10, f"http://h/{k}" if k % 2 else None, t, 1) for k, t in enumerate(bodies)], "page_id long, url string, html string, value int")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "w")).where("record_type <> 'warcinfo'").withColumn("payload_bytes", F.octet_length("payload").cast("long"))).collect()}
    first = {}
    for k, t in enumerate(bodies):
        data, r = (t or "").encode(), got[k + 10]
        keep = first.setdefault(data, k + 10)
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.digest32(data))
        assert (r.record_type, r.refers_to) == (("response", None) if keep == k + 10 else ("revisit", keep))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
        assert r.url == (f"http://h/{k}" if k % 2 else None)


def test_archives_of_small_pages_nulls_and_nothing(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "long enough"), (4, "u", "long enough"), (None, "u", "long enough"), (1, "u", "aa")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), least=5)
    got = sorted((r.page_id or 0, r.record_type) for r in warc.read_archives(spark, str(tmp_path / "w")).where("record_type <> 'warcinfo'").collect())
    assert got == [(0, "revisit"), (1, "response"), (1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_repeated_long_pages(spark, tmp_path):
    """Rows that repeat a page_id with long texts: equal ones, other texts, other addresses, other columns that clash."""
    long, other = "x" * 100_000, "y" * 80_000
    data = [(1, "u", long), (1, "u", long), (1, "u", other), (1, "v", long), (2, "u", long), (None, None, long), (None, None, other), (3, "u", ""), (3, "u", None)]
    pages = spark.createDataFrame([(*row, "clash", 7) for row in data], "page_id long, url string, html string, origin string, _keep int")
    warc.write_archives(pages, str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w")).where("record_type <> 'warcinfo'").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    got = sorted((r.page_id or 0, r.url or "", r.record_type, r.payload_bytes, r.payload_digest) for r in warc.resolved(found).collect())
    digest = lambda t: warc.digest32(t.encode())
    want = [(1, "u", "response", 100_000, digest(long)), (1, "u", "response", 100_000, digest(long)), (1, "u", "response", 80_000, digest(other)), (1, "v", "response", 100_000, digest(long)), (2, "u", "revisit", 100_000, digest(long))]
    want += [(0, "", "revisit", 100_000, digest(long)), (0, "", "revisit", 80_000, digest(other)), (3, "u", "response", 0, digest("")), (3, "u", "response", 0, digest(""))]
    assert got == sorted(want)


def test_files_begin_with_a_warcinfo_and_have_a_member_a_record(spark, tmp_path):
    import glob
    import gzip

    pages = spark.createDataFrame([(k, "u", "t" * k * 9000) for k in range(20)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    kinds = collections.Counter()
    for path in glob.glob(str(tmp_path / "w" / "part-*")):
        data = open(path, "rb").read()
        parts = [x for x in warc.members(data) if x]
        assert b"".join(parts) == gzip.decompress(data)
        found = [h["warc-type"] for x in parts for h, _ in warc.parse_records(x)]
        assert len(found) == len(parts) and found[0] == "warcinfo"
        kinds.update(found)
    assert kinds["response"] == 20 and kinds["continuation"] > 20


def test_foreign_archives(spark, tmp_path):
    """Ids of other writers, other kinds of records, and files that are not compressed."""
    http = b"HTTP/1.1 200 OK\r\n\r\nhello"
    records = [warc._record("warcinfo", "<urn:uuid:1>", b"x"), warc._record("request", "<urn:uuid:2>", b"GET / HTTP/1.1\r\n\r\n", WARC_Target_URI="u"), warc._record("response", "<urn:uuid:3>", http, WARC_Target_URI="u")]
    records += [warc._record("response", "<urn:uuid:4>", http[:10], WARC_Target_URI="v", WARC_Segment_Number="1"), warc._record("continuation", "<urn:uuid:5>", http[10:], WARC_Target_URI="v", WARC_Segment_Origin_ID="<urn:uuid:4>", WARC_Segment_Number="2", WARC_Segment_Total_Length=str(len(http)))]
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
    got = {r.record_id: (r.page_id, r.record_type, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got["<urn:uuid:3>"] == got["<urn:uuid:4>"] == (None, "response", b"hello") and len(got) == 4


def test_broken_archives():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.dechunked(warc.chunked(b"a" * 20_000)) == b"a" * 20_000
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"", b"z\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    with pytest.raises(ValueError):
        warc._assembled("o", {"warc-payload-digest": "sha1:wrong"}, block + warc.chunked(b"x"))
    with pytest.raises(ValueError):
        list(warc.parse_records(warc.page_records(1, "u", b"x", None, False)[0] + b"junk"))


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_that_go_over_batches(spark, small_batches, monkeypatch, tmp_path):
    """What an operator keeps from batch to batch: groups here are larger than a batch."""
    texts = corpus(8, 120, 150)
    got = rows(passages.repeated_passages(table(spark, texts)), "n_words", "n_removed", "kept")
    assert got == passages_of(list(enumerate(texts)), 50)
    got = rows(suffixes.repeated_substrings(table(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept")
    assert {k: (*v[:3], bytes(v[3])) for k, v in got.items()} == substrings_of(list(enumerate(texts)), 100)
    for bucket in (4096, 3):
        test_hamming_links(spark, bucket, monkeypatch)
    monkeypatch.undo()
    test_archives(spark, tmp_path)


def test_rows_that_repeat_a_labelled_document_are_one_trial(spark):
    """300 rows of one labelled id certify nothing, so a document with many symbols stays."""
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "en")] * 300 + [(2, " ".join(w + "#" for w in text.split()), "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.kept for r in quality.quality_rules(docs, labels).where("doc_id = 2").collect()] == [True]
