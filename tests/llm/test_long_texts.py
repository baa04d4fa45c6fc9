"""Texts of some hundred KB, beside short ones, in the operators that read whole texts; and seats that a shard has no room for."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reuselens.llm import exact, mixing, quality, simhash, tokenfiles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(1)
    big = " ".join(rng.choice(["the", "and", f"w{rng.randrange(10**5)}", "Éa", "x\n"]) for _ in range(60_000))
    one = "z" * 300_000
    texts = [big, big.replace(" ", "  "), big[:-1] + "!", one, one + " ", one[:-1], "short", None, ""]
    assert len(big) > 200_000
    return [(k, t, "en", "ab"[k % 2], 0) for k, t in enumerate(texts)]


def print_of(text, n):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    pieces = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, long_docs):
    got = simhash.near_dedup(spark.createDataFrame(long_docs, SCHEMA), words=4).collect()
    assert {r.doc_id: r.fps[0] & (1 << 64) - 1 for r in got} == {r[0]: print_of(r[1], 4) for r in long_docs}
    of = {r.doc_id: r.component_id for r in got}
    assert of[0] == of[1] == of[2] and of[3] == of[4]


def test_quality(spark, long_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(long_docs, SCHEMA), labels).collect()}
    for i, t, *_ in long_docs:
        words = (t or "").split()
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(words), sum(map(len, words)), len(again), len(lines) - len(set(lines)))


def test_token_files(spark, long_docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenfiles.write_token_files(spark.createDataFrame(long_docs, SCHEMA), str(tmp_path / "tokens"), path, end_id=2)
    got = {r.doc_id: (r.start, r.n_tokens, r.crc) for r in tokenfiles.read_token_files(spark, str(tmp_path / "tokens"), crc=F.crc32("ids")).collect()}
    tokenizer, start, want = Tokenizer.from_file(path), 0, {}
    for i, t, *_ in long_docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_exact(spark, long_docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact.exact_dedup(spark.createDataFrame(long_docs, SCHEMA), digests=True).collect()}
    import re

    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in long_docs}
    assert got == {i: (min(j for j in norm if norm[j] == t), sum(x == t for x in norm.values()), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_mix(spark, long_docs):
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(long_docs, SCHEMA)).collect()}
    assert {i: r.size for i, r in got.items()} == {i: len((t or "").split()) for i, t, *_ in long_docs}
    for source in "ab":
        some = [r for r in got.values() if r.source == source]
        assert abs(sum(r.taken for r in some) - some[0].target) <= mixing.BLOCK and all(r.taken <= 2 * r.size for r in some)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(long_docs, SCHEMA).withColumn("size", F.lit(1)), keep=("size",))


def test_seats_without_room_go_to_others(spark):
    rng, rows = random.Random(2), []
    for g in range(12):
        for k in range(rng.randrange(1, 9)):
            rows.append((g, k, float(rng.randrange(0, 50)), rng.randrange(0, 12), rng.randrange(0, 9)))
    house = {g: sum(r[3] for r in rows if r[0] == g) for g in range(12)}
    members = spark.createDataFrame([(*r, house[r[0]]) for r in rows], "g int, k int, votes double, seats long, room long, house long")
    got = {(r.g, r.k): r.seats for r in mixing.within_room(members, "g", "house", "room", ("g", "k")).collect()}
    for g in range(12):
        mine = {r[1]: [r[2], min(r[3], r[4]), r[4]] for r in rows if r[0] == g}
        for _ in range(house[g] - sum(m[1] for m in mine.values())):
            free = [k for k, (v, s, room) in mine.items() if s < room and v > 0]
            if not free:
                break
            mine[min(free, key=lambda k: (-mine[k][0] / (2 * mine[k][1] + 1), k))][1] += 1
        assert {k: m[1] for k, m in mine.items()} == {k: got[g, k] for k in mine}
