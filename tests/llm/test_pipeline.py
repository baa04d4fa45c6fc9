"""The pipeline's stages against brute force, each on its own input, and the queries against their SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reuselens.llm import copies, exact, mixing, queries, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, wanted))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, name):
    table = "pages" if name.startswith("op10") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def firsts_of(docs):
    """The smallest id of each component of texts whose five-word shingle sets have a similarity of 0.8 or more, by all pairs."""
    sets = {i: set(copies.shingle_set((r.text or "").encode(), 5).tolist()) for i, r in docs.items()}
    root = {}
    for i in sorted(sets):
        near = {root[j] for j in root if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        root[i] = min(near | {i})
        for j in root:
            if root[j] in near:
                root[j] = root[i]
    return set(root.values())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        got = after.collect()
        if k < 4:
            assert after.columns == COLUMNS
        if k == 0:
            kept = {r.doc_id for r in quality.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
        if k == 1:
            kept = {r.doc_id for r in exact.exact_dedup(docs).where("kept").collect()}
        if k == 2:
            kept = firsts_of(before)
        if k < 3:
            assert sorted(r.doc_id for r in got) == sorted(kept)
            assert all(tuple(r) == tuple(before[r.doc_id]) for r in got)
        if k == 3:
            taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
            sizes = {}
            for r in got:
                sizes[r.doc_id] = sizes.get(r.doc_id, 0) + len(r.text.split())
                assert r.n_chars == len(r.text)
            assert sizes == {i: n for i, n in taken.items() if n}
        if k == 4:
            assert all(r.round_trip for r in got) and len(got) == docs.count()
        docs = after


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows and ids, no text, and columns whose names the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    clashing = ["mark", "of", "doc", "id", "take", "takes", "spans", "copy", "words", "n", "root", "kept", "taken", "rung", "stratum", "_text", "size", "__row"]
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long, "en", "a", 9, "x"), (1, long, "en", "a", 9, "x"), (None, None, None, None, None, None), (2, "", "en", "a", 0, "x"), (3, long + " y", None, "b", 9, None), (3, "other " * 60, "en", None, 9, "x")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema).select("*", *(F.lit(f"its {name}").alias(name) for name in clashing))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert k == 4 or out.columns == docs.columns
            n = out.count()
            assert k == 4 or out.where(" or ".join(f"{name} <> 'its {name}'" for name in clashing)).count() == 0
            if data:
                assert n == {0: 3, 1: 4, 2: 3, 4: 6}.get(k, n)
            else:
                assert n == 0


def test_taken_words_keep_their_lines(spark):
    lines = "\n".join(" ".join(f"w{k}{j}" for j in range(7)) for k in range(3000))
    docs = spark.createDataFrame([(k, lines, "en", s, len(lines)) for k, s in enumerate("aabbccdd")], "doc_id long, text string, lang string, source string, n_chars long")
    parts = [r.text for r in corpus_pipeline.mixed(spark, docs, SF).collect()]
    assert any(p != lines for p in parts) and all("\n" in p and p == p.strip() for p in parts)
    # Only where two parts meet inside a line is a line not one of the text's.
    found = [line for p in parts for line in p.split("\n")]
    whole = set(lines.split("\n"))
    assert sum(line in whole for line in found) > 0.9 * len(found)


def test_query_rows_are_those_of_the_libraries(spark):
    """The queries without SQL, over the whole smallest table, against brute force."""
    import hashlib
    import zlib

    import numpy as np
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from test_llm_operators import all_detections, base_of, licenses, print_of

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = lambda name: {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    got, prints = rows("op1_simhash_near_dedup"), {i: print_of(t, 4) for i, t in docs.items()}
    root = {}
    for i in sorted(docs):
        near = {root[j] for j in root if (prints[i] ^ prints[j]).bit_count() <= 4}
        root[i] = min(near | {i})
        root.update({j: root[i] for j in root if root[j] in near})
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in docs}

    for i, r in rows("op2_license_scan").items():
        base, found = base_of(docs[i]), all_detections(licenses.normalised(docs[i].encode()))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base
        assert r.labels == ",".join(sorted({x[2] for x in found} | set(base[4].split(",")) - {""}))

    tokenizer, at, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, rows("op5_token_files")
    for i in sorted(docs):
        ids = [*tokenizer.encode(docs[i], add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in rows("op9_sentencepiece").items():
        ids = model.encode(docs[i])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def test_run(spark, con):
    """The whole pipeline against SQL for the quality rules and the mix, and brute force for both kinds of copies and the pieces."""
    import re
    from collections import Counter

    import pandas as pd
    import public_tokenizers
    import sentencepiece

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    judged = con.execute(queries.ORACLES["op3_quality_rules"]).df()
    left = {i: docs[i] for i in judged.doc_id[judged.kept.astype(bool)].tolist()}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i].text), i)
    left = {i: docs[i] for i in firsts_of({i: docs[i] for i in first.values()})}
    other = duckdb.connect()
    other.register("survivors", pd.DataFrame([r.asDict() for r in left.values()]))
    other.execute("CREATE TABLE documents AS SELECT * FROM survivors")
    mixed = other.execute(f"SELECT doc_id, taken, target FROM ({queries.ORACLES['op8_source_mix']})").fetchall()
    taken, target = {i: n for i, n, _ in mixed if n}, {docs[i].source: t for i, _, t in mixed}

    model, sizes = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        text = model.decode(r.ids)
        assert r.round_trip and r.n_tokens == len(r.ids) and r.ids == model.encode(text)
        words = text.split()
        sizes[r.doc_id] += len(words)
        assert not Counter(words) - Counter(left[r.doc_id].text.split()) and (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source)
    # Of sources with equal targets the SQL may give the odd block to another.
    tied = {x for x in target if list(target.values()).count(target[x]) > 1}
    assert {i: n for i, n in sizes.items() if docs[i].source not in tied} == {i: n for i, n in taken.items() if docs[i].source not in tied}
    of = lambda rows: sum(n for i, n in rows.items() if docs[i].source in tied)
    assert len(tied) < len(target) and abs(of(sizes) - of(taken)) <= mixing.BLOCK
