"""Planted copies, round trips and edge cases of the operators."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from reuselens import model
from reuselens.functions import scalars
from reuselens.operators import batches, catalogue, codec, dedup, dictionary, incremental, rules, search, store, tokens
from reuselens.sources import files, ini
from reuselens.streaming import feed


def arrays(spark, rows):
    return spark.createDataFrame(rows, "file_id bigint, syms array<bigint>")


def ranges(df):
    return sorted(tuple(r) for r in df.collect())


def test_planted_copy(spark):
    a, b = list(range(1000, 1200)), list(range(5000, 5200))
    c = [*range(9000, 9060), *a[50:130], *range(9100, 9160)]
    found = search.search(arrays(spark, [(1, a), (2, b)]), arrays(spark, [(3, c)]), 64, strict=True)
    assert ranges(found) == [(1, 3, 50, 129, 60, 139)]


@pytest.mark.parametrize("overlap, n", [(16, 1), (15, 0)])
def test_overlap_at_the_window(spark, overlap, n):
    a = list(range(100))
    found = search.search(arrays(spark, [(1, a)]), arrays(spark, [(2, [*a[:overlap], *range(500, 540)])]), 16)
    assert found.count() == n


def test_short_files_and_two_diagonals(spark):
    block = list(range(20))
    base = arrays(spark, [(1, [*block, 99, *block]), (2, [1, 2])])
    assert ranges(search.search(base, arrays(spark, [(3, block), (4, [])]), 16)) == [(1, 3, 0, 19, 0, 19), (1, 3, 21, 40, 0, 19)]
    assert search.windows(arrays(spark, [(1, [1, 2]), (2, [])]), 3).count() == 0


def test_order_is_verified(spark):
    base, wanted = arrays(spark, [(1, [1, 2, 3, 4])]), arrays(spark, [(2, [4, 3, 2, 1])])
    found = search.candidates(base, wanted, 4)
    assert found.count() == 1
    assert search.verified(found, base, wanted, 4).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 13, 64])
def test_sliding_sum(spark, width):
    values = [(k * 7919) % 101 for k in range(70)]
    row = scalars.sliding_sum(arrays(spark, [(1, values)]), F.col("syms"), width, "s").first()
    assert row.s == [sum(values[i : i + width]) for i in range(len(values) - width + 1)]


def test_self_search_compares_classes(spark):
    a = list(range(100))
    rows = arrays(spark, [(1, a), (2, a), (3, a), (4, [*a[:80], 999])])
    assert ranges(search.self_search(rows, 64)) == [(1, 4, 0, 79, 0, 79)]
    assert ranges(search.classes(rows)) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_window_guard():
    with pytest.raises(ValueError):
        search.check_window(0)
    with pytest.raises(ValueError):
        search.check_window(100, strict=True)
    assert search.check_window(128, strict=True) == 128


def test_cpp_tokens():
    kinds = lambda s: [(k, line) for line, _, k, _ in tokens.cpp_tokens(s)]
    assert kinds("int a=1; // x\nint /* y\n*/ b = 2;") == [("int", 1), ("identifier", 1), ("=", 1), ("number", 1), (";", 1), ("int", 2), ("identifier", 3), ("=", 3), ("number", 3), (";", 3)]
    assert [k for k, _ in kinds('f("a//b", \'c\', R"x(")")x")')] == ["identifier", "(", "string", ",", "string", ",", "string", ")"]
    assert tokens.cpp_tokens("") == []


def test_token_lines(spark):
    df = spark.createDataFrame([(1, "a b\n\nC"), (2, None), (3, "")], "id long, text string")
    assert ranges(tokens.token_stream(df, "id").select("file_id", "pos", "name", "line")) == [(1, 0, "a", 1), (1, 1, "b", 1), (1, 2, "c", 3)]


def test_ini_semantics(spark):
    text = "k = 1 ; kept\nk2=\n; c=d\n# [x]\n[b]\nk = a\nk = b\n[ c ]\nx[=y\nz=[q]\n"
    items = ini.ini_items(spark.createDataFrame([("p/f.ini", text)], "path string, content string"))
    assert ranges(items.select("block", "key", "value")) == [("", "k", "1 ; kept"), ("", "k2", ""), ("=y", "z", "[q]"), ("b", "k", "b")]
    assert ini.ini_value(items, "", "k2", "d").first().value == ""
    assert ini.ini_value(items, "b", "none", "d").first().value == "d"


def test_third_party_blocks(spark):
    items = ini.ini_items(spark.createDataFrame([("a/b/f.ini", "[x]\ntype=3rdParty\nvendor=v\nurl=http://u=1\n[y]\ntype=Ignore\n")], "path string, content string"))
    row = ini.third_party(items).first()
    assert (row.dir, row.vendor, row.url, row.version) == ("a/b", "v", "http://u=1", "")
    assert ini.file_types(items).first().type == "Ignore"


def test_folder_rules_meet_whole_names(spark):
    paths = spark.createDataFrame([("lib/a/x.c",), ("lib/ab/x.c",), ("lib/a/b/x.c",), ("x.c",)], "path string")
    kept = rules.drop_ignored(paths, spark.createDataFrame([("lib/a",)], "dir string"))
    assert ranges(kept) == [("lib/ab/x.c",), ("x.c",)]


def test_dictionary_ids_are_stable(spark):
    first = dictionary.fresh_ids(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string"), "v")
    assert ranges(first) == [(1, "a"), (2, "b")]
    again = dictionary.insert_or_ignore(first, spark.createDataFrame([("c",), ("a",), ("0",)], "v string"), "v")
    assert ranges(again) == [(1, "a"), (2, "b"), (3, "0"), (4, "c")]
    rows = spark.createDataFrame([(1, "a"), (2, "q")], "k int, v string")
    coded = dictionary.encode(rows, again, "v", "v_id")
    assert ranges(coded) == [(1, 1), (2, 0)]
    assert ranges(dictionary.decode(coded, again, "v", "v_id")) == [(1, "a"), (2, "")]


def test_rebuild(spark):
    df = spark.createDataFrame([(1, "a\nb\n\na"), (2, ""), (3, "x")], "id long, text string")
    assert ranges(dedup.rebuild(*dedup.reduce_lines(df, "id"))) == [(1, "a\nb\n\na"), (2, ""), (3, "x")]


def test_trees_are_reduced_and_rebuilt(spark):
    texts = ["int f() { return g(1); } int f() { return g(1); } int x;", "a(b(c(d[1], {2}))); b(c(d[1], {2}));", "", "x } ) {", "( [ ( ( { } )", "}"]
    stream = tokens.cpp_stream(spark.createDataFrame(list(enumerate(texts)), "id long, content string"), "id")
    units, roots = dedup.reduce_tree(stream)
    assert units.count() == units.select("unit").distinct().count() == 13
    rebuilt = {r.file_id: r.syms for r in dedup.rebuild_tree(units, roots).collect()}
    assert rebuilt == {r.file_id: r.syms for r in tokens.symbol_arrays(stream).collect()} and len(rebuilt) == 5
    empty = dedup.reduce_tree(stream.where("false"))
    assert dedup.rebuild_tree(*empty).count() == 0


def test_nesting():
    parent, end, error = tokens.nested(tokens.cpp_tokens("f(a[1]) { ( }"))
    assert parent == [-1, -1, 1, 1, 3, 3, 1, -1, 7, 7] and end == [0, 6, 2, 5, 4, 5, 6, 9, 8, 9]
    assert [k for k, e in enumerate(error) if e] == [8]
    assert tokens.nested([]) == ([], [], [])


def test_vector_hash(spark):
    def hashed(values):
        seed = len(values)
        for x in values:
            seed ^= (x + 0x9E3779B9 + (seed << 6) + (seed >> 2)) & (1 << 64) - 1
            seed &= (1 << 64) - 1
        return seed - (1 << 64) if seed >> 63 else seed

    rng = random.Random(1)
    data = [[rng.randrange(1 << 32) for _ in range(n)] for n in (0, 1, 2, 5, 40)]
    got = {r.file_id: r.h for r in arrays(spark, list(enumerate(data))).select("file_id", scalars.vector_hash(F.col("syms")).alias("h")).collect()}
    assert got == {k: hashed(x) for k, x in enumerate(data)}


def test_deep_search(spark):
    rows = [(1, "one two three\nfour Five six seven"), (2, "x\n\none two\nthree four five six y")]
    deep = tokens.text_deep(spark.createDataFrame(rows, "id long, text string"), "id")
    found = search.search_deep(deep.where("file_id = 1"), deep.where("file_id = 2"), 4).collect()
    assert [(r.base_start, r.base_end, r.search_start, r.base_start_line, r.base_end_line, r.search_start_line, r.search_end_line, r.n_renamed) for r in found] == [(0, 5, 1, 1, 2, 3, 4, 0)]
    assert [(r.pos, r.name, r.line) for r in search.windows_deep(deep.where("file_id = 1"), 6).orderBy("pos").collect()] == [(0, "one", 1), (1, "two", 1)]


def test_reuse_links_each_window_once(spark):
    a = list(range(100))
    rows = arrays(spark, [(1, a), (2, a), (3, [7, *a[:70]]), (4, list(range(500, 600)))])
    assert ranges(search.reuse(rows, 64)) == [(1, 2, 0, 99, 0, 99), (1, 3, 0, 69, 1, 70)]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(11, "MIT", 0), (12, "GPL", 1), (13, "", 9)], "internal_id long, licence string, data_index long")
    trees = spark.createDataFrame([(7, 0, [1]), (7, 1, [2])], "data_id long, data_index long, syms array<bigint>")
    licence = store.names_of(rows.where("licence <> ''"), "licence").select("id", F.col("name").alias("licence"))
    assert ranges(store.snippets(store.snippets_of(rows, 7), licence, trees)) == [(11, "MIT", [1]), (12, "GPL", [2])]
    tags = spark.createDataFrame([("r", "v1", "a"), ("r", "v1", "a"), ("s", "v1", "a")], "repo string, tag string, sha string")
    assert store.tags_of(tags).count() == 2
    for scan, kind in ((1, "shallow"), (1, "deep"), (2, "shallow")):
        store.results(rows, scan, kind, str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).where("scan_id = 1").count() == 6
    tables = {k: spark.createDataFrame([(1, k)], "id long, name string") for k in ("group", "project", "version", "scan")}
    catalogue.save(tables, str(tmp_path / "catalogue"))
    assert {k: v.first().name for k, v in catalogue.load(spark, str(tmp_path / "catalogue")).items()} == {k: k for k in tables}


def test_cursor(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, at long")
    assert ranges(incremental.after_cursor(rows, incremental.cursor(rows.where("id = 1"), "at", "id"), "at", "id")) == [(2, 5), (3, 6)]
    assert incremental.after_cursor(rows, incremental.cursor(rows.limit(0), "at", "id"), "at", "id").count() == 3


def test_size_batches(spark):
    rows = spark.createDataFrame([("a", k, 6) for k in range(6)] + [("b", 9, 50)], "g string, k long, s long")
    got = {(r.g, r.k): r.batch_no for r in batches.size_batches(rows, "g", "k", "s", 10).collect()}
    assert [got[("a", k)] for k in range(6)] == [0, 0, 1, 1, 2, 2] and got[("b", 9)] == 0


@pytest.mark.parametrize("limit", [5, 40, 1000])
def test_size_batches_over_many_runs(spark, limit):
    rng = random.Random(limit)
    data = [(g, k, rng.choice([0, 0, 1, 3, 7, 60])) for g in ("a", None) for k in range(700 if g else 90)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r.g, r.k): r.batch_no for r in batches.size_batches(spark.createDataFrame(data, "g string, k long, s long"), "g", "k", "s", limit).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = {}, ()
    for g, k, size in data:
        if last != (g,):
            last, total, no = (g,), 0, 0
        elif total > limit:
            total, no = 0, no + 1
        total += size
        want[g, k] = no
    assert got == want


@pytest.mark.parametrize("modifier", codec.MODIFIERS)
@pytest.mark.parametrize("name", codec.CODECS)
@pytest.mark.parametrize("width", [1, 4])
def test_codec_round_trip(name, modifier, width):
    top = 1 << 8 * width
    data = b"".join((k * (top // 100) % top).to_bytes(width, "little") for k in range(100))
    frame = codec.pack(data, name, modifier)
    assert (data if name == modifier == "none" else codec.unpack(frame)) == data
    assert codec.pack(b"", name, modifier) is not None


def test_codec_choice(spark):
    blobs = spark.createDataFrame([(1, bytearray(b"a" * 500)), (2, bytearray(b"xyz"))], "id long, data binary")
    best = {r.id: r.codec for r in codec.choose(codec.sizes(blobs)).collect()}
    assert best == {1: "zlib", 2: "none"}
    assert {r.codec for r in codec.choose(codec.sizes(blobs), force="lzma").collect()} == {"lzma"}


def test_increments(spark):
    tags = spark.createDataFrame([("r", "v1", "a"), ("r", "v2", "x"), ("r", "v3", "c")], "repo string, tag string, sha string")
    done = spark.createDataFrame([("r", "v1", "a"), ("r", "v2", "b")], "repo string, tag string, sha string")
    assert ranges(incremental.new_tags(tags, done)) == [("r", "v3", "c")]
    assert ranges(incremental.new_tags(tags, done, with_sha=True)) == [("r", "v2", "x"), ("r", "v3", "c")]
    rows = spark.createDataFrame([("a", 1, ["t1", "t2"])], "k string, at int, tags array<string>")
    change = spark.createDataFrame([("a", 2, ["t3"]), ("b", 1, [])], "k string, at int, tags array<string>")
    assert ranges(incremental.upsert(rows, change, "k", ("at",))) == [("a", 2, ["t3"]), ("b", 1, [])]
    changed, reused = incremental.changed_files(spark.createDataFrame([("p", "1"), ("q", "2")], "path string, content_hash string"), spark.createDataFrame([("p", "1"), ("q", "0")], "path string, content_hash string"))
    assert (changed.first().path, reused.first().path) == ("q", "p")


def test_scan_states(spark):
    scans = spark.createDataFrame([(1, "Idle"), (2, "Running")], "id long, status string")
    assert {r.id: r.status for r in catalogue.moved(catalogue.moved(scans, 1, "Started"), 2, "Started").collect()} == {1: "Started", 2: "Running"}
    table = catalogue.add(spark.createDataFrame([], "id long, name string, group_id long"), "p", group_id=4)
    assert ranges(catalogue.rename(table, 1, "q")) == [(1, "q", 4)]


def test_stored_scans(spark):
    trees = spark.createDataFrame([(7, 0, [1, 2])], "data_id long, data_index long, syms array<bigint>")
    snippet = spark.createDataFrame([(1, 11, 1, 7, 0), (2, 12, 9, 7, 0), (3, 13, 1, 7, 5)], model.SNIPPET)
    licence = spark.createDataFrame([(1, "MIT")], model.LICENCE)
    assert ranges(store.snippets(snippet, licence, trees)) == [(11, "MIT", [1, 2]), (12, "", [1, 2])]


def test_sources(spark, tmp_path):
    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "src/a.cpp").write_text("int x;")
    (tmp_path / "src/sub/b.txt").write_text("hello there")
    (tmp_path / "src/c.bin").write_text("no")
    (tmp_path / "src/big.txt").write_text("x" * (model.MAX_BYTES + 1))
    found = files.scan_path(spark, str(tmp_path / "src"))
    assert sorted(r.source_type for r in found.collect()) == ["cpp", "text"]
    assert files.streams(found).count() == 5
    assert {r.res_size for r in files.scan_sizes(found).collect()} == {12, 8}
    assert files.skipped(spark, str(tmp_path / "src")).count() == 1 and files.scan_path(spark, str(tmp_path / "src"), None).count() == 3
    assert sorted((r.names, r.lines) for r in files.scan_deep(found).collect()) == [(["hello", "there"], [1, 1]), (["int", "x", ";"], [1, 1, 1])]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.c", "int y;")
        z.writestr("d/n.exe", "no")
    assert [r.path for r in files.scan_zips(spark, str(tmp_path / "z.zip")).collect()] == ["d/a.c"]
    (tmp_path / "posts.xml").write_text('<?xml version="1.0"?><posts>\n<row Id="1" CreationDate="2020-01-01" ContentLicense="CC BY-SA 4.0" Body="&lt;p&gt;t&lt;/p&gt;&lt;code&gt;a &amp;lt; b&lt;/code&gt;&lt;code&gt;&lt;/code&gt;"/>\n<row Id="2" Body="none"/>\n</posts>')
    files.convert_dump(spark, str(tmp_path / "posts.xml"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.snippet_id, r.licence, r.code) for r in got] == [(1, "CC BY-SA 4.0", "a < b")]
    refs = json.dumps([{"ref": "refs/tags/v1", "object": {"sha": "s", "type": "tag"}}, {"ref": "refs/heads/m", "object": {"sha": "t", "type": "commit"}}])
    assert ranges(files.refs(spark.createDataFrame([("r", refs)], "repo string, json string"))) == [("r", "v1", "s", True)]


def test_scalars(spark):
    row = spark.createDataFrame([("https://host.org/me/proj.git", "12x", "a&amp;lt;b", "dir/x.TAR.gz")], "u string, h string, e string, p string")
    owner, name = scalars.owner_and_name(F.col("u"))
    got = row.select(owner, name, scalars.header_long(F.col("h"), 5), scalars.header_long(F.lit("q"), 5), scalars.decode_entities(F.col("e")), scalars.extension(F.col("p")), scalars.trim_blank(F.lit(" \ta\r\n")), scalars.line_slice(F.lit("a\nb\nc"), F.lit(0), F.lit(2)), scalars.line_slice(F.lit("a\nb"), F.lit(2), F.lit(9))).first()
    assert tuple(got) == ("me", "proj", 12, 5, "a&lt;b", "gz", "a", "a\nb", "b")


def test_settings(tmp_path):
    (tmp_path / "s.cfg").write_text("[pathes]\ndbPath=../db\n[search]\nwindowSize=128\n")
    got = model.read_settings(str(tmp_path / "s.cfg"))
    assert got.window == 128 and got.database == str(tmp_path.parent / "db") and got.scan_server == ("127.0.0.1", 9080)


def test_stream_keeps_the_newest(spark, tmp_path):
    schema = "k string, at long, v string"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for rows in ([("a", 1, "x"), ("b", 1, "y")], [("a", 3, "z")], [("a", 2, "old")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = feed.keep_newest(feed.changes(spark, source, schema), table, str(tmp_path / "checkpoint"), "k", ("at",), buckets=2)
        query.awaitTermination()
    assert ranges(feed.latest(spark, table).select("k", "at", "v")) == [("a", 3, "z"), ("b", 1, "y")]
    versions = feed._buckets(spark, table)
    assert all(len(v) <= 2 for v in versions.values()) and sum(len(v) for v in versions.values()) < 6


def test_frame_sizes(spark):
    """Golden sizes of some blobs: a header of 12 bytes, the payload, and padding to 4."""
    blobs = {1: b"", 2: b"abcde", 3: bytes(range(256)) * 4, 4: b"a" * 1000}
    frames = {(k, c, m): codec.pack(d, c, m) for k, d in blobs.items() for c in codec.CODECS for m in codec.MODIFIERS}
    size = lambda *key: len(frames[key])
    assert [size(k, "none", "none") for k in blobs] == [0, 5, 1024, 1000]
    assert [size(k, "none", "delta") for k in blobs] == [12, 20, 1036, 1012]
    # Differences of a ramp are ones, so they pack far better than the ramp.
    assert size(3, "zlib", "delta") < 40 < 250 < size(3, "zlib", "none") and size(4, "zlib", "none") < 40
    assert all(len(f) % 4 == 0 for (k, c, m), f in frames.items() if (c, m) != ("none", "none"))
    packed = spark.createDataFrame([(k, d) for k, d in blobs.items()], "id long, data binary")
    got = codec.frame_headers(codec.frames(packed, "bz2", "delta")).collect()
    assert {(r.id, r.codec, r.modifier, r.original) for r in got} == {(k, 3, 1, len(d)) for k, d in blobs.items()}
