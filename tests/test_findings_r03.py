"""Queries on rows that the test tables lack, against their SQL."""

import duckdb

from reuselens.operators import catalogue, search, syntax, tokens
from reuselens.plans import queries


def wanted(name, **tables):
    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    return sorted(tuple(row) for row in found.fetchall()), columns


def test_restart_of_any_state(spark, tmp_path):
    scans = spark.createDataFrame(list(enumerate(catalogue.STATES)), "id long, status string")
    for i, _ in enumerate(catalogue.STATES):
        assert {r.id: r.status for r in catalogue.restarted(scans, i).collect()} == {**dict(enumerate(catalogue.STATES)), i: "Started"}
    for state in "OPF":
        path = f"{tmp_path}/{state}/orders.parquet"
        spark.createDataFrame([(1, 1, "1-URGENT", state), (2, 1, "1-URGENT", "P")], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(path)
        rows, columns = wanted("restart_scan", orders=path)
        assert sorted(tuple(r) for r in queries.restart_scan(spark, f"{tmp_path}/{state}").select(*columns).collect()) == rows


def test_rewriting_words_of_one_symbol(spark, tmp_path):
    """The MD5 digests of su7 and word84240 begin with the same 32 bits, as do those of ldd and word105961."""
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "su7 word84240 of ldd"), (2, "word84240 word105961 is"), (3, None)], "doc_id long, text string").write.parquet(path)
    rows, columns = wanted("rewritten_symbols", documents=path)
    assert sorted(tuple(r) for r in queries.rewritten_symbols(spark, str(tmp_path)).select(*columns).collect()) == rows


def test_arrays_are_those_of_the_streams(spark):
    texts = ["", None, "int f ( ) { return 1 ; }\nint f ( ) { return 1 ; }", "a /* b\n c */ d\n#define X \\\n y\n\"s\" ) @ [", "x\n\ny // z\n#if 0\n R\"(a\n)\" 'c'"]
    files = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    for stream, arrays in ((tokens.cpp_stream, tokens.cpp_arrays), (syntax.c_stream, syntax.c_arrays)):
        wanted_rows = {tuple(map(repr, r)) for r in tokens.tree_arrays(stream(files, "id")).collect()}
        assert {tuple(map(repr, r)) for r in arrays(files, "id", ("syms", "parents", "ends")).collect()} == wanted_rows
    lines = {(r.file_id, r.line, r.name) for r in tokens.cpp_stream(files, "id").collect()}
    assert {(3, 1, "a"), (3, 2, "d"), (3, 5, '"s"'), (4, 1, "x"), (4, 3, "y"), (4, 6, "'c'")} <= lines


def test_search_meets_on_the_order_of_symbols(spark):
    frame = lambda rows: spark.createDataFrame(rows, "file_id long, syms array<bigint>")
    base, wanted = frame([(1, [1, 2, 3, 4, 5, 6]), (2, [3, 2, 1, 9, 9])]), frame([(7, [0, 1, 2, 3, 4, 8]), (8, [3, 2, 1])])
    prints = {tuple(r) for r in search.hashed_windows(base, 3).select("file_id", "fp").collect()}
    assert len({fp for i, fp in prints}) == 7  # 1 2 3 is not 3 2 1
    assert sorted(tuple(r) for r in search.search(base, wanted, 3).collect()) == [(1, 7, 0, 3, 1, 4), (2, 8, 0, 2, 0, 2)]
    # Windows of equal hashes that are not equal are cut out of their range.
    ranges = spark.createDataFrame([(1, 7, 0, 5, 0, 5), (1, 7, 0, 4, 1, 5)], "base_id long, search_id long, base_start long, base_end long, search_start long, search_end long")
    assert [tuple(r) for r in search.verified_ranges(ranges, base, wanted, 3).collect()] == [(1, 7, 0, 3, 1, 4)]
