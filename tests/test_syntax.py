"""Syntax trees of C: shapes, errors, renaming, deep and odd files."""

import random
import time

import pytest

from reuselens.operators import dedup, syntax, tokens


def shape(source):
    """The tree of a file as text, without the file's node."""
    rows = syntax.flat(syntax.parse(tokens.cpp_tokens(source)))
    parts = [[] for _ in rows]
    texts = [""] * len(rows)
    for k in range(len(rows) - 1, -1, -1):
        texts[k] = rows[k][0] + (f"({', '.join(reversed(parts[k]))})" if parts[k] else "")
        if k:
            parts[rows[k][3]].append(texts[k])
    return ", ".join(reversed(parts[0]))


@pytest.mark.parametrize(
    ("source", "tree"),
    [
        ("a = b + c * d - e;", "expression(=(identifier, -(+(identifier, *(identifier, identifier)), identifier)))"),
        ("a = b = c || d && e;", "expression(=(identifier, =(identifier, ||(identifier, &&(identifier, identifier)))))"),
        ("a ? b : c ? d : e;", "expression(?(identifier, identifier, ?(identifier, identifier, identifier)))"),
        ("-x++ << *p->q;", "expression(<<(prefix -(postfix ++(identifier)), prefix *(->(identifier, identifier))))"),
        ("x = (int) y; (a)*b;", "expression(=(identifier, cast(type(int), declarator, identifier))), expression(*(brackets(identifier), identifier))"),
        ("f(a, g(1))[i];", "expression(index(call(identifier, identifier, call(identifier, number)), identifier))"),
        ("T *p = 0, a[3];", "declaration(type(identifier), declarator(pointer, identifier, number), declarator(identifier, array(number)))"),
        ("void (*f)(int);", "declaration(type(void), declarator(declarator(pointer, identifier), parameters(parameter(type(int), declarator))))"),
        ("int v[] = {1, {2}};", "declaration(type(int), declarator(identifier, array, list(number, list(number))))"),
        ("if (a) b(); else if (c) ; else { }", "if(identifier, expression(call(identifier)), if(identifier, empty, block))"),
        ("for (;;) { break; }", "for(empty, empty, empty, block(break))"),
        ("do x--; while (x);", "do(expression(postfix --(identifier)), identifier)"),
        ("switch (x) { case 1: default: ; } l: goto l;", "switch(identifier, block(case(number), default, empty)), label(identifier), goto(identifier)"),
        ("enum e { A, B = 2 };", "declaration(type(enum, identifier, list(identifier, =(identifier, number))))"),
        # What is missing, and what is too much.
        ("{ a = b }", "block(expression(=(identifier, identifier), error))"),
        ("a = ; b;", "expression(=(identifier, error)), expression(identifier)"),
        ("a @ b; c;", "expression(identifier, error(@, identifier, ;)), expression(identifier)"),
        ("x = y z; w;", "expression(=(identifier, identifier), error(identifier, ;)), expression(identifier)"),
        ("int a = 1 int b;", "declaration(type(int), declarator(identifier, number), error), declaration(type(int), declarator(identifier))"),
        ("{ a;", "block(expression(identifier), error)"),
        ("} a;", "error(}, identifier, ;)"),
        ("", ""),
    ],
)
def test_shapes(source, tree):
    assert shape(source) == tree


def value(node, found):
    """What an expression of numbers gives."""
    kind, parts = node.kind, node.parts
    if kind == "number":
        return int(found[node.token][3])
    got = [value(p, found) for p in parts]
    if kind in ("expression", "brackets"):
        return got[0]
    if kind == "?":
        return got[1] if got[0] else got[2]
    if kind.startswith("prefix"):
        return {"-": -got[0], "~": ~got[0], "!": int(not got[0])}[kind[-1]]
    a, b = got
    return {"+": a + b, "-": a - b, "*": a * b, "|": a | b, "&": a & b, "^": a ^ b, "<<": a << (b % 8), "<": int(a < b), "==": int(a == b), "&&": int(bool(a and b)), "||": int(bool(a or b))}[kind]


def test_precedence_is_that_of_a_tree_in_brackets():
    """Expressions written with the brackets that the rules of precedence ask for and no other ones."""
    ranks = syntax.PRECEDENCE
    rng = random.Random(5)

    def made(depth):
        """(text with as few brackets as can be, value, rank)"""
        if depth == 0 or rng.random() < 0.2:
            n = rng.randrange(5)
            return str(n), n, 99
        if rng.random() < 0.2:
            text, n, rank = made(depth - 1)
            return (f"~ {text}" if rank >= 50 else f"~ ({text})"), ~n, 50
        op = rng.choice("+ - * | & ^ < == && ||".split())
        (a, x, p), (b, y, q) = made(depth - 1), made(depth - 1)
        a, b = (a if p >= ranks[op] else f"({a})"), (b if q > ranks[op] else f"({b})")
        n = {"+": x + y, "-": x - y, "*": x * y, "|": x | y, "&": x & y, "^": x ^ y, "<": int(x < y), "==": int(x == y), "&&": int(bool(x and y)), "||": int(bool(x or y))}[op]
        return f"{a} {op} {b}", n, ranks[op]

    for _ in range(400):
        text, n, _ = made(5)
        found = tokens.cpp_tokens(text + ";")
        assert value(syntax.parse(found).parts[0], found) == n, text


@pytest.mark.parametrize("part", ["( ", "{ ", "if (a) ", "a = ", "! ", "a + b * ", "T ", "f(", "* ", "int f(", ") ", "= ", "struct s { "])
def test_depth_takes_linear_time(part):
    times = []
    for n in (5_000, 20_000):
        found = tokens.cpp_tokens(part * n)
        started = time.process_time()
        assert len(syntax.flat(syntax.parse(found))) >= n
        times.append(time.process_time() - started)
    assert times[1] < 12 * times[0] + 0.5


def test_any_tokens_give_a_tree():
    rng = random.Random(3)
    some = "a b 1 ( ) [ ] { } ; , = + * - ? : if else while for do return int struct T -> . ++ case default @ ... enum".split()
    for _ in range(3_000):
        found = tokens.cpp_tokens(" ".join(rng.choice(some) for _ in range(rng.randrange(40))))
        rows = syntax.flat(syntax.parse(found))
        assert len(rows) <= 6 * len(found) + 1
        for k, (_, token, depth, parent, end) in enumerate(rows):
            assert token <= len(found) and end >= k
            assert (parent == -1) == (k == 0)
            assert k == 0 or (parent < k <= end <= rows[parent][4] and depth == rows[parent][2] + 1)


def test_stream_of_renamed_null_and_odd_files(spark):
    rows = [(1, "int f(int a) { return a * 2; }"), (2, "int  g(int b)\n{ return b * 7; }"), (3, "int f(int a) { return a + 2; }"), (4, None), (5, ""), (6, "/* only a remark */"), (1, "x;")]
    stream = syntax.c_stream(spark.createDataFrame(rows[:-1], "id long, content string"), "id")
    syms = {r.file_id: r.syms for r in tokens.symbol_arrays(stream).collect()}
    assert syms[1] == syms[2] != syms[3]
    assert syms[4] == syms[5] == syms[6] and len(syms[4]) == 1
    assert {r.file_id: (r.n_tokens, r.n_errors) for r in tokens.error_share(stream).collect()}[4] == (1, 0)
    lines = {(r.file_id, r.name): r.line for r in stream.collect()}
    assert lines[2, "return"] == 2


def test_trees_of_equal_kinds_and_other_shapes(spark):
    """f()(a, b) and f(a)(b) have the same kinds in the same order."""
    files = spark.createDataFrame([(1, "f()(a, b);"), (2, "f(a)(b);"), (3, "g()(c, d);")], "id long, content string")
    stream = syntax.c_stream(files, "id")
    syms = {r.file_id: r.syms for r in tokens.symbol_arrays(stream).collect()}
    assert syms[1] == syms[2] == syms[3]
    units, roots = dedup.reduce_tree(stream)
    top = {r.file_id: r["items"][0].unit for r in roots.collect()}
    assert top[1] == top[3] != top[2]
    back = {r.file_id: r.syms for r in dedup.rebuild_tree(units, roots).collect()}
    assert back == syms
