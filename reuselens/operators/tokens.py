"""Symbol streams of texts, by registered handlers of source types."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exploded, symbol_of

BLANKS = r"[ \t\n\r\f]+"


def text_tokens(text: Column) -> Column:
    """Array of the lower-case tokens of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), lambda t: t != "")


def text_symbols(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(file_id, syms): one array of symbols per text, made inside the row. All searches start from here."""
    return docs.select(F.col(id_col).cast("long").alias("file_id"), F.transform(text_tokens(F.col(text_col)), symbol_of).alias("syms"))


def token_stream(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(file_id, pos, sym, name, line): one row per token, in source order; lines count from 1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Positions count over the whole text, so lines are taken apart inside the row.
    pairs = F.flatten(F.transform(F.split(F.lower(text), "\n", -1), lambda body, k: F.transform(F.filter(F.split(body, BLANKS), lambda t: t != ""), lambda t: F.struct((k + 1).alias("line"), t.alias("name")))))
    rows = exploded(docs.withColumn("file_id", F.col(id_col).cast("long")), "file_id", pairs, "pos", "t")
    return rows.select("file_id", F.col("pos").cast("long").alias("pos"), symbol_of(F.col("t.name")).alias("sym"), F.col("t.name").alias("name"), F.col("t.line").cast("long").alias("line"))


def text_deep(docs: DataFrame, id_col: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, syms, names, lines): text_symbols with the token and the line of each symbol, made inside the row, and the columns of docs in keep."""
    rows = docs.select(F.col(id_col).cast("long").alias("file_id"), *keep, F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "\n", -1).alias("_lines"))
    rows = rows.withColumn("_tokens", F.transform("_lines", lambda body: F.filter(F.split(body, BLANKS), lambda t: t != "")))
    lines = F.flatten(F.transform("_tokens", lambda some, k: F.transform(some, lambda t: (k + 1).cast("long"))))
    rows = rows.select("file_id", F.flatten("_tokens").alias("names"), lines.alias("lines"), *keep)
    return rows.select("file_id", F.transform("names", symbol_of).alias("syms"), "names", "lines", *keep)


# Words of C and C++ that are symbols of their own, fixed by the languages.
CPP_KEYWORDS = (
    "alignas alignof asm auto bool break case catch char class const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this throw true try typedef typeid typename union unsigned using virtual void volatile while"
).split()
_CPP = r'(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<directive>(?m:^)[ \t]*\#(?:\\\n|[^\n])*)|(?P<string>(?:u8|u|U|L)?R"(?P<delim>[^(\s]*)\(.*?\)(?P=delim)"|(?:u8|u|U|L)?"(?:\\.|[^"\\\n])*"|(?:u8|u|U|L)?\'(?:\\.|[^\'\\\n])*\')|(?P<number>\.?[0-9](?:[eEpP][+-]|[0-9a-zA-Z_.\'])*)|(?P<word>[A-Za-z_]\w*)|(?P<mark><<=|>>=|\.\.\.|->\*|::|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[^\s\w])'


_WORDS = frozenset(CPP_KEYWORDS)
#: Lines whose tokens are kept for later files of the same Python worker, and how many of their characters there are at most.
_LINES_KEPT: dict[str, tuple[list[str], list[str]]] = {}
_KEPT_CHARS = 0
LINE_CHARS = 1 << 19


def _found(source: str) -> Iterator[tuple[int, str, str]]:
    """(start, class, text) of the tokens of source."""
    for m in re.finditer(_CPP, source, re.S):
        kind, text = m.lastgroup if m.lastgroup != "delim" else "string", m[0]
        if kind == "comment":
            continue
        if kind == "word":
            kind = text if text in _WORDS else "identifier"
        elif kind == "mark":
            kind = text
        yield m.start(), kind, text


def _lines(source: str) -> Iterator[tuple[int, tuple[list[str], list[str]]]]:
    """(line, (classes, texts)) of the tokens of source, in order. Where nothing can reach over the end of a line, each line is read by itself, and equal lines once; where no token can hold a blank, so are words of a line."""
    if "\\" in source or "/*" in source or 'R"' in source:
        line, at = 1, 0
        for start, kind, text in _found(source):
            line += source.count("\n", at, start)
            at = start
            yield line, ([kind], [text])
        return
    for k, body in enumerate(source.split("\n"), 1):
        yield k, _read(body)


def _read(body: str) -> tuple[list[str], list[str]]:
    global _KEPT_CHARS
    held = _LINES_KEPT.get(body)
    if held is not None:
        return held
    words = body.split()
    if len(words) > 1 and not any(mark in body for mark in ('"', "'", "#", "//")):
        read = [_LINES_KEPT.get(word) or _read(word) for word in words]
        held = tuple(list(itertools.chain.from_iterable(some)) for some in zip(*read, strict=True))
    else:
        found = [(kind, text) for _, kind, text in _found(body)]
        held = [kind for kind, _ in found], [text for _, text in found]
    if len(body) <= 256:
        if _KEPT_CHARS >= LINE_CHARS:
            _LINES_KEPT.clear()
            _KEPT_CHARS = 0
        _LINES_KEPT[body] = held
        _KEPT_CHARS += len(body) + 1
    return held


def cpp_tokens(source: str) -> list[tuple[int, int, str, str]]:
    """(line, depth, class, text) of the tokens of C or C++ source. Identifiers, numbers and strings are classes, so renaming does not matter; comments and white space leave no token."""
    found, depth = [], 0
    for line, some in _lines(source):
        for kind, text in zip(*some, strict=True):
            if kind in _PAIRS:
                depth = max(depth - 1, 0)
                found.append((line, depth, kind, text))
            else:
                found.append((line, depth, kind, text))
                if kind in _OPENING:
                    depth += 1
    return found


# Marks of C and C++ that stand alone, fixed by the languages.
CPP_MARKS = frozenset("{}[]()#<>=+-*/%&|^!~?:;,.")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_OPENING = frozenset(_PAIRS.values())
#: Tokens from which those of the files read so far are handed on.
TOKENS = 1 << 16


def nested(found: list[tuple[int, int, str, str]]) -> tuple[list[int], list[int], list[bool]]:
    """(parent, end, error) of tokens as cpp_tokens gives them: the place of the bracket that a token stands in, -1 at the top; the last place of what a bracket opens, itself for other tokens; and whether it is an error: a mark that the language does not have, a bracket that closes nothing, or one that is never closed. A closing bracket stands in what it closes."""
    parent, end, error, open_ = [], [], [], []
    waiting = dict.fromkeys(_PAIRS.values(), 0)  # how many of each kind are open
    for k, (_, _, kind, _) in enumerate(found):
        bad = len(kind) == 1 and not kind.isalnum() and kind not in CPP_MARKS
        closes = kind in _PAIRS and waiting[_PAIRS[kind]] > 0
        bad |= kind in _PAIRS and not closes
        while closes and found[open_[-1]][2] != _PAIRS[kind]:  # what was not closed ends before
            i = open_.pop()
            waiting[found[i][2]] -= 1
            error[i], end[i] = True, k - 1
        parent.append(open_[-1] if open_ else -1)
        end.append(k)
        error.append(bad)
        if closes:
            waiting[_PAIRS[kind]] -= 1
            end[open_.pop()] = k
        elif kind in waiting:
            waiting[kind] += 1
            open_.append(k)
    for i in open_:
        error[i], end[i] = True, len(found) - 1
    return parent, end, error


#: Class of a token or node to its symbol, as symbol_of() makes it.
_SYMBOLS: dict[str, int] = {}


def symbols(kinds: Iterable[str]) -> list[int]:
    """symbol_of() of the classes of tokens, which are few: names, numbers and strings are classes."""
    kinds = list(kinds)
    out = list(map(_SYMBOLS.get, kinds))
    if None not in out:
        return out
    out = []
    for kind in kinds:
        if (sym := _SYMBOLS.get(kind)) is None:
            if len(_SYMBOLS) >= TOKENS:  # any character may be a mark
                _SYMBOLS.clear()
            sym = _SYMBOLS[kind] = int(hashlib.md5(kind.encode()).hexdigest()[:8], 16)
        out.append(sym)
    return out


#: Columns of a parsed file: of a row of a stream, and of a row of arrays.
COLUMNS = {"sym": pa.int64(), "name": pa.string(), "line": pa.int64(), "depth": pa.int64(), "parent": pa.int64(), "end": pa.int64(), "error": pa.bool_()}
ARRAYS = {"syms": "sym", "names": "name", "lines": "line", "parents": "parent", "ends": "end"}
_SQL = {"sym": "bigint", "name": "string", "line": "bigint", "depth": "bigint", "parent": "bigint", "end": "bigint", "error": "boolean"}


def _chunks(batches, read):
    """(batch, file sizes, columns) of files (file_id, text, ...), cut so that each has TOKENS rows and a file at most."""
    for batch in batches:
        texts = batch.column(1)
        first, sizes, rows, total = 0, [], {}, 0
        for k in range(batch.num_rows):
            made = read(texts[k].as_py() or "")
            sizes.append(len(made["sym"]))
            total += sizes[-1]
            for name, values in made.items():
                rows.setdefault(name, []).append(values)
            if k + 1 == batch.num_rows or total >= TOKENS:
                yield batch.slice(first, k + 1 - first), sizes, rows
                first, sizes, rows, total = k + 1, [], {}, 0


def _joined(parts, kind: pa.DataType) -> pa.Array:
    return pa.array(np.concatenate(parts) if isinstance(parts[0], np.ndarray) else list(itertools.chain.from_iterable(parts)), kind)


def parsed_stream(files: DataFrame, id_col: str, text_col: str, read: Callable[[str], dict]) -> DataFrame:
    """(file_id, pos, sym, name, line, depth, parent, end, error): a row for each token or node that read finds in a file. read gives the columns of a text."""

    def run(batches):
        for batch, sizes, rows in _chunks(batches, read):
            n = np.array(sizes)
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            file_id = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([file_id, pa.array(pos, pa.int64()), *(_joined(rows[c], kind) for c, kind in COLUMNS.items())], ["file_id", "pos", *COLUMNS])

    rows = files.select(F.col(id_col).cast("long").alias("file_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(["file_id bigint", "pos bigint", *(f"`{c}` {_SQL[c]}" for c in COLUMNS)]))


def parsed_arrays(files: DataFrame, id_col: str, text_col: str, read: Callable[[str], dict], columns: tuple[str, ...], keep: tuple[str, ...] = (), more: Callable | None = None) -> DataFrame:
    """(file_id, columns): the same with arrays, some of ARRAYS, in one row a file, and the columns of files in keep; a file without symbols has none. more makes further columns of those of many files, given their sizes. Nothing is shuffled."""

    def run(batches):
        for batch, sizes, rows in _chunks(batches, read):
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            if more:
                rows |= more(sizes, rows)
            found = [pa.ListArray.from_arrays(ends, _joined(rows[ARRAYS[c]], COLUMNS[ARRAYS[c]])) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *batch.columns[2:]], ["file_id", *columns, *keep])

    rows = files.select(F.col(id_col).cast("long").alias("file_id"), F.col(text_col).cast("string").alias("text"), *keep)
    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    out = rows.mapInArrow(run, ", ".join(["file_id bigint", *(f"{c} array<{_SQL[ARRAYS[c]]}>" for c in columns), *kept]))
    return out.where(F.size(columns[0]) > 0)


def cpp_read(text: str) -> dict:
    found = cpp_tokens(text)
    line, depth, kind, name = zip(*found, strict=True) if found else ((),) * 4
    parent, end, error = nested(found)
    return {"sym": symbols(kind), "name": name, "line": line, "depth": depth, "parent": parent, "end": end, "error": error}


def cpp_stream(files: DataFrame, id_col: str, text_col: str = "content") -> DataFrame:
    """(file_id, pos, sym, name, line, depth, parent, end, error) of C and C++ files; a symbol stands for a token's class, and parent, end and error are those of nested()."""
    return parsed_stream(files, id_col, text_col, cpp_read)


#: What a bracket opens, or closes with its sign turned.
_SIDES = {**{kind: k for k, kind in enumerate(_PAIRS.values(), 1)}, **{kind: -k for k, kind in enumerate(_PAIRS, 1)}}


def nested_files(sizes: list[int], rows: dict) -> dict:
    """parent and end of nested() of the tokens of many files, of their classes (kind). Files whose brackets all match are taken together; of tokens on one level each stands in the last bracket that opened the level above."""
    side = np.fromiter(map(_SIDES.get, itertools.chain.from_iterable(rows["kind"]), itertools.repeat(0)), np.int8, sum(sizes))
    bounds = np.append(0, np.cumsum(sizes))
    row, step = np.repeat(np.arange(len(sizes)), sizes), np.sign(side).astype(np.int64)
    level = np.append(0, np.cumsum(step))
    level = level[1:] - level[bounds[row]]
    bad = np.zeros(len(sizes), bool)
    bad[row[level < 0]] = True
    some = np.flatnonzero(np.array(sizes) > 0)
    bad[some] |= level[bounds[some + 1] - 1] != 0
    # The level that a bracket stands on, which its counterpart has, too; a bracket that closes stands in what it closes.
    own, at = level - (step > 0), np.flatnonzero((side != 0) & ~bad[row])
    order = at[np.argsort(own[at], kind="stable")]
    opens, closes = order[0::2], order[1::2]
    bad[row[opens[side[opens] != -side[closes]]]] = True
    end = np.arange(len(side)) - bounds[row]
    end[opens] = closes - bounds[row[opens]]
    within = own + (step < 0)
    key, n = own[opens] * (len(side) + 1) + opens, len(side) + 1
    up = np.searchsorted(key, (within - 1) * n + np.arange(len(side)) - (step > 0), "right") - 1
    parent = np.full(len(side), -1)
    inside = within > 0
    if len(opens):
        parent[inside] = (opens[np.maximum(up, 0)] - bounds[row])[inside]
    for k in np.flatnonzero(bad):
        parent[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]], _ = nested([(0, 0, kind, "") for kind in rows["kind"][k]])
    return {"parent": [parent], "end": [end]}


def cpp_flat(text: str) -> dict:
    """The columns of cpp_read() that do not tell how brackets nest, and the classes of tokens."""
    kinds, names, lines = [], [], []
    for line, (some, texts) in _lines(text):
        kinds += some
        names += texts
        lines += [line] * len(some)
    return {"sym": np.array(symbols(kinds), np.int64), "name": names, "line": np.array(lines, np.int64), "kind": kinds}


def cpp_arrays(files: DataFrame, id_col: str, columns: tuple[str, ...] = ("syms", "names", "lines"), text_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """cpp_stream() with a row of arrays for each file, and the columns of files in keep."""
    return parsed_arrays(files, id_col, text_col, cpp_flat, columns, keep, nested_files if {"parents", "ends"} & set(columns) else None)


def text_stream(files: DataFrame, id_col: str, text_col: str = "content") -> DataFrame:
    rows = token_stream(files, id_col, text_col)
    return rows.select("*", F.lit(0).cast("long").alias("depth"), F.lit(-1).cast("long").alias("parent"), F.col("pos").alias("end"), F.lit(False).alias("error"))


#: Source type to what makes (file_id, pos, sym, name, line, depth, parent, end, error) of its files; register() adds to it.
HANDLERS: dict[str, Callable[..., DataFrame]] = {"cpp": cpp_stream, "text": text_stream}
#: Source type to what makes (file_id, syms, names, lines) of its files, and the columns in keep, without a shuffle, for handlers that have such.
DEEP: dict[str, Callable[..., DataFrame]] = {"cpp": cpp_arrays, "text": lambda files, id_col, keep=(): text_deep(files, id_col, "content", keep).where(F.size("syms") > 0)}
#: Extension to source type.
FILE_TYPES = {"c": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "txt": "text", "md": "text"}


def register(source_type: str, extensions: tuple[str, ...], handler: Callable[..., DataFrame]) -> None:
    HANDLERS[source_type] = handler
    DEEP.pop(source_type, None)
    FILE_TYPES.update(dict.fromkeys(extensions, source_type))


def symbol_arrays(stream: DataFrame) -> DataFrame:
    """(file_id, syms) of a stream; an array is as long as its file."""
    return stream.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x.sym).alias("syms"))


def tree_arrays(stream: DataFrame) -> DataFrame:
    """(file_id, syms, parents, ends) of a stream."""
    held = stream.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sym", "parent", "end"))).alias("_t"))
    return held.select("file_id", F.col("_t.sym").alias("syms"), F.col("_t.parent").alias("parents"), F.col("_t.end").alias("ends"))


def deep_arrays(stream: DataFrame) -> DataFrame:
    """(file_id, syms, names, lines) of a stream: symbol_arrays with the name and line of each symbol."""
    held = stream.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sym", "name", "line"))).alias("_t"))
    return held.select("file_id", F.col("_t.sym").alias("syms"), F.col("_t.name").alias("names"), F.col("_t.line").alias("lines"))


def rewrite_symbols(stream: DataFrame, mapping: DataFrame) -> DataFrame:
    """A handler's filter: symbols that mapping (sym, new_sym) names are replaced, and dropped where new_sym is null. A mapping (name, new_sym) tells symbols by their names, as two names may have one symbol of 32 bits."""
    key = "name" if "name" in mapping.columns else "sym"
    joined = stream.join(mapping.withColumnRenamed(key, "_key").withColumn("_in", F.lit(True)), stream[key] == F.col("_key"), "left")
    return joined.where("_in is null or new_sym is not null").withColumn("sym", F.coalesce("new_sym", "sym")).drop("_key", "_in", "new_sym")


def error_share(stream: DataFrame) -> DataFrame:
    """(file_id, n_tokens, n_errors) of a stream: marks that the language does not have and brackets without their counterpart."""
    return stream.groupBy("file_id").agg(F.count("*").alias("n_tokens"), F.count_if("error").alias("n_errors"))
