"""Syntax trees of files in a subset of C: declarations, functions, statements and expressions by precedence, with error nodes where source is not of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .tokens import cpp_tokens, parsed_arrays, parsed_stream, symbols

# Operators and words of C, fixed by the language.
PRECEDENCE = {op: k for k, ops in enumerate(("||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %")) for op in ops.split()}
ASSIGNMENTS = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
PREFIXES = frozenset("! ~ + - * & ++ -- sizeof".split())
TYPE_WORDS = frozenset("auto bool char const double enum extern float inline int long register short signed static struct typedef union unsigned void volatile".split())
_LEAVES = frozenset("identifier number string true false nullptr this".split())
_CLOSING = {"(": ")", "[": "]", "{": "}"}


class Node:
    """A node of a tree: its kind, the token it starts at, what it holds."""

    __slots__ = ("kind", "token", "parts")

    def __init__(self, kind: str, token: int, *parts: Node):
        self.kind, self.token, self.parts = kind, token, list(parts)


def _finish(rule):
    """Runs a rule. Rules yield the rules that they need, so a tree may be deeper than Python's stack."""
    waiting, value = [rule], None
    while waiting:
        try:
            needed = waiting[-1].send(value)
        except StopIteration as done:
            waiting.pop()
            value = done.value
        else:
            waiting.append(needed)
            value = None
    return value


class Parser:
    """Rules over tokens as cpp_tokens gives them. Each looks a few tokens ahead and none goes back, so time is linear in the file.

    Without a table of types, two words in a row, or a word, stars and a word at the start of a statement, are a declaration.
    What does not fit becomes an error node: an empty one where a token is missing, else one that holds the tokens up to the next semicolon, or to what ends the block.
    """

    def __init__(self, found: list[tuple[int, int, str, str]]):
        self.kinds = [kind for _, _, kind, _ in found]
        self.at = 0

    def see(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.kinds[k] if k < len(self.kinds) else ""

    def leaf(self, kind: str | None = None) -> Node:
        self.at += 1
        return Node(kind or self.kinds[self.at - 1], self.at - 1)

    def want(self, node: Node, kind: str) -> bool:
        """Takes a token that must come here, or leaves an error in node."""
        if self.see() == kind:
            self.at += 1
            return True
        node.parts.append(Node("error", self.at))
        return False

    def skipped(self) -> Node:
        """An error that holds at least one token, up to a semicolon at this depth or to what closes the block."""
        node, depth = Node("error", self.at), 0
        while self.see():
            kind = self.see()
            if kind == "}" and depth <= 0 and node.parts:
                break
            depth += (kind in _CLOSING) - (kind in ")]}" and depth > 0)
            node.parts.append(self.leaf())
            if kind == ";" and depth <= 0:
                break
        return node

    # Files, declarations and statements

    def file(self):
        node = Node("file", 0)
        while self.see():
            node.parts.append((yield self.statement()))
        return node

    def block(self):
        node = self.leaf("block")
        while self.see() not in ("}", ""):
            node.parts.append((yield self.statement()))
        self.want(node, "}")
        return node

    def declares(self) -> bool:
        """Whether a declaration starts here."""
        if self.see() in TYPE_WORDS:
            return True
        k = 1
        while self.see(k) == "*":
            k += 1
        return self.see() == "identifier" and self.see(k) == "identifier" and (k == 1 or self.see(k + 1) in ("=", ";", ",", "[", "(", ")"))

    def statement(self):
        kind = self.see()
        if kind == "{":
            return (yield self.block())
        if kind == ";":
            return self.leaf("empty")
        if kind == "directive":
            return self.leaf()
        if kind in ("if", "while", "switch"):
            node = self.leaf()
            yield self.condition(node)
            node.parts.append((yield self.statement()))
            if kind == "if" and self.see() == "else":
                self.at += 1
                node.parts.append((yield self.statement()))
            return node
        if kind == "for":
            return (yield self.loop())
        if kind == "do":
            node = self.leaf()
            node.parts.append((yield self.statement()))
            if self.want(node, "while"):
                yield self.condition(node)
                self.want(node, ";")
            return node
        if kind in ("return", "goto", "break", "continue"):
            node = self.leaf()
            if self.see() not in (";", "}", "") and kind in ("return", "goto"):
                node.parts.append((yield self.expression()))
            return self.ended(node)
        if kind in ("case", "default"):
            node = self.leaf()
            if kind == "case":
                node.parts.append((yield self.conditional()))
            self.want(node, ":")
            return node
        if kind == "identifier" and self.see(1) == ":":
            node = Node("label", self.at, self.leaf())
            self.at += 1
            return node
        if self.declares():
            return (yield self.declaration())
        if kind in PREFIXES or kind in _LEAVES or kind in ("(", "{"):
            return self.ended(Node("expression", self.at, (yield self.expression())))
        return self.skipped()

    def ended(self, node: Node) -> Node:
        """A statement at its semicolon. Where that is missing, the error holds what is left, unless a word that starts a statement follows."""
        if self.see() == ";":
            self.at += 1
        elif self.see() in ("}", "") or self.see() in TYPE_WORDS or self.see() in _STARTS:
            node.parts.append(Node("error", self.at))
        else:
            node.parts.append(self.skipped())
        return node

    def condition(self, node: Node):
        if self.want(node, "("):
            node.parts.append((yield self.expression()))
            self.want(node, ")")

    def loop(self):
        node = self.leaf()
        if not self.want(node, "("):
            return node
        if self.declares():
            node.parts.append((yield self.declaration()))
        else:
            node.parts.append(Node("empty", self.at) if self.see() == ";" else (yield self.expression()))
            self.want(node, ";")
        node.parts.append(Node("empty", self.at) if self.see() == ";" else (yield self.expression()))
        self.want(node, ";")
        node.parts.append(Node("empty", self.at) if self.see() == ")" else (yield self.expression()))
        self.want(node, ")")
        node.parts.append((yield self.statement()))
        return node

    def specifiers(self):
        """A type: its words, at most one name among them, members or constants in braces after struct, union and enum."""
        node, named = Node("type", self.at), False
        while self.see() in TYPE_WORDS or self.see() == "identifier" and not named:
            kind = self.see()
            node.parts.append(self.leaf())
            named |= kind not in ("auto", "const", "extern", "inline", "register", "static", "typedef", "volatile")
            if kind in ("struct", "union", "enum"):
                if self.see() == "identifier":
                    node.parts.append(self.leaf())
                if self.see() == "{":
                    node.parts.append((yield self.initialiser() if kind == "enum" else self.block()))
        return node

    def declarator(self):
        node = Node("declarator", self.at)
        while self.see() in ("*", "const", "volatile"):
            node.parts.append(self.leaf("pointer" if self.see() == "*" else None))
        if self.see() == "identifier":
            node.parts.append(self.leaf())
        elif self.see() == "(" and self.see(1) in ("*", "("):
            self.at += 1
            node.parts.append((yield self.declarator()))
            self.want(node, ")")
        while self.see() in ("[", "("):
            if self.see() == "(":
                node.parts.append((yield self.parameters()))
                continue
            size = self.leaf("array")
            if self.see() != "]":
                size.parts.append((yield self.expression()))
            self.want(size, "]")
            node.parts.append(size)
        return node

    def parameters(self):
        node = self.leaf("parameters")
        while self.see() not in (")", ";", "{", "}", ""):
            start = self.at
            if self.see() == "...":
                node.parts.append(self.leaf())
            else:
                one = Node("parameter", self.at, (yield self.specifiers()))
                one.parts.append((yield self.declarator()))
                node.parts.append(one)
            if self.see() == ",":
                self.at += 1
            elif self.see() != ")":
                if self.at == start:
                    self.at += 1
                node.parts.append(Node("error", self.at - 1))
        self.want(node, ")")
        return node

    def declaration(self):
        node = Node("declaration", self.at, (yield self.specifiers()))
        while self.see() not in (";", ""):
            one = yield self.declarator()
            node.parts.append(one)
            if self.see() == "{" and len(node.parts) == 2 and one.parts and one.parts[-1].kind == "parameters":
                node.kind = "function"
                node.parts.append((yield self.block()))
                return node
            if self.see() == ":":
                self.at += 1
                one.parts.append((yield self.conditional()))
            if self.see() == "=":
                self.at += 1
                one.parts.append((yield self.initialiser() if self.see() == "{" else self.assignment()))
            if self.see() != ",":
                break
            self.at += 1
        return self.ended(node)

    def initialiser(self):
        node = self.leaf("list")
        while self.see() not in ("}", ";", ""):
            node.parts.append((yield self.initialiser() if self.see() == "{" else self.assignment()))
            if self.see() != ",":
                break
            self.at += 1
        self.want(node, "}")
        return node

    # Expressions

    def expression(self):
        first = yield self.assignment()
        if self.see() != ",":
            return first
        node = Node("comma", first.token, first)
        while self.see() == ",":
            self.at += 1
            node.parts.append((yield self.assignment()))
        return node

    def assignment(self):
        left = yield self.conditional()
        if self.see() in ASSIGNMENTS:
            node = Node(self.leaf().kind, left.token, left)
            node.parts.append((yield self.assignment()))
            return node
        return left

    def conditional(self):
        test = yield self.binary()
        if self.see() != "?":
            return test
        self.at += 1
        node = Node("?", test.token, test, (yield self.expression()))
        self.want(node, ":")
        node.parts.append((yield self.assignment()))
        return node

    def binary(self):
        """Operands and operators on two stacks; an operator waits for those that bind more tightly."""
        operands, waiting = [(yield self.unary())], []
        while True:
            rank = PRECEDENCE.get(self.see(), -1)
            while waiting and PRECEDENCE[waiting[-1]] >= rank:
                right = operands.pop()
                operands[-1] = Node(waiting.pop(), operands[-1].token, operands[-1], right)
            if rank < 0:
                return operands[0]
            waiting.append(self.leaf().kind)
            operands.append((yield self.unary()))

    def casts(self) -> bool:
        """Whether brackets here hold a type: they begin with a word of one, or hold one name and stars and an operand follows."""
        if self.see(1) in TYPE_WORDS:
            return True
        k = 2
        while self.see(k) == "*":
            k += 1
        return self.see(1) == "identifier" and self.see(k) == ")" and (self.see(k + 1) in _LEAVES or k > 2)

    def unary(self):
        if self.see() in PREFIXES:
            node = self.leaf(f"prefix {self.see()}")
            node.parts.append((yield self.unary()))
            return node
        if self.see() == "(" and self.casts():
            node = self.leaf("cast")
            node.parts.append((yield self.specifiers()))
            node.parts.append((yield self.declarator()))
            self.want(node, ")")
            if self.see() == "{":
                node.parts.append((yield self.initialiser()))
            elif self.see() in _LEAVES or self.see() in PREFIXES or self.see() == "(":
                node.parts.append((yield self.unary()))
            return node
        return (yield self.postfix())

    def postfix(self):
        if self.see() in _LEAVES:
            node = self.leaf()
        elif self.see() == "(":
            node = self.leaf("brackets")
            node.parts.append((yield self.expression()))
            self.want(node, ")")
        else:
            return Node("error", self.at)
        while True:
            kind = self.see()
            if kind in ("++", "--"):
                self.at += 1
                node = Node(f"postfix {kind}", node.token, node)
            elif kind in (".", "->"):
                self.at += 1
                node = Node(kind, node.token, node)
                if self.want(node, "identifier"):
                    node.parts.append(Node("identifier", self.at - 1))
            elif kind == "[":
                self.at += 1
                node = Node("index", node.token, node, (yield self.expression()))
                self.want(node, "]")
            elif kind == "(":
                self.at += 1
                node = Node("call", node.token, node)
                while self.see() not in (")", ""):
                    node.parts.append((yield self.assignment()))
                    if self.see() != ",":
                        break
                    self.at += 1
                self.want(node, ")")
            else:
                return node


_STARTS = frozenset("if while switch for do return goto break continue case default { directive".split())


def parse(found: list[tuple[int, int, str, str]]) -> Node:
    """The tree of a file's tokens."""
    return _finish(Parser(found).file())


def flat(tree: Node) -> list[tuple[str, int, int, int, int]]:
    """(kind, token, depth, parent, end) of the nodes of a tree, each before what it holds; parent is -1 for the file, end the last node within."""
    rows, waiting = [], [(tree, 0, -1)]
    while waiting:
        node, depth, parent = waiting.pop()
        waiting += [(part, depth + 1, len(rows)) for part in reversed(node.parts)]
        rows.append([node.kind, node.token, depth, parent, len(rows)])
    for k in range(len(rows) - 1, 0, -1):
        up = rows[rows[k][3]]
        up[4] = max(up[4], rows[k][4])
    return [tuple(row) for row in rows]


#: Classes of a file's tokens to the columns of its tree, for later files of the same Python worker: renamed code is parsed once.
_TREES: dict[tuple[str, ...], tuple] = {}
_KEPT_NODES = 0
#: Nodes of the trees that are kept, at most.
NODES_KEPT = 1 << 20


def _tree(found: list[tuple[int, int, str, str]]) -> tuple:
    """(token, columns) of the nodes of a file's tree, in depth-first order. A tree depends on the classes of tokens alone."""
    global _KEPT_NODES
    key = tuple(kind for _, _, kind, _ in found)
    held = _TREES.get(key)
    if held is None:
        kind, token, depth, parent, end = zip(*flat(parse(found)), strict=True)
        held = token, {"sym": np.array(symbols(kind)), "depth": np.array(depth), "parent": np.array(parent), "end": np.array(end), "error": np.array([k == "error" for k in kind])}
        if len(token) <= NODES_KEPT >> 8:
            if _KEPT_NODES >= NODES_KEPT:
                _TREES.clear()
                _KEPT_NODES = 0
            _TREES[key] = held
            _KEPT_NODES += len(token)
    return held


def c_read(text: str) -> dict:
    found = cpp_tokens(text)
    token, columns = _tree(found)
    lines, names = [x[0] for x in found], [x[3] for x in found]
    # A node may start behind the last token.
    lines.append(lines[-1] if lines else 1)
    names.append("")
    last = len(found)
    token = [t if t < last else last for t in token]
    return {**columns, "line": [lines[t] for t in token], "name": [names[t] for t in token]}


def c_stream(files: DataFrame, id_col: str, text_col: str = "content") -> DataFrame:
    """(file_id, pos, sym, name, line, depth, parent, end, error): one row per node of each file's tree, in depth-first order. A symbol stands for a node's kind, so renamed code has equal symbols; name and line are those of the token that the node starts at. A null or empty file is one node.

    tokens.register("c", ("c",), c_stream) puts it in the place of the lexer for files of that extension.
    """
    return parsed_stream(files, id_col, text_col, c_read)


def c_arrays(files: DataFrame, id_col: str, columns: tuple[str, ...] = ("syms", "parents", "ends"), text_col: str = "content") -> DataFrame:
    """c_stream() with a row of arrays for each file."""
    return parsed_arrays(files, id_col, text_col, c_read, columns)
