"""License scan: ordered signature rules behind a keyword prefilter, with priorities and suppression of contained intervals."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import KINDS, RULES

# Fixed values of the contract: phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Bytes that part words, after A to Z were lowered.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32) for c in range(256))


class Rule(NamedTuple):
    order: int
    label: str
    kind: str
    priority: int
    confidence: float
    keyword: bytes
    pattern: bytes


def keyword(pattern: str) -> bytes:
    """The longest run of letters, digits and spaces that every match of a pattern has: what stands outside of groups and classes, and is not optional."""
    plain, inner = pattern, None
    while plain != inner:  # groups from the innermost on
        inner, plain = plain, re.sub(r"\((?:\?:)?[^()]*\)(?:[?*]|\{[^}]*\})?", "|", plain)
    plain = re.sub(r"\[[^\]]*\](?:[?*]|\{[^}]*\})?|.\?", "|", plain)
    return max(plain.split("|"), key=len).strip(" ").encode()


def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first; among equals the order of the table counts."""
    found = []
    for line in RULES.strip().splitlines():
        head, pattern = line.split("  ", 1)
        kind, label = head.split(" ")
        found.append((kind, label, pattern))
    found.sort(key=lambda x: -KINDS[x[0]][0])
    return tuple(Rule(k, label, kind, *KINDS[kind], keyword(x), rb"(?<= )(?:" + x.encode() + rb")(?= )") for k, (kind, label, x) in enumerate(found))


def gates() -> dict[bytes, list[Rule]]:
    """Rules by their keyword. A task builds them once, and compiles what a keyword lets through."""
    by: dict[bytes, list[Rule]] = {}
    for rule in rules():
        by.setdefault(rule.keyword, []).append(rule)
    return by


class Detection(NamedTuple):
    label: str
    kind: str
    priority: int
    confidence: float
    start: int
    stop: int


def normalised(text: bytes) -> bytes:
    """The words of a text with one space before, between and after them."""
    words = text.translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b" "


class Places:
    """Word numbers of byte positions in a normalised text, from the positions of its spaces, which are found once when first asked for."""

    def __init__(self, line: bytes):
        self.line, self.spaces = line, None

    def __call__(self, at: list[int]) -> list[int]:
        """The number of the word that begins after the space at each position."""
        if self.spaces is None:
            self.spaces = np.flatnonzero(np.frombuffer(self.line, np.uint8) == 32)
        return np.searchsorted(self.spaces, at).tolist()


def maximal(found: list[tuple[int, int]]) -> list[bool]:
    """Of intervals in the order in which they are to be taken: whether each is taken, that is, lies within none that was taken before.

    A tree over the starts holds the largest end of the intervals taken so far from the left up to a
    start, so n intervals cost n log n steps.
    """
    starts = {x: k for k, x in enumerate(sorted({a for a, _ in found}), 1)}
    tree, out = [-1] * (len(starts) + 1), []
    for a, z in found:
        k, furthest = starts[a], -1
        while k:
            furthest, k = max(furthest, tree[k]), k & (k - 1)
        out.append(furthest < z)
        k = starts[a]
        while out[-1] and k < len(tree):
            tree[k], k = max(tree[k], z), k + (k & -k)
    return out


def detections(line: bytes, gated: dict[bytes, list[Rule]], compiled: dict[int, re.Pattern], places: Places | None = None) -> list[Detection]:
    """What the rules find in a normalised text, as intervals of words, after suppression.

    A rule runs only if its keyword is in the text. Detections are taken by priority, then by
    length, then by the order of the rules and the start; one whose interval lies within an interval
    that was taken is dropped.
    """
    found = []
    for rule in (rule for keyword, some in gated.items() if keyword in line for rule in some):
        pattern = compiled.get(rule.order) or compiled.setdefault(rule.order, re.compile(rule.pattern))
        found += [(-rule.priority, m.start() - m.end(), rule.order, m.start(), m.end(), rule) for m in pattern.finditer(line)]
    if not found:
        return []
    found.sort(key=lambda x: x[:4])
    words = places or Places(line)
    spans = list(zip(words([x[3] - 1 for x in found]), words([x[4] for x in found]), strict=True))
    return [Detection(x[5].label, x[5].kind, x[5].priority, x[5].confidence, *span) for x, span, taken in zip(found, spans, maximal(spans), strict=True) if taken]


def base_places(line: bytes, places: Places | None = None) -> list[tuple[int, str]]:
    """(start, label) of each place of a phrase in a normalised text, in order."""
    words, found = places or Places(line), []
    for phrase, label in PHRASES.items():
        want, at, some = f" {phrase} ".encode(), -1, []
        while (at := line.find(want, at + 1)) >= 0:
            some.append(at)
        if some:
            found += [(start, label) for start in words(some)]
    return sorted(found)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and detections, an array of (label, kind, start, stop, confidence).

    Words are runs of digits, a to z and characters beyond ASCII, after A to Z were lowered. Each
    document is scanned by itself; nothing is shuffled. The score is 1 minus the product of what the
    confidences of the detections leave over; a text with places of phrases only has what one place
    at 0.5 leaves. Its time is linear in the text and n log n in the detections.

    A null text is an empty one: no words, no labels, score 0. Rows that repeat a doc_id are rows of
    their own, and a null one stays null. Of detections with equal intervals the first in the order
    of the rules stays. An empty table gives an empty result. Other columns of docs are not read.
    """
    kinds = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("confidence", pa.float64())]))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,kind:string,start:bigint,stop:bigint,confidence:double>>"
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]

    def run(batches):
        gated, compiled = gates(), {}
        types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), kinds]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                line = normalised(text.as_py() or b"")
                at = Places(line)
                places, found = base_places(line, at), detections(line, gated, compiled, at)
                labels, left = {label for _, label in places}, 1.0
                for share in [d.confidence for d in found] or [0.5] * bool(places):
                    left *= 1 - share
                rows.append((
                    doc_id, line.count(b" ") - 1, len(places), places[0][0] if places else None, places[-1][0] if places else None,
                    ",".join(sorted(labels)), ",".join(sorted(labels | {d.label for d in found})), 1 - left,
                    [{"label": d.label, "kind": d.kind, "start": d.start, "stop": d.stop, "confidence": d.confidence} for d in sorted(found, key=lambda d: (d.start, d.stop))],
                ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)
