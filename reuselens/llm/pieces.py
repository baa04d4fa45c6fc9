"""SentencePiece encoding and decoding over a table of distinct marked words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunks, per_worker, portions, ragged

_MARK = "▁"
_RUNS = re.compile(" +[^ ]*")


def marked_words(text: str) -> list[str]:
    """The words of a text, each without the first of the spaces before it. The text has one space in front, as the model adds it."""
    text = text.replace(_MARK, " ")
    if "  " in text or text.startswith(" "):
        return [x[1:] for x in _RUNS.findall(" " + text)]
    return text.split(" ")


def crossing_pieces(model) -> list[str]:
    """Pieces with a marker after another character: with any, words could not be segmented one by one."""
    return [p for p in map(model.id_to_piece, range(model.get_piece_size())) if re.search(f"[^{_MARK}]{_MARK}", p) and not (model.is_control(model.piece_to_id(p)) or model.is_unknown(model.piece_to_id(p)))]


class _Encoder:
    """Texts to ids and back, over a table of the distinct marked words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = bool(crossing_pieces(m)) or m.encode("a b") != m.encode("a") + m.encode("b")
        self.lone, self.guard = m.piece_to_id(_MARK), m.piece_to_id("a")
        self.table = Chunks(self.segment)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word). The first id of each word is preceded by one that says whether its ids decode to the word itself."""
        found = [ids or [self.lone] for ids in self.model.encode(words, num_threads=1)]
        back = self.model.decode([[self.guard, *ids] for ids in found], num_threads=1)
        flat = [i for ids, text, word in zip(found, back, words, strict=True) for i in (text[1:] == f" {word}", *ids)]
        return np.array(flat, np.uint32), np.array([len(ids) + 1 for ids in found], np.int64)

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids, number of ids of each text, decoded texts)."""
        if self.whole:
            found = self.model.encode(texts.to_pylist(), num_threads=1)
            return np.array([i for ids in found for i in ids], np.int32), np.array([len(x) for x in found], np.int64), self.model.decode(found, num_threads=1)
        words, counts = self.words(texts)
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        ids, start, length = self.table(distinct)
        same, start, length = ids[start].astype(bool), start + 1, length - 1
        edges = np.concatenate(([0], np.cumsum(counts)))
        sums = np.concatenate(([0], np.cumsum(length[codes])))
        changed = np.concatenate(([0], np.cumsum(~same[codes])))
        decoded = texts.to_pylist()
        # A text whose words all decode to themselves does so too.
        other = np.flatnonzero((np.diff(changed[edges]) > 0) | pc.match_substring(texts, _MARK).to_numpy(zero_copy_only=False)).tolist()
        if other:
            some = np.unique(np.concatenate([codes[edges[k] : edges[k + 1]] for k in other]))
            back = dict(zip(some.tolist(), self.model.decode([[self.guard, *ids[start[c] : start[c] + length[c]].tolist()] for c in some.tolist()], num_threads=1), strict=True))
            for k in other:
                decoded[k] = "".join([back[c][1:] for c in codes[edges[k] : edges[k + 1]].tolist()])[1:]
        return ids[ragged(start[codes], length[codes])].view(np.int32), np.diff(sums[edges]), decoded

    def words(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The marked words of the texts, and how many each text has."""
        plain = pc.replace_substring(texts, _MARK, " ")
        odd = pc.or_(pc.match_substring(plain, "  "), pc.starts_with(plain, " "))
        if not pc.any(odd).as_py():
            lists = pc.split_pattern(plain, " ")
        else:
            split = pc.split_pattern(plain, " ").to_pylist()
            lists = pa.array([marked_words(text) if o else found for text, o, found in zip(plain.to_pylist(), odd.to_pylist(), split, strict=True)], pa.list_(pa.string()))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if empty.any():  # an empty text has no words, where the split gives one
            lists = lists.filter(pa.array(~empty))
            counts[empty] = 0
        return lists.flatten(), counts


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, ids (array<int>), decoded and the columns keep. No begin or end ids, no sampling.

    In this kind of model no piece crosses from a character to a later space marker, so a text's ids
    are those of its marked words in order. Each batch of texts is taken as its marked words, by
    position, and a table of the distinct ones: a distinct word is segmented once, whatever its
    number, and the ids are joined back to all its positions. A worker keeps what it has segmented,
    bounded in bytes. A word whose ids decode to itself needs no decoding again. Nothing is
    shuffled. A model with pieces that do cross is encoded text by text.

    A null or empty text has no ids and decodes to an empty one. Rows that repeat a doc_id are rows of
    their own. Texts are taken in portions of about 3 MB, or one text, however long. An empty table
    gives an empty result. model_path names a file on every executor.
    """

    def run(batches):
        encode = per_worker(("pieces", model_path), lambda: _Encoder(model_path))
        for batch in batches:
            for at, texts in portions(batch.column(1)):
                ids, lengths, decoded = encode(texts)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(decoded, pa.string()), *part.columns[2:]], ["doc_id", "ids", "decoded", *part.schema.names[2:]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *keep)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"doc_id long, ids array<int>, decoded string{kinds}")
