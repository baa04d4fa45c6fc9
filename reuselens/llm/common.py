"""What the operators share: words, normalised texts and tables in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialise, scratch

__all__ = ["SPACES", "Chunks", "Recent", "materialise", "per_worker", "portions", "ragged", "scratch", "spaced", "tables", "text_or_empty", "words_of"]

#: White space of the contracts, as a regular expression that Java and RE2 read alike.
SPACES = r"[\x20\x09-\x0D]+"


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def spaced(text: Column) -> Column:
    """The text with each run of white space as one space."""
    return F.regexp_replace(text, SPACES, " ")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a text without words."""
    line = F.btrim(spaced(text), F.lit(" "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Recent(dict):
    """A table of results by key, made when first asked for. It keeps the keys asked for of late, and counts their bytes: about `limit` bytes at most, whatever the input and however long a key. What it has forgotten is made again, so results do not depend on it."""

    def __init__(self, make, limit: int = 48 << 20):
        self.make, self.limit, self.old, self.held = make, limit // 2, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.held += len(key) + len(value) + 150
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        if len(key) + len(value) < self.limit:
            self[key] = value
        return value


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Chunks:
    """A table of distinct chunks of text and their ids. encode maps a list of chunks to (ids, number of ids of each).

    The table holds `limit` bytes at most, however long a chunk; when it is full it starts again with
    the chunks asked for last. What it has forgotten is encoded again, so results do not depend on it.
    """

    def __init__(self, encode, limit: int = 24 << 20):
        self.encode, self.limit = encode, limit
        self.keys, self.ids, self.lengths = pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def __call__(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): the ids of chunk k are the length[k] ids from start[k] on. chunks are distinct."""
        at = pc.index_in(chunks, value_set=self.keys)
        known = len(self.keys)
        fresh = chunks.filter(at.is_null())
        ids, lengths = self.encode(fresh.to_pylist()) if len(fresh) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = known + np.arange(len(fresh))
        every, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        start = np.cumsum(sizes) - sizes
        if self.keys.nbytes + fresh.nbytes + every.nbytes + sizes.nbytes <= self.limit:
            self.keys, self.ids, self.lengths = pa.concat_arrays([self.keys, fresh]), every, sizes
        elif chunks.nbytes + 8 * len(at) + 4 * int(sizes[at].sum()) <= self.limit:
            self.keys, self.ids, self.lengths = chunks, every[ragged(start[at], sizes[at])], sizes[at]
        return every, start[at], sizes[at]


def portions(column: pa.Array, size: int = 3 << 20):
    """(first, texts) of runs of rows of a text column, each of about size bytes or one row; nulls are empty texts."""
    texts = column.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def per_worker(key: tuple, make):
    """make(), kept for the later tasks of the same Python worker; a new key takes the place of the old one of its kind, key[0]."""
    import sys

    # Functions travel by value, so the module that tasks share is found by its name.
    kept = sys.modules.setdefault("reuselens_worker_tables", type(sys)("reuselens_worker_tables")).__dict__
    if key[0] not in kept or kept[key[0]][0] != key:
        kept[key[0]] = key, make()
    return kept[key[0]][1]
