"""Codecs of stored blobs: delta coding, compressors, choice by size, and the ratio report."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The dictionary of LZMA at preset 5.
_DICTIONARY = 8 << 20


def _lzma(data: bytes) -> bytes:
    """Preset 5 with a dictionary no larger than the data can fill: the tables of the whole one take longer to set up than a short blob to pack."""
    room = min(_DICTIONARY, max(4096, 1 << (len(data) - 1).bit_length()))
    return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 5, "dict_size": room}])


#: Codec to its number in a frame, and what packs and unpacks.
CODECS = {"none": (0, lambda b: b, lambda b: b), "lzma": (1, _lzma, lzma.decompress), "zlib": (2, lambda b: zlib.compress(b, 9), zlib.decompress), "bz2": (3, bz2.compress, bz2.decompress)}
MODIFIERS = {"none": 0, "delta": 1}
#: Bytes of frames from which a task hands them on.
PORTION = 4 << 20


def delta_encode(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """value becomes its difference to the value before, modulo 256; the first stays."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn(value, (F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))).bitwiseAND(255))


def delta_decode(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.sum(value).over(w).bitwiseAND(255))


def _delta(data: bytes) -> bytes:
    return np.diff(np.frombuffer(data, np.uint8), prepend=np.uint8(0)).tobytes()


def _undelta(data: bytes) -> bytes:
    return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint8).tobytes()


def pack(data: bytes, codec: str, modifier: str = "none") -> bytes:
    """12 bytes of codec, modifier and size before the payload, padded to 4 bytes; without codec and modifier the data alone."""
    if codec == "none" and modifier == "none":
        return data
    body = CODECS[codec][1](_delta(data) if modifier == "delta" else data)
    frame = struct.pack("<III", CODECS[codec][0], MODIFIERS[modifier], len(data)) + body
    return frame + b"\0" * (-len(frame) % 4)


def unpack(frame: bytes) -> bytes:
    """The inverse of pack for frames with a header."""
    number, modifier, size = struct.unpack_from("<III", frame)
    name = next(k for k, v in CODECS.items() if v[0] == number)
    body = frame[12:]
    if name == "lzma":
        data = lzma.LZMADecompressor().decompress(body)
    elif name == "zlib":
        data = zlib.decompressobj().decompress(body)
    elif name == "bz2":
        data = bz2.BZ2Decompressor().decompress(body)
    else:
        data = body[:size]
    return (_undelta(data) if modifier else data)[:size]


def _dealt(blobs: DataFrame) -> DataFrame:
    """(id, data) of blobs, dealt to tasks by id: packing takes far longer than moving, and a file may have most blobs in one piece."""
    return blobs.select(F.col("id").cast("long").alias("id"), "data").repartition("id")


def sizes(blobs: DataFrame, codecs: tuple[str, ...] = ("none", "zlib", "lzma"), modifiers: tuple[str, ...] = ("none",)) -> DataFrame:
    """(id, codec, modifier, original, packed) for blobs (id, data) under every choice. Blobs are taken from their batch one by one, so a task holds one copy at a time."""
    choices = [(c, m) for c in codecs for m in modifiers]

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0), batch.column(1), strict=True):
                d = data.as_py()
                rows += [(i.as_py(), c, m, len(d), len(pack(d, c, m))) for c, m in choices]
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["id", "codec", "modifier", "original", "packed"])

    return _dealt(blobs).mapInArrow(run, "id long, codec string, modifier string, original long, packed long")


def frames(blobs: DataFrame, codec: str, modifier: str = "none") -> DataFrame:
    """(id, frame) of blobs (id, data), packed. Frames leave a task as PORTION bytes and a blob at most."""

    def run(batches):
        for batch in batches:
            first, packed, size = 0, [], 0
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_py()
                packed.append(pack(data, codec, modifier))
                size += len(packed[-1])
                if size >= PORTION or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k + 1 - first), pa.array(packed, pa.binary())], ["id", "frame"])
                    first, packed, size = k + 1, [], 0

    return blobs.select(F.col("id").cast("long").alias("id"), "data").mapInArrow(run, "id long, frame binary")


def frame_headers(packed: DataFrame) -> DataFrame:
    """packed (id, frame, ...) with codec, modifier and original, the numbers that a frame begins with; contents are not unpacked."""
    # Numbers are stored with their lowest byte first.
    number = lambda at: F.conv(F.concat(*(F.hex(F.substring("frame", at + k, 1)) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    return packed.withColumn("codec", number(1)).withColumn("modifier", number(5)).withColumn("original", number(9))


def round_trips(blobs: DataFrame, codecs: tuple[str, ...] = tuple(CODECS), modifiers: tuple[str, ...] = tuple(MODIFIERS)) -> DataFrame:
    """(id, codec, modifier, original, same) for blobs (id, data): whether every choice gives the data back."""
    choices = [(c, m) for c in codecs for m in modifiers]

    def run(batches):
        for batch in batches:
            rows = []
            for i, data in zip(batch.column(0), batch.column(1), strict=True):
                d = data.as_py()
                rows += [(i.as_py(), c, m, len(d), (d if c == m == "none" else unpack(pack(d, c, m))) == d) for c, m in choices]
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["id", "codec", "modifier", "original", "same"])

    return _dealt(blobs).mapInArrow(run, "id long, codec string, modifier string, original long, same boolean")


def choose(found: DataFrame, force: str | None = None) -> DataFrame:
    """(id, codec, modifier, original, packed) of the smallest, or of the forced codec however large; ties by name."""
    if force:
        found = found.where(F.col("codec") == force)
    return found.groupBy("id").agg(F.min(F.struct("packed", "codec", "modifier", "original")).alias("x")).select("id", "x.codec", "x.modifier", "x.original", "x.packed")


def ratio_report(found: DataFrame) -> DataFrame:
    """(codec, n, original, packed, per_mille) over all blobs."""
    return found.groupBy("codec").agg(F.count("*").alias("n"), F.sum("original").alias("original"), F.sum("packed").alias("packed")).withColumn("per_mille", F.expr("if(original = 0, 0L, packed * 1000 div original)"))
