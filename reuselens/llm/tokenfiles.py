"""Token ids in files of compressed bit planes with a chunk index."""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Chunks, materialise, per_worker, portions, ragged

#: Ids of a block, whose planes are transposed together, and ids after which a chunk is closed at the end of a document.
BLOCK, CHUNK = 4096, 1 << 17
_HEAD = "<4sBBHII"
_MAGIC = b"TKBP"
_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def pack_ids(ids: np.ndarray, block: int = BLOCK, level: int = 3) -> bytes:
    """Header, plane lengths, planes: bit p of every id of every block, highest plane first, each plane a zstandard frame. The last block is padded with zeros."""
    import zstandard

    ids = np.ascontiguousarray(ids, np.uint32)
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    wide = ">u2" if planes <= 16 else ">u4"
    padded = np.zeros(-(-len(ids) // block) * block, wide)
    padded[: len(ids)] = ids
    width = padded.dtype.itemsize
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, width), axis=1)[:, 8 * width - planes :]
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1)
    compress = zstandard.ZstdCompressor(level=level).compress
    frames = [compress(x.tobytes()) for x in packed]
    return b"".join([struct.pack(_HEAD, _MAGIC, 1, planes, 0, block, len(ids)), struct.pack(f"<{planes}I", *map(len, frames)), *frames])


def unpack_ids(data: bytes) -> np.ndarray:
    import zstandard

    magic, version, planes, _, block, n = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a chunk of token ids")
    sizes = struct.unpack_from(f"<{planes}I", data, struct.calcsize(_HEAD))
    at, padded = struct.calcsize(_HEAD) + 4 * planes, -(-n // block) * block
    rows = []
    for size in sizes:
        rows.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, padded // 8)), np.uint8))
        at += size
    if at != len(data):
        raise ValueError("a chunk of token ids has the wrong length")
    if not n:
        return np.empty(0, np.uint32)
    ids = np.zeros(n, np.uint16 if planes <= 16 else np.uint32)
    for row in rows:
        ids = (ids << 1) | np.unpackbits(row, count=n)
    return ids.astype(np.uint32)


class _Encoder:
    """Texts to ids. The byte-level splitter always cuts before a space that other text follows, so the ids of a text are those of its words with the space before each; a word is cut further where the splitter is sure to cut: before marks after a letter, and around a single line end. Distinct parts are encoded once a batch at most, and a table keeps them. Texts with runs of white space that hold a space are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = t = Tokenizer.from_file(path)
        added, splitter = t.get_added_tokens_decoder().values(), t.pre_tokenizer
        self.special = re.compile("|".join(re.escape(x.content) for x in added) or r"(?!)").search
        self.by_word = type(splitter).__name__ == "ByteLevel" and not splitter.add_prefix_space and splitter.use_regex and t.normalizer is None
        self.by_word &= not any(x.lstrip or x.rstrip or x.single_word or " " in x.content or "\n" in x.content for x in added)
        vocabulary = t.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.line_end = vocabulary.get("Ċ", -1)
        self.table = Chunks(self.encode)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def joined(self, parts: list[str], line_ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """As each(), in one call: parts that begin with a space, or words of letters with a line end put between them. A token that begins with a space, or a line end, tells where a part begins."""
        ids, _ = self.each(["\n".join(parts) if line_ends else "".join(parts)])
        if line_ends:
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            lengths = np.diff(ends, prepend=-1) - 1
            ids = ids[ids != self.line_end]
        else:
            lengths = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
        whole = len(lengths) == len(parts) and lengths.sum() == len(ids)
        return (ids, lengths) if whole else self.each(parts)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups: tuple[list[int], ...] = ([], [], [])
        for k, part in enumerate(parts):
            if self.special(part):
                groups[2].append(k)
            elif len(part) > 1 and part[0] == " " and not part[1].isspace() and not part[-1].isspace():
                groups[0].append(k)
            else:
                groups[1 if part.isalpha() else 2].append(k)
        made = [run([parts[k] for k in group]) for run, group in zip((lambda x: self.joined(x, False), lambda x: self.joined(x, True), self.each), groups, strict=True) if group]
        ids, lengths = (np.concatenate(x) for x in zip(*made, strict=True))
        place = np.argsort(np.array([k for group in groups for k in group]))
        return ids[ragged((np.cumsum(lengths) - lengths)[place], lengths[place])], lengths[place]

    def parts(self, space: str, word: str) -> list[str]:
        if word.isalpha() or not word or self.special(word):
            return [space + word] if space or word else []
        head = word.rstrip(_PUNCTUATION)
        if head and len(head) < len(word) and head[-1].isalpha():
            return [*self.parts(space, head), word[len(head) :]]
        if "\n" in word:
            head, _, tail = word.partition("\n")
            if head and tail and "\n" not in tail and not head[-1].isspace() and not tail[0].isspace():
                return [*self.parts(space, head), "\n", *self.parts("", tail)]
        return [space + word]

    def __call__(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text); end_id follows each text."""
        # Texts that are encoded whole count as one part: those with a space before other white space, or at their end.
        whole = np.full(len(texts), not self.by_word)
        while True:
            words = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
            coded = words.flatten().dictionary_encode()
            codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            first = words.offsets.to_numpy()[:-1]
            runs = np.array([not word or word[0].isspace() for word in distinct])[codes]
            runs[first] = False
            runs = np.diff(np.concatenate(([0], np.cumsum(runs)))[words.offsets.to_numpy()]) > 0
            if not runs.any():
                break
            whole |= runs
        alone = whole.tolist()
        found = [self.parts(" ", word) for word in distinct]
        found += [[text] if one else self.parts("", distinct[c]) for one, text, c in zip(alone, texts.to_pylist(), codes[first].tolist(), strict=True)]
        codes[first] = len(distinct) + np.arange(len(texts))
        parts = pa.array([p for some in found for p in some], pa.string()).dictionary_encode()
        ids, start, length = self.table(parts.dictionary)
        # Ids of the parts, then of the words, then of the texts.
        at = parts.indices.to_numpy()
        ids = np.append(ids[ragged(start[at], length[at])], np.uint32(end_id))
        sizes = np.array([len(some) for some in found], np.int64)
        sums = np.concatenate(([0], np.cumsum(length[at])))
        ends = np.cumsum(sizes)
        start, length = sums[ends - sizes], sums[ends] - sums[ends - sizes]
        start, length = np.append(start, len(ids) - 1), np.append(length, 1)
        last = words.offsets.to_numpy()[1:]
        codes = np.insert(codes, last, len(start) - 1)
        sums = np.concatenate(([0], np.cumsum(length[codes])))
        edges = np.concatenate(([0], last + np.arange(1, len(last) + 1)))
        return ids[ragged(start[codes], length[codes])], np.diff(sums[edges])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Writes the ids of every row of docs, each with end_id after it, in ascending doc_id order: to path/chunks, and the index of the chunks to path/index.

    The rows are dealt by range of doc_id to shards and sorted there; each shard becomes one Parquet
    file whose rows are chunks: whole documents up to about CHUNK ids, as planes, with the ids and
    lengths of the documents. The index has a row per chunk, with the number of ids before it. Spark
    commits the files, so a task that is lost and run again leaves one copy.

    Null and empty texts are documents of end_id alone; null ids come first. Rows that repeat a
    doc_id are documents of their own, next to each other. A text is cut at single spaces and taken in
    portions of about 3 MB; one text, however long, lies in one chunk. An empty table gives an empty
    table of chunks and an empty index. Other columns of docs are not read.
    """

    def run(batches):
        encode, shard = per_worker(("byte level", tokenizer_path), lambda: _Encoder(tokenizer_path)), TaskContext.get().partitionId()
        chunk, names, held, lengths, total = 0, [], [], [], 0

        def close():
            payload = pack_ids(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([total], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["shard", "chunk", "n_ids", "doc_ids", "lengths", "planes"],
            )

        for batch in batches:
            for at, texts in portions(batch.column(1)):
                ids, sizes = encode(texts, end_id)
                for doc_id, stop, size in zip(batch.column(0).slice(at, len(texts)).to_pylist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                    held.append(ids[stop - size : stop])
                    names.append(doc_id)
                    lengths.append(size)
                    total += size
                    if total >= CHUNK:
                        yield close()
                        chunk, names, held, lengths, total = chunk + 1, [], [], [], 0
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    chunks = materialise(rows.mapInArrow(run, "shard int, chunk int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, planes binary"), f"{path}/chunks")
    materialise(_starts(chunks), f"{path}/index")


def _starts(chunks: DataFrame) -> DataFrame:
    """Sums of shards, one row each, then of the chunks inside a shard; the planes are not read."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    of_shard = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before(Window.partitionBy(F.lit(0)).orderBy("shard"))), F.lit(0)))
    start = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("shard").orderBy("chunk"))), F.lit(0))
    rows = chunks.select("shard", "chunk", "n_ids", F.size("doc_ids").cast("long").alias("n_docs"), F.col("doc_ids")[0].alias("first_doc"), start.alias("_start"))
    return rows.join(of_shard.select("shard", "_base"), "shard").select("shard", "chunk", (F.col("_base") + F.col("_start")).alias("start"), "n_ids", "n_docs", "first_doc")


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, chunk, start, n_ids, n_docs, first_doc) of every chunk, as it was stored: start is the number of ids before it."""
    return spark.read.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str, **derived: Column) -> DataFrame:
    """(doc_id, start, n_tokens and the derived columns) of every document in the files at path. derived may use ids, a document's ids as little-endian uint32 bytes; without any, ids itself is returned.

    Derived columns are made where a chunk is unpacked, before the join with the stored index. Rows
    that repeat a doc_id come back as often as they were written. Empty files give an empty result.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids(row["planes"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                if len(ids) != row["n_ids"] or (len(ends) and ends[-1] != len(ids)):
                    raise ValueError("a chunk has other ids than its index says")
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(ends), pa.int32()),
                        pa.array([row["chunk"]] * len(ends), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    ["_shard", "_chunk", "doc_id", "_offset", "ids"],
                )

    rows = spark.read.parquet(f"{path}/chunks").mapInArrow(run, "_shard int, _chunk int, doc_id long, _offset long, ids binary")
    derived = derived or {"ids": F.col("ids")}
    rows = rows.select("_shard", "_chunk", "doc_id", "_offset", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *(c.alias(name) for name, c in derived.items()))
    index = chunk_index(spark, path)
    found = rows.join(index, (rows["_shard"] == index["shard"]) & (rows["_chunk"] == index["chunk"]))
    return found.select("doc_id", (F.col("start") + F.col("_offset")).alias("start"), "n_tokens", *derived)
