"""Git packs on disk as DataFrames: their objects, with chains of deltas resolved, and the files of their commits."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialise

# Kinds of entries of a pack, fixed by its format; 6 and 7 are deltas against an offset and an object id.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "offset delta", 7: "id delta"}
#: Bytes of contents that are handed on at a time.
BATCH = 16 << 20


def _inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """A stream of compressed bytes, and where it ends."""
    found, out = zlib.decompressobj(), []
    while not found.eof:
        piece = data[at : at + 65536]
        if not piece:
            raise ValueError("a pack ends within an entry")
        out.append(found.decompress(piece))
        at += len(piece) - len(found.unused_data)
    return b"".join(out), at


def entries(data: bytes) -> Iterator[tuple[int, str, int | None, str | None, bytes]]:
    """(offset, kind, offset of the base, id of the base, content) of every entry of a pack."""
    if data[:4] != b"PACK":
        raise ValueError("not a pack")
    view, at = memoryview(data), 12
    for _ in range(int.from_bytes(data[8:12], "big")):
        start, byte = at, view[at]
        kind = KINDS[byte >> 4 & 7]
        at += 1
        while byte & 128:  # the size, which the stream tells as well
            byte = view[at]
            at += 1
        base = name = None
        if kind == "offset delta":
            byte = view[at]
            back = byte & 127
            at += 1
            while byte & 128:
                byte = view[at]
                back = (back + 1 << 7) | byte & 127
                at += 1
            base = start - back
        elif kind == "id delta":
            name = bytes(view[at : at + 20]).hex()
            at += 20
        content, at = _inflated(view, at)
        yield start, kind, base, name, content


def patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: stretches of the base, and bytes of its own."""

    def size(at):
        n = shift = 0
        while True:
            byte = delta[at]
            n |= (byte & 127) << shift
            shift, at = shift + 7, at + 1
            if byte < 128:
                return n, at

    _, at = size(0)
    n, at = size(at)
    out = []
    while at < len(delta):
        code = delta[at]
        at += 1
        if code & 128:
            start = length = 0
            for k in range(4):
                if code >> k & 1:
                    start |= delta[at] << 8 * k
                    at += 1
            for k in range(3):
                if code >> 4 + k & 1:
                    length |= delta[at] << 8 * k
                    at += 1
            out.append(base[start : start + (length or 65536)])
        else:
            out.append(delta[at : at + code])
            at += code
    made = b"".join(out)
    if len(made) != n:
        raise ValueError("a delta that does not fit its base")
    return made


def _named(rows: DataFrame) -> DataFrame:
    """rows (pack, at, kind, data) with sha, the object's id."""
    head = F.concat(F.col("kind"), F.lit(" "), F.octet_length("data").cast("string")).cast("binary")
    return rows.select("pack", "at", "kind", F.sha1(F.concat(head, F.unhex(F.lit("00")), F.col("data"))).alias("sha"), "data")


def pack_objects(spark: SparkSession, path: str) -> DataFrame:
    """(pack, at, kind, sha, data) of all objects in the packs below path. A pack is read by one task; what is in it is resolved by all of them: each round patches the deltas whose bases are known, so there are as many rounds as the longest chain has links. A delta whose base is in no pack is left out."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content, strict=True):
                rows, held = [], 0
                for entry in entries(bytes(data)):
                    rows.append((name, *entry))
                    held += len(entry[-1])
                    if held >= BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    columns = ["pack", "at", "kind", "base", "base_sha", "data"]
    packs = spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").option("recursiveFileLookup", True).load(path)
    raw = materialise(packs.select("path", "content").mapInPandas(run, "pack string, at long, kind string, base long, base_sha string, data binary"))

    @F.pandas_udf("binary")
    def patch(base: pd.Series, delta: pd.Series) -> pd.Series:
        return pd.Series([patched(b, d) for b, d in zip(base, delta, strict=True)])

    found = fresh = materialise(_named(raw.where("base is null and base_sha is null").select("pack", "at", "kind", "data")))
    near, far = raw.where("base is not null"), raw.where("base_sha is not null")
    while not fresh.isEmpty():
        bases = fresh.select(F.col("pack").alias("_pack"), F.col("at").alias("_at"), F.col("kind").alias("_kind"), F.col("sha").alias("_sha"), F.col("data").alias("_data"))
        by_place = near.join(bases, (F.col("pack") == F.col("_pack")) & (F.col("base") == F.col("_at")))
        by_name = far.join(bases.dropDuplicates(["_sha"]), F.col("base_sha") == F.col("_sha"))
        both = [x.select("pack", "at", F.col("_kind").alias("kind"), patch("_data", "data").alias("data")) for x in (by_place, by_name)]
        fresh = materialise(_named(both[0].unionByName(both[1])).join(found.select("pack", "at"), ["pack", "at"], "left_anti"))
        found = materialise(found.unionByName(fresh))
    return found


def tree_entries(objects: DataFrame) -> DataFrame:
    """(tree, mode, name, sha) of the trees among pack_objects()."""

    def run(batches):
        for pdf in batches:
            rows = []
            for tree, data in zip(pdf.sha, pdf.data, strict=True):
                at = 0
                while at < len(data):
                    space, end = data.index(b" ", at), data.index(b"\0", at)
                    rows.append((tree, data[at:space].decode(), data[space + 1 : end].decode("utf-8", "replace"), data[end + 1 : end + 21].hex()))
                    at = end + 21
            yield pd.DataFrame(rows, columns=["tree", "mode", "name", "sha"])

    trees = objects.where("kind = 'tree'").dropDuplicates(["sha"]).select("sha", "data")
    return trees.mapInPandas(run, "tree string, mode string, name string, sha string")


def commit_files(objects: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """(commit, path, sha, content) of the files of the commits (sha) among pack_objects(), all of them by default. Trees are opened level by level, so there are as many rounds as folders are deep; links and submodules are left out."""
    kept = materialise(tree_entries(objects))
    text = F.decode("data", "UTF-8")
    some = objects.where("kind = 'commit'").dropDuplicates(["sha"]).select(F.col("sha").alias("commit"), F.regexp_extract(text, "^tree ([0-9a-f]{40})", 1).alias("tree"))
    some = some if commits is None else some.join(commits.select(F.col("sha").alias("commit")).distinct(), "commit", "left_semi")
    open_, found = materialise(some.withColumn("folder", F.lit(""))), None
    while not open_.isEmpty():
        inside = materialise(open_.join(kept, "tree").select("commit", F.concat("folder", "name").alias("path"), "mode", "sha"))
        files = inside.where("mode like '100%'").select("commit", "path", "sha")
        found = files if found is None else found.unionByName(files)
        open_ = inside.where("mode = '40000'").select("commit", F.col("sha").alias("tree"), F.concat("path", F.lit("/")).alias("folder"))
    blobs = objects.where("kind = 'blob'").dropDuplicates(["sha"]).select("sha", F.col("data").alias("content"))
    return objects.select(F.lit("").alias("commit"), F.lit("").alias("path"), "sha", F.col("data").alias("content")).limit(0) if found is None else found.join(blobs, "sha").select("commit", "path", "sha", "content")
