"""Files, archives, dumps and JSON as DataFrames."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import blocks, decode_entities, extension
from ..model import MAX_BYTES, REPO
from ..operators.tokens import DEEP, FILE_TYPES, HANDLERS, deep_arrays


def file_types(spark: SparkSession) -> DataFrame:
    """(ext, source_type): a small fixed table."""
    return spark.createDataFrame(sorted(FILE_TYPES.items()), "ext string, source_type string")


def typed(files: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """files (path, content) of a known type and of max_bytes at most, with source_type; None for files of any size. skipped() tells what is left out."""
    kinds = F.create_map(*(F.lit(x) for pair in sorted(FILE_TYPES.items()) for x in pair))
    files = files if max_bytes is None else files.where(F.octet_length("content") <= max_bytes)
    return files.withColumn("source_type", F.try_element_at(kinds, extension(F.col("path")))).where("source_type is not null")


def skipped(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, bytes) of the files below path that scan_path leaves out for their size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.col("length") > max_bytes).select("path", F.col("length").alias("bytes"))


def scan_path(spark: SparkSession, path: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, content, source_type) of the supported files below path; larger files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files if max_bytes is None else files.where(F.col("length") <= max_bytes)
    return typed(files.select("path", F.decode("content", "UTF-8").alias("content")), max_bytes)


def scan_buffers(spark: SparkSession, buffers: dict[str, str], max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, content, source_type) of the supported buffers of max_bytes at most; oversized() tells what is left out."""
    return typed(spark.createDataFrame(list(buffers.items()), "path string, content string"), max_bytes)


def scan_sizes(files: DataFrame) -> DataFrame:
    """(path, source_type, res_size) of scanned files: the bytes of their symbols, four each."""
    counts = streams(files).groupBy("file_id").agg((4 * F.count("*")).alias("res_size"))
    named = files.select(F.xxhash64("path").alias("file_id"), "path", "source_type")
    return named.join(counts, "file_id", "left").select("path", "source_type", F.coalesce("res_size", F.lit(0)).alias("res_size"))


def scan_deep(files: DataFrame) -> DataFrame:
    """(file_id, path, source_type, syms, names, lines) of scanned files: the deep mode keeps the text and the line of each symbol."""
    columns, keep = ("file_id", "path", "source_type", "syms", "names", "lines"), ("path", "source_type")
    out = None
    for source_type, handler in HANDLERS.items():
        some = files.where(F.col("source_type") == source_type).select(F.xxhash64("path").alias("file_id"), *keep, "content")
        if source_type in DEEP:
            made = DEEP[source_type](some, "file_id", keep=keep)
        else:
            made = deep_arrays(handler(some, "file_id")).join(some.select("file_id", *keep), "file_id")
        out = made.select(*columns) if out is None else out.unionByName(made.select(*columns))
    return out


def streams(files: DataFrame) -> DataFrame:
    """(file_id, pos, sym, name, line, depth, parent, end, error, source_type) of files, by the handler of their type. file_id is the path's hash."""
    out = None
    for source_type, handler in HANDLERS.items():
        some = files.where(F.col("source_type") == source_type).select(F.xxhash64("path").alias("file_id"), "content")
        made = handler(some, "file_id").withColumn("source_type", F.lit(source_type))
        out = made if out is None else out.unionByName(made)
    return out


def oversized(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, bytes) of the files (path, content) that typed() and scan_buffers() leave out for their size."""
    return files.where(F.octet_length("content") > max_bytes).select("path", F.octet_length("content").cast("long").alias("bytes"))


def zip_entries(archives: DataFrame) -> DataFrame:
    """(archive, path, bytes) of all files in archives (path, content binary), by their directories; nothing is unpacked. Those of more than max_bytes are what unzip() leaves out."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    some = [i for i in z.infolist() if not i.is_dir()]
                    yield pd.DataFrame({"archive": [name] * len(some), "path": [i.filename for i in some], "bytes": [i.file_size for i in some]})

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, bytes long")


def unzip(archives: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(archive, path, content) of the files in archives (path, content binary) of max_bytes at most, or of any size; each file is a row of its own. zip_entries() tells what is left out."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for info in z.infolist():
                        if not info.is_dir() and (max_bytes is None or info.file_size <= max_bytes):
                            yield pd.DataFrame({"archive": [name], "path": [info.filename], "content": [z.read(info).decode("utf-8", "replace")]})

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, content string")


def zips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)


def scan_zips(spark: SparkSession, path: str, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """The supported files in the archives below path, of max_bytes at most; skipped_zips() tells what is left out."""
    return typed(unzip(zips(spark, path), max_bytes), max_bytes)


def skipped_zips(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(archive, path, bytes) of the files that scan_zips leaves out for their size."""
    return zip_entries(zips(spark, path)).where(F.col("bytes") > max_bytes)


def dump_posts(spark: SparkSession, path: str) -> DataFrame:
    """(snippet_id, date, licence, body) of a posts dump, one XML row per post and line, which is the format. Lines are read as text, so a dump of any size is split over many tasks; what is not a row is passed over."""
    schema = "_Id bigint, _CreationDate string, _ContentLicense string, _Body string"
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*<row\s"))
    rows = lines.select(F.from_xml("value", schema, {"rowTag": "row"}).alias("r")).select("r.*")
    return rows.select(F.col("_Id").alias("snippet_id"), F.col("_CreationDate").alias("date"), F.coalesce("_ContentLicense", F.lit("")).alias("licence"), F.coalesce("_Body", F.lit("")).alias("body"))


def dump_snippets(posts: DataFrame, tag: str = "code") -> DataFrame:
    """(snippet_id, date, licence, code): the blocks of the posts, entities decoded; empty ones are dropped."""
    rows = posts.select("snippet_id", "date", "licence", F.explode(blocks(F.col("body"), tag)).alias("code"))
    return rows.withColumn("code", decode_entities(F.col("code"))).where("code <> ''")


def convert_dump(spark: SparkSession, xml_path: str, out_path: str) -> None:
    rows = dump_snippets(dump_posts(spark, xml_path))
    rows.withColumn("id", F.xxhash64("snippet_id", "code")).select("id", "snippet_id", "date", "licence", "code").write.mode("append").parquet(out_path)


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repository records, one JSON object per line."""
    return spark.read.schema(REPO).json(path)


def repo_to_json(repos: DataFrame) -> DataFrame:
    return repos.select("full_name", F.to_json(F.struct(*repos.columns)).alias("json"))


def repo_from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", REPO).alias("r")).select("r.*")


def refs(rows: DataFrame) -> DataFrame:
    """(repo, tag, sha, annotated) of rows (repo, json) that hold an array of refs; an annotated tag's sha is that of the tag object and is still to be resolved."""
    kind = "array<struct<ref:string,object:struct<sha:string,type:string>>>"
    each = rows.select("repo", F.explode(F.from_json("json", kind)).alias("r")).where(F.col("r.ref").startswith("refs/tags/"))
    return each.select("repo", F.expr("substring(r.ref, 11)").alias("tag"), F.col("r.object.sha").alias("sha"), (F.col("r.object.type") == "tag").alias("annotated"))
