"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .audit import filter_audit, judged
from .common import scratch, tables
from .exact import exact_dedup
from .infill import fill_in_middle, restored
from .licenses import license_scan
from .mixing import mix
from .passages import repeated_passages
from .pieces import encode_decode
from .quality import quality_rules
from .simhash import near_dedup
from .sketches import edited_fingerprints
from .suffixes import repeated_substrings
from .tokenfiles import read_token_files, write_token_files
from .warc import read_archives, resolved, write_archives


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(tables(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fps")[0])), 16, "0").alias("fingerprint"), "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(tables(spark, sf_dir, "documents")).drop("detections")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(tables(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/tokens"
    write_token_files(tables(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path, ids_crc32=F.crc32("ids")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(tables(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(tables(spark, sf_dir, "documents"), digests=True)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(tables(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(tables(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/archives"
    write_archives(tables(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path).where("record_type in ('response', 'revisit')").withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "url", "record_id")
    return resolved(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(judged(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels")))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(tables(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(tables(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_token_files": op5_token_files,
    "op6_repeated_substrings": op6_repeated_substrings,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_warc": op10_warc,
    "op11_filter_audit": op11_filter_audit,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op3_quality_rules": oracles.OP3,
    "op4_repeated_passages": oracles.OP4,
    "op6_repeated_substrings": oracles.OP6,
    "op7_exact_dedup": oracles.OP7,
    "op8_source_mix": oracles.OP8,
    "op10_warc": oracles.OP10,
    "op11_filter_audit": oracles.OP11,
    "op13_fill_in_middle": oracles.OP13,
}
