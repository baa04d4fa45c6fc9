"""WARC archives: records with revisits and segments are written, read back, reassembled and decoded."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch

#: Bytes of a record's block; a longer one goes on in continuation records. With RECORDS it bounds a file.
SEGMENT, RECORDS = 32 << 10, 1000
#: Bytes of a chunk of the transfer coding.
CHUNK = 8 << 10
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


#: A gzip member without data. The text writer puts it after each line, here the member of a record; readers pass over it.
_EMPTY = bytes.fromhex("1f8b0800000000000003") + b"\x03" + bytes(9)
_OWN_ID = re.compile(r"<urn:page:(-?\d*):[A-Z2-7]{32}(?:/\d+)?>")


def record_id(page_id: int | None, digest: str) -> str:
    """An id that the page and its payload decide, so only equal records share it."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer coding."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; a ValueError if the framing is broken."""
    at, parts = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def _record(kind: str, own: str, block: bytes, **headers: str) -> bytes:
    """A record without the two line ends after it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {_DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + _END + block


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, segment: int = SEGMENT) -> list[bytes]:
    """The records of a page: a revisit, or a response and its continuations."""
    name = digest32(payload)
    own, digest = record_id(page_id, name), f"sha1:{name}"
    url = None if url is None else "".join(c for c in url if c not in "\r\n")
    if revisit:
        return [_record("revisit", own, b"", WARC_Target_URI=url, WARC_Payload_Digest=digest, WARC_Profile=_PROFILE, WARC_Refers_To=record_id(refers_to, name))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    http = "application/http; msgtype=response"
    if len(parts) == 1:
        return [_record("response", own, block, WARC_Target_URI=url, WARC_Payload_Digest=digest, Content_Type=http)]
    records = [_record("response", own, parts[0], WARC_Target_URI=url, WARC_Payload_Digest=digest, Content_Type=http, WARC_Segment_Number="1")]
    for k, part in enumerate(parts[1:], 2):
        total = str(len(block)) if k == len(parts) else None
        records.append(_record("continuation", f"{own[:-1]}/{k}>", part, WARC_Target_URI=url, WARC_Segment_Origin_ID=own, WARC_Segment_Number=str(k), WARC_Segment_Total_Length=total))
    return records


def parse_records(data: bytes):
    """(headers, block) of each record of an archive; header names in lower case."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(_END, at)
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start = end + len(_END)
        stop = start + int(headers["content-length"])
        if data[stop : stop + len(_END)] != _END:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield headers, data[start:stop]
        at = stop + len(_END)


def members(content: bytes):
    """The decoded data of each gzip member of a file, in order; the file itself if it is not compressed; a ValueError if the last member is cut off."""
    if content.startswith(b"WARC/"):
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        part, data = zlib.decompressobj(31), []
        while at < len(view) and not part.eof:
            data.append(part.decompress(view[at : at + CHUNK]))
            at = min(at + CHUNK, len(view)) - len(part.unused_data)
        if not part.eof:
            raise ValueError("the last member of an archive is cut off")
        yield b"".join(data)
        while at < len(view) and not view[at]:  # zeros after a member are padding
            at += 1


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def file_records(content: bytes):
    """(headers, block) of each record of an archive. A record may go over the ends of members."""
    rest: list[bytes] = []
    for data in members(content):
        rest.append(data)
        if data.endswith(_END):
            try:
                found = list(parse_records(b"".join(rest)))
            except (ValueError, IndexError):
                continue  # the block of a record holds this end
            yield from found
            rest = []
    yield from parse_records(b"".join(rest))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, segment: int = SEGMENT) -> None:
    """Writes a record per row of pages to archives at path, each record a gzip member of its own, a warcinfo record at the head of each file.

    Of rows with equal payloads of at least `least` bytes the smallest page_id is the response and
    the others are revisits; smaller payloads are all responses. The groups form on digests; a
    payload is shuffled once at most, to the page its group keeps, where a large group can be split.
    Payloads are UTF-8 text, null counts as empty. A null page_id is a response only where its group
    has no other. Rows that repeat the page_id of a response are responses too; equal rows give equal
    records. A payload longer than a segment goes on in continuations, whatever its length. An empty
    table gives no records. Other columns of pages are not read.
    """

    def run(batches):
        n = 0
        info = member(_record("warcinfo", f"<urn:reuselens:{TaskContext.get().partitionId()}>", b"format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields") + _END)

        def lines(out):
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

        for batch in batches:
            out = []
            for page_id, url, html, keep in zip(*batch.columns, strict=True):
                page_id, keep, payload = page_id.as_py(), keep.as_py(), html.as_py() or b""
                for record in page_records(page_id, url.as_py(), payload, keep, len(payload) >= least and keep != page_id, segment):
                    if n % RECORDS == 0:
                        out.append(info)
                        n += 1
                    out.append(member(record + _END))
                    n += 1
                if len(out) >= 256:
                    yield lines(out)
                    out = []
            if out:
                yield lines(out)

    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("html"))
    keyed = rows.withColumn("_key", F.concat(F.sha2("html", 256), F.octet_length("html").cast("string")))
    first = materialise(keyed.groupBy("_key").agg(F.min("page_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_keep"), f"{scratch(spark)}/groups")
    records = keyed.join(first, "_key", "left").select("page_id", "url", "html", F.when(F.col("_keep").isNull(), F.col("page_id")).otherwise(F.col("_keep")).alias("_keep"))
    lines = records.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    # The lines are gzip members, which the writer takes as they are; what it puts after each is an empty member.
    lines.write.mode("overwrite").option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", RECORDS).text(path)


def _assembled(origin: str, headers: dict, block: bytes) -> bytes:
    """The payload of a whole response; a ValueError if it does not have the digest it names."""
    head, _, body = block.partition(_END)
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if (named := headers.get("warc-payload-digest")) and named != f"sha1:{digest32(payload)}":
        raise ValueError(f"{origin}: the payload does not have its digest")
    return payload


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_id, url, record_type, refers_to, payload, payload_digest) of the records at path, one row each; a revisit's payload is null. page_id and refers_to are null for ids that write_archives did not make. Records that are no captures, as warcinfo and request, keep their block as payload.

    A file is one row, so it may have 2 GB; those of write_archives have RECORDS records of SEGMENT
    bytes at most. Files may be gzipped, as one member or many, or not. Records that are whole are
    decoded where they are parsed. Only segments are shuffled, to the task of their origin identifier
    and address, where they are put in order of their numbers; a gap, a missing last segment or a wrong
    total length is an error. Segments that are repeated as a whole are counted before they are
    shuffled and give as many rows. An empty folder of files gives an empty result.
    """
    names = ["origin", "number", "total", "page_id", "record_id", "url", "record_type", "refers_to", "payload_digest", "data"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = "origin string, number int, total long, page_id long, record_id string, url string, record_type string, refers_to long, payload_digest string, data binary"

    def page(own: str | None) -> int | None:
        found = _OWN_ID.fullmatch(own or "")
        return int(found[1]) if found and found[1] else None

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for h, block in file_records(content.as_py()):
                    kind, own, number = h["warc-type"], h["warc-record-id"], h.get("warc-segment-number")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response" and number is None:
                        block = _assembled(own, h, block)
                    origin = h.get("warc-segment-origin-id", own) if number else None
                    total = h.get("warc-segment-total-length")
                    out.append((origin, number and int(number), total and int(total), page(own), own, h.get("warc-target-uri"), kind, page(h.get("warc-refers-to")), digest, None if kind == "revisit" else block))
                    if len(out) >= 256:
                        yield rows(out)
                        out = []
                if out:
                    yield rows(out)

    def join(batches):
        held: list[dict] = []

        def close():
            first, last = held[0], held[-1]
            block = b"".join(x["data"] for x in held)
            if [x["number"] for x in held] != list(range(1, len(held) + 1)) or last["total"] != len(block) or len({x["copies"] for x in held}) > 1:
                raise ValueError(f"{first['origin']}: segments are missing or have the wrong length")
            payload = _assembled(first["origin"], {"warc-payload-digest": f"sha1:{first['payload_digest']}"} if first["payload_digest"] else {}, block)
            out = rows([(None, None, None, first["page_id"], first["record_id"], first["url"], first["record_type"], None, first["payload_digest"], payload)])
            return pa.RecordBatch.from_arrays([*out.columns, pa.array([first["copies"]], pa.int64())], [*names, "copies"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[-1]["origin"], held[-1]["url"]) != (row["origin"], row["url"]):
                    yield close()
                    held.clear()
                held.append(row)
        if held:
            yield close()

    files = spark.read.format("binaryFile").load(path).select("content")
    records = materialise(files.mapInArrow(parse, schema), f"{scratch(spark)}/records")
    others = [n for n in names if n != "data"]
    parts = records.where("origin is not null").groupBy(*others, F.sha2("data", 256).alias("_key")).agg(F.first("data").alias("data"), F.count("*").alias("copies")).select(*names, "copies")
    parts = parts.repartition("origin", "url").sortWithinPartitions("origin", "url", "number").mapInArrow(join, f"{schema}, copies long")
    parts = parts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*names)
    whole = records.where("origin is null").unionByName(parts)
    return whole.select("page_id", "record_id", "url", "record_type", "refers_to", F.col("data").alias("payload"), "payload_digest")


def resolved(records: DataFrame) -> DataFrame:
    """records with the payload_bytes of revisits taken from the responses that they refer to, by page and digest; a revisit whose response is missing is an error.

    records has page_id, record_type, refers_to, payload_bytes and payload_digest. Payloads are not
    needed. A null refers_to is the response whose page_id is null. An empty table gives an empty result.
    """
    at = scratch(records.sparkSession)
    records = materialise(records, f"{at}/read")
    again = records.where("record_type = 'revisit'")
    # One row per response that is referred to, so both sides are shuffled for the join and a response with many revisits can be split.
    full = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.first("payload_bytes").alias("_bytes"))
    full = materialise(full, f"{at}/responses")
    again = again.join(full, again["refers_to"].eqNullSafe(full["_id"]) & (again["payload_digest"] == full["_digest"]), "left")
    missing = F.raise_error(F.lit("a revisit refers to a response that is not there or has another digest"))
    again = again.withColumn("payload_bytes", F.coalesce("_bytes", missing.cast("long")))
    return records.where("record_type <> 'revisit'").unionByName(again.select(*records.columns))
