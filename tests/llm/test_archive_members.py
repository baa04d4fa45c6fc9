"""Archives of several gzip members, as other writers make them."""

import gzip

import pytest

from reuselens.llm import warc


def test_members_are_all_read(spark, tmp_path):
    pages = [b"a" * 100, b"", b"b" * 70_000]
    records = [r + b"\r\n\r\n" for k, p in enumerate(pages) for r in warc.page_records(k, f"u{k}", p, None, False)]
    (tmp_path / "w.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(pages))


def test_members_may_cut_records_anywhere():
    data = b"".join(r + b"\r\n\r\n" for k in range(3) for r in warc.page_records(k, "u", b"x\r\n\r\ny" * 9, None, False))
    whole = list(warc.parse_records(data))
    for size in (7, 50, 333):
        packed = b"".join(gzip.compress(data[k : k + size]) for k in range(0, len(data), size))
        assert list(warc.file_records(packed)) == whole
        with pytest.raises(ValueError):
            list(warc.file_records(packed[:-9]))
