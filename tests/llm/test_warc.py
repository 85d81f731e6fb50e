"""Archive round trips."""

import hashlib
import uuid

import pytest

from wxframe.llm import warc
from wxframe.session import ensure_checkpoint_dir

BIG = "ä<p>" * 400


def folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"


def test_round_trip_with_copies_ties_and_nulls(spark):
    rows = [(1, "u1", BIG), (2, "u2", BIG), (9, "u9", BIG), (9, "u9", BIG), (None, "un", BIG), (3, "u\r\n%0A3", "small"),
            (4, None, "small"), (5, "u5", None), (6, "u6", ""), (7, "u7", "x" * 1000), (8, "u8", "y" * 999), (10, "u10", "y" * 999)]
    pages = spark.createDataFrame([(*r, "clash", b"clash") for r in rows],
                                  "page_id long, url string, html string, digest string, payload binary")
    at = folder(spark)
    warc.write(pages, at)
    out = warc.read(spark, at).collect()
    assert sorted(((r.page_id, r.url, bytes(r.payload)) for r in out), key=str) == \
        sorted(((i, u, (h or "").encode()) for i, u, h in rows), key=str)
    for r in out:
        body = bytes(r.payload)
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        big = body == BIG.encode() and r.page_id != 9
        assert (r.record_type, r.refers_to) == (("revisit", 9) if big else ("response", None))
        block = b"" if big else body
        assert bytes(r.record) == r.header.encode() + block + b"\r\n\r\n"
        assert f"\r\nContent-Length: {len(block)}\r\n" in r.header and r.header.startswith("WARC/1.1\r\n")
    stored = spark.read.parquet(f"{at}/payloads")
    assert stored.count() == len({h or "" for _, _, h in rows})


def test_damaged_payload_is_found(spark):
    at, bad = folder(spark), folder(spark)
    warc.write(spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string"), at)
    spark.read.parquet(f"{at}/payloads").selectExpr("digest", "cast('other' as binary) payload").write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{at}/headers").write.parquet(f"{bad}/headers")
    with pytest.raises(Exception, match="does not match"):
        warc.read(spark, bad).collect()


def test_empty_table(spark):
    at = folder(spark)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), at)
    assert warc.read(spark, at).count() == 0
