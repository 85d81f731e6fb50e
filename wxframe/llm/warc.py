"""Content-addressed web archive.

An archive is two Parquet datasets in one folder: ``payloads`` holds every distinct
payload once under its SHA-256, ``headers`` the exact header of every record with the
digest of its payload.  Records are rebuilt by joining the two; reading recomputes each
stored payload's digest and fails on a mismatch.  The digest decides sameness, so
groups of copies are counted with partial aggregation and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000


def _line(name: str, value: Column) -> Column:
    """One header line; nothing where the value is null. CR, LF and % of a value are percent-coded."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "%", "%25"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _value(name: str) -> Column:
    found = F.regexp_extract("header", f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "%0A", "\n"), "%0D", "\r"), "%25", "%")
    return F.when(F.contains("header", F.lit(f"\r\n{name}: ")), plain)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
          min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write the records of ``pages`` to the new folder ``folder``.

    The payload is the body in UTF-8 (null: empty).  Of rows with equal payloads of at least
    ``min_revisit_bytes`` the one with the largest id is the response and the others revisit it; rows that
    repeat that id too are responses, rows with a null id count as smallest.  Shorter payloads are all responses,
    stored once as well.  An empty table makes an empty archive; extra columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    # the copies of a payload are reduced before the shuffle
    keyed.groupBy("digest").agg(F.first("payload").alias("payload")) \
        .write.option("compression", "zstd").parquet(f"{folder}/payloads")
    facts = keyed.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"),
                         F.sha1("payload").alias("sha1"))
    largest = facts.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("first_id"))
    found = facts.join(largest, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("id"))), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, urn(F.col("first_id")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit(CRLF))
    found.select("digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of an archive, rebuilt: page_id, url, record_type, refers_to (null for responses), header,
    payload, payload_bytes, payload_digest (SHA-1, lower-case hex), record (the WARC record's bytes).

    Raises if a stored payload does not have its digest or a record's payload is missing.  Only the columns that
    are used are shuffled: digests and sizes are taken from the store before the join.
    """
    store = spark.read.parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest")))
    digest = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(wrong.cast("string"))
    store = store.select(digest.alias("digest"), "payload", F.sha1("payload").alias("payload_digest"),
                         F.octet_length("payload").cast("long").alias("payload_bytes"))
    heads = spark.read.parquet(f"{folder}/headers")
    both = heads.join(store, "digest", "left")
    page = lambda name: F.regexp_extract(_value(name), "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(c != "", c.cast("long"))
    missing = F.raise_error(F.concat(F.lit("no payload stored for "), F.col("digest")))
    kind = _value("WARC-Type")
    body = F.when(kind == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return both.select(
        number(page("WARC-Record-ID")).alias("page_id"), _value("WARC-Target-URI").alias("url"),
        kind.alias("record_type"), number(page("WARC-Refers-To")).alias("refers_to"), "header", "payload",
        F.coalesce(F.col("payload_bytes"), missing.cast("long")).alias("payload_bytes"), "payload_digest",
        F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))
