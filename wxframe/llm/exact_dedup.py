"""Exact de-duplication: texts are grouped by a 128-bit content hash and the smallest stable id of a group stays.

Grouping is by (hash, text), so equal hashes are confirmed by comparing bytes: the rows of one hash that hold different
texts form different groups.  Map tasks pre-aggregate, so a text held by a third of all rows is one row per map task
when texts are shuffled, once.  Documents then find their group by the hash alone, without texts.  Groups that hold more
than one in ``HOT_SHARE`` of all rows are fewer than ``HOT_SHARE`` and are broadcast; no other key is hot.

* A null text counts as empty; all empty texts are one group.
* Texts of any length are hashed and compared whole.
* Ties can't occur: the smallest id stays.  A null id is larger than any other; a group of null ids only has a null
  ``keep_id`` and each of its rows stays.  Rows that repeat an id with an equal text count in ``group_size`` and share
  one decision, as an id names a document.
* An empty table gives no rows.  Other columns of the input are never looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh

HOT_SHARE = 1000                # at most this many groups can each hold more than one in HOT_SHARE of all rows
SPACE = r"[\x20\x09-\x0D]+"


def collapsed(text) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def content_hash(body) -> Column:
    """128-bit hash of a text, 16 bytes."""
    return F.unhex(F.md5(F.col(body).cast("binary")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=collapsed,
           digest=content_hash) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    ``normalise`` and ``digest`` give the text that is compared and its hash.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), normalise(F.col(f"`{text_col}`")).alias("body")) \
        .select("id", digest("body").alias("h"), "body")
    by_text = rows.groupBy("h", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    found = checkpoint(by_text.select("h", "keep_id", "n", F.sha2("body", 256).alias("sha")))
    clash = found.groupBy("h").count().where("count > 1").select("h")
    if clash.isEmpty():
        out = _look_up(rows.select("id", "h"), found)
    else:                                       # different texts of one hash: those rows are told apart by their bytes
        clash = checkpoint(clash)
        out = _look_up(rows.join(clash, "h", "left_anti").select("id", "h"), found.join(clash, "h", "left_anti"))
        apart = rows.join(clash, "h", "left_semi")
        texts = by_text.join(clash, "h", "left_semi").withColumn("sha", F.sha2("body", 256))
        out = out.unionByName(apart.join(texts, ["h", "body"]).select(*out.columns))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def _look_up(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, keep_id, n, sha) of rows (id, h) whose hashes each have one group."""
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    hot = found.where(F.col("n") * HOT_SHARE > total)
    met = rows.join(F.broadcast(hot.select("h", F.struct("keep_id", "n", "sha").alias("hot"))), "h", "left")
    # rows of hot groups have their answer: they pass the next join under keys of their own, spread evenly
    key = F.when(F.col("hot").isNull(), F.col("h")).otherwise(F.unhex(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))))
    cold = found.where(F.col("n") * HOT_SHARE <= total).select(F.col("h").alias("key"), F.struct("keep_id", "n", "sha").alias("cold"))
    met = met.select("id", "hot", key.alias("key")).join(cold, "key", "left")
    return met.select("id", F.coalesce("hot", "cold").alias("g")).select("id", "g.*")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=collapsed) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    mark = fresh(docs, "_sha")
    stay = groups(docs, id_col, text_col, normalise).where("kept") \
        .select(F.col(f"`{id_col}`").alias("_id"), F.col("text_sha256").alias("_text")).distinct()
    marked = docs.withColumn(mark, F.sha2(normalise(F.col(f"`{text_col}`")), 256)).alias("d")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("s._id")) & (F.col(f"d.`{mark}`") == F.col("s._text"))
    return marked.join(stay.alias("s"), same, "left_semi").drop(mark)
