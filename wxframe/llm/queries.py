"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import (bpe, chat, decontaminate, embed_dedup, exact_dedup, html_text, licenses, line_dedup, ngram_join, periodic,
               quality, spelling, warc)
from .common import prepare, table_of

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wu-Manber search of every benchmark window in every whole document."""
    found = decontaminate.scan(table_of(spark, sf_dir, "documents"), table_of(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), "contaminated")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole document and the text decoded from them."""
    vocabulary = bpe.vocabulary(spark, BYTE_BPE)
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary).select("doc_id", "ids")
    return bpe.decode(coded, vocabulary).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes: five-word shingles, Jaccard similarity of 0.8 or more."""
    return ngram_join.classes(table_of(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and its turns and trained-on text read back from the formatted string."""
    chats = table_of(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(said).alias("text"))
    whole = chat.joined(chat.format_chats(chats.unionByName(more)))
    read = whole.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"),
                        chat.parse(F.col("formatted")).alias("turns"))
    trained = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said, 256).alias("turns_sha256"), trained.alias("trained"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.char_length("trained").cast("long").alias("loss_chars"),
                       F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(k)
), e AS (
  SELECT *, length(regexp_replace(text,
      '([\[<])(\\*)(/?SYS\]|/?INST\]|/?s>|/?TOOL\]|/?ROLE\]|SEP\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'tool' THEN 13
        ELSE 18 + length(role) END AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal label with a cosine of 0.93 or more."""
    return embed_dedup.near_duplicates(table_of(spark, sf_dir, "embeddings"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed licence families of every document."""
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.families(docs, licenses.train(spark, docs))
    return found.select("doc_id", "n_paragraphs", F.size("families").cast("long").alias("n_families"),
                        F.array_join("families", ",").alias("families"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table_of(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive in the shared folder, and its records read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table_of(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
        CASE WHEN strlen(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM q
"""

def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated scores of both views and of their combination for every document."""
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = quality.train(docs, table_of(spark, sf_dir, "labels"))
    s = F.col("score")
    return quality.score(docs, model, "score").select(
        "doc_id", s["p_text"].alias("p_text"), s["p_meta"].alias("p_meta"), s["p_good"].alias("p_good"),
        (s["p_good"] >= quality.Settings().threshold).alias("accepted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words or more that an earlier document holds."""
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    r = F.col("result")
    return line_dedup.annotate(docs, "result").select(
        "doc_id", r["n_lines"].alias("n_lines"), r["n_removed"].alias("n_removed"), r["sources"].alias("source_ids"),
        F.sha2(F.coalesce(r["text"], F.lit("")), 256).alias("text_sha256"),
        ((r["n_removed"] > 0) & ~r["text"].rlike(r"\S")).alias("emptied"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form, the root of its chain of forms, and its near words."""
    return spelling.variants(table_of(spark, sf_dir, "documents").select("doc_id", "text"), typo_every=97)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, keeper and hash of the normalised text of every document."""
    return exact_dedup.groups(table_of(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""


def _with_tandems(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one document in ten, by the crc32 of its id, repeats a stretch of words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.nullif(F.size("words"), F.lit(0))
    rows = rows.select("doc_id", "text", "words", "g", (F.col("g") % n).alias("a"))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(
        "words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, its longest one, and digests of the runs and of the collapsed text."""
    found = periodic.annotate(_with_tandems(table_of(spark, sf_dir, "documents")), "found")
    runs = F.col("found.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("found.text"), 256).alias("collapsed_sha256")) \
        .select("doc_id", "n_runs", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
                (-F.col("best.short")).alias("period"),
                F.floor(1000 * F.col("best.length") / -F.col("best.short")).alias("exponent_milli"),
                "runs_sha256", "collapsed_sha256")


_QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_bpe, op3_ngram_join, op4_chat, op5_quality, op6_embed_dedup, op7_licenses, op8_html_text, op9_warc, op10_line_dedup,
                                    op11_spelling, op12_exact_dedup, op13_periodic)}
_SQL = {"op4_chat": OP4_SQL, "op9_warc": OP9_SQL, "op12_exact_dedup": OP12_SQL}


def _prepared(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over the documents."""
    import corpus_pipeline                   # at the repository's top; it uses this subpackage
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(fn) for name, fn in (_QUERIES | {"pipeline": pipeline}).items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
