"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes the stages to a new folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wxframe.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from wxframe.llm.common import prepare
from wxframe.llm.queries import BYTE_BPE
from wxframe.session import ensure_checkpoint_dir, stored


MIN_REST = 0.2                  # near copies share four fifths or more
ENCODED_AT_ONCE = 1 << 20       # bytes of text: executors carry the memory of the stages before


def _stage(fn):
    """A stage whose Python tasks find the package on the executors and get batches bounded by bytes."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds.

    A document that keeps less than ``MIN_REST`` of its words goes: it was a copy or near copy of earlier documents, and
    its scraps would stand as documents of their own in the next stages."""
    return line_dedup.dedup(docs, min_rest=MIN_REST)


@_stage
def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each near-duplicate class."""
    return ngram_join.keep_one(docs)


@_stage
def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digest of the ids, and the digest of the text decoded from them.

    The ids are stored before they are decoded: both steps in one task would take two Python workers for each core, which
    an executor then keeps."""
    vocabulary = bpe.vocabulary(spark, BYTE_BPE)
    coded = stored(bpe.encode(docs.select("doc_id", "text"), vocabulary, limit=ENCODED_AT_ONCE).select("doc_id", "ids"))
    return bpe.decode(coded, vocabulary).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("benchmark decontamination", benchmark_filter),
    ("BPE encoding", encode),
]

#: The classifier is trained, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
