"""A training corpus from the documents table, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``, so a lost
executor costs a task of one stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe_fst, quality_rules
from tracewright.llm.common import use_checkpoints
from tracewright.llm.line_dedup import drop_site_boilerplate
from tracewright.llm.queries import ids_sha256, mixed
from tracewright.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    led = quality_rules.ledger(quality_rules.measure(docs, "doc_id", "text", carry=tuple(docs.columns)))
    return quality_rules.apply_policy(led, "prose-1").where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the boilerplate lines of their source; n_chars follows the text.

    Copies are still here, so pages with equal texts count once: a page stored often would else lose all its lines, and a
    line of one page alone is no boilerplate, however few pages its source has.
    """
    out = drop_site_boilerplate(docs, "source", "text", max_ratio=0.05, min_pages=2, one_per_text=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8 or more): that with the least id.

    SimHash shows the candidates, the whole shingle sets confirm them.
    """
    return keep_one(docs, shingle=5, similarity=0.8).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixture's proportions; a document has a row for each epoch that takes it."""
    return mixed(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe_fst.encode(docs, path, public_tokenizers.PATTERN, decode_col="decoded", keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), ids_sha256(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mixing), ("bpe", encoding)]

#: SQL expresses neither SimHash nor BPE; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.

    Each stage is written below the checkpoint folder and goes when the next one is written; the
    last of them stays, as the result reads it.
    """
    use_checkpoints(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(now := f"{top}/{k}_{name}")
        docs = spark.read.parquet(now)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
