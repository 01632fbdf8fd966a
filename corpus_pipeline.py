"""A corpus pipeline of five operators of ``tierlake.llm``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, in the
columns of ``documents``; the last returns the encoded documents. ``run``
writes each stage's result as Parquet under the shared scratch folder and
gives the stored rows to the next stage, so a lost executor repeats one stage
at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm import bpe, mixing, quality, queries, simhash
from tierlake.llm import toxicity as toxic
from tierlake.llm.frames import free_prefix
from tierlake.session import scratch_path

#: Toxicity is a learnt compression distance: SQL can't express it.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    model = toxic.fit(docs, queries.toxic_labels(spark, sf_dir))
    p = free_prefix(docs)
    scored = toxic.score(docs, model, score=f"{p}score", predicted=f"{p}toxic")
    return scored.where(F.col(f"{p}toxic") == 0).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    by = f"{free_prefix(docs)}rejected_by"
    return quality.judge(docs, rejected_by=by).where(F.col(by).isNull()).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicate(docs, shingle=4, radius=4, seed=42)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mix(docs, cycle=(3, 1, 2), budget_ratio=1.5, max_epochs=2, seed=42)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of them and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          "ids", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("source_mix", source_mix), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = scratch_path(spark, "corpus-pipeline")
    for number, (name, stage) in enumerate(STAGES):
        stored = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(stored)
        docs = spark.read.parquet(stored)
    return docs
