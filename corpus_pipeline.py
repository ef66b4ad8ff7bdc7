"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bpe, linededup, mixing, neardup, quality
from docketry.llm.common import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the trees reject; without labels the base rule alone decides."""
    return quality.filter_docs(docs, quality.model_of(docs, table(spark, sf_dir, "labels"))).select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; a document of which no line is left goes."""
    out = linededup.deduped(docs).where("n_deleted = 0 or n_deleted < n_lines")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("doc.n_chars")).cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"doc.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of near-duplicates, the one of smallest doc_id."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it."""
    return mixing.mix(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts; texts that don't survive the round trip would show in them."""
    return bpe.encode_digests(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mix sources", mix_sources), ("bpe", bpe_codec)]

#: Trees, sampling by hash and BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
