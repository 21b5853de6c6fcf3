"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm import bpe, common, decontam, langid, linededup, neardup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't rejected."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their sources; copies stay for near_dedup; n_chars is that of the new text."""
    out = linededup.dedup_lines(docs, copies_once=True)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in out.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.encode(docs, with_ids=False)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: A trained classifier, a tokenizer and edit distances: SQL can't express these; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared checkpoint folder and read again.

    A stage's folder goes as soon as the next one's is written; the last one stays, as the result is read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{common.ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            place = f"{folder}/{i}-{name}"
            docs.write.parquet(place)
            docs = spark.read.parquet(place)
            if last:
                path = spark._jvm.org.apache.hadoop.fs.Path(last)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            last = place
    return docs
