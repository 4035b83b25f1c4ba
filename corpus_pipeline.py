"""The corpus pipeline: STAGES, each over all that its predecessor kept, and run(spark, sf_dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sumweave.llm.bpe import bpe_round_trip, default_file
from sumweave.llm.common import load, shared_folder
from sumweave.llm.decontaminate import without_leaks
from sumweave.llm.pii import redact
from sumweave.llm.quality import keep_good
from sumweave.llm.simhash import keep_first


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their EM posterior keep. Null and blank texts go; repeated rows go or stay together; no rows give none; extra
    columns stay."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id, null ids last; one of repeated rows. All texts without words are one
    component; no rows
    give none; extra columns stay. Fingerprints and links are those of the operator: shingles of three words, at most three bits."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item inside, each row by its own text. Null and empty texts stay; repeated rows stay or go together; extra columns stay."""
    return without_leaks(docs, load(spark, sf_dir, "benchmark"), each_row=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by their kind and n_chars set anew. Null texts and ids, repeated rows and extra columns stay."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For every document its doc_id, the number of its tokens, and the digests of their ids and of the decoded text; null texts have no tokens."""
    return bpe_round_trip(docs, default_file(), outputs=False)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]
#: SQL expresses neither the Hamming components nor the CRF nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Applies the stages to documents; each result but the last is written as Parquet to a folder and read again.

    A folder of its own in the shared folder is taken if none is named. With a named one, a run that was cut short goes on after the last stage that it
    finished there. What a stage has read is deleted once its own result is written; the last one's input stays, as the result reads it.
    """
    docs = load(spark, sf_dir, "documents")
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [name for name, _ in STAGES[:-1]]
    done = max((k for k, name in enumerate(names) if files.exists(path(f"{folder}/{name}/_SUCCESS"))), default=-1)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        if k > done:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
            if k:
                files.delete(path(f"{folder}/{names[k - 1]}"), True)
        if k >= done:
            docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
