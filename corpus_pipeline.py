"""The training-data pipeline: stages over ``documents``, each stored before the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table. All but the last return
the columns of documents. A stage works on all rows the one before kept, in the way its
operator's module describes; NULLs, empty texts, repeated rows and empty tables are
handled there.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postlark.llm import decontaminate, mixing, near_dup, quality, token_files
from postlark.llm.common import new_folder, stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return near_dup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents, so that sources come near their targets."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the texts as token files, and say per document what the files hold."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_tokens(docs, new_folder(spark, "pipeline-tokens"), tokenizer)
    return token_files.read_tokens(manifest)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

# SQL cannot express the classifier; tests compare the other stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"stage-{name}")
    return docs
