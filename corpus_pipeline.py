"""A corpus through five stages: toxicity, line dedup, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame that is written and read again before the next. All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from routelens.llm import dart_minhash, hilbert_packing, line_suffix_array, merge_suffix_array, string_kernel
from routelens.llm.common import forget, keep, kept, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subsequence-kernel machine, learnt from ``labels``, doesn't reject."""
    model = string_kernel.learnt(docs, table(spark, sf_dir, "labels"))
    return string_kernel.clean_documents(docs, model, docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of two lines or more."""
    return line_suffix_array.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return dart_minhash.dedup_documents(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that 200-byte strings repeat."""
    return merge_suffix_array.dedup_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, along the Hilbert curve."""
    return hilbert_packing.pack(docs, public_tokenizers.path(hilbert_packing.TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", packing),
]
#: SQL expresses neither the learnt stage nor the tokenizer; see tests/llm/test_corpus_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each result written to the shared folder and read again.

    What a stage kept on its way, and its predecessor's result, go as soon as its own result is written.
    """
    docs, mark = table(spark, sf_dir, "documents"), kept()
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        forget(spark, mark, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
