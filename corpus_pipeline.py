"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor wrote, and returns a DataFrame: the
columns of documents from all but the last, the placed pieces from the last. Input with nulls, repeated rows, further
columns or no rows is handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm._common import documents, materialize, release
from weftgraph.llm.lines import dedup_lines
from weftgraph.llm.mixture import mix_documents
from weftgraph.llm.outliers import keep_good
from weftgraph.llm.packing import pack
from weftgraph.llm.queries import tokenizer_path
from weftgraph.llm.similar import keep_one_of_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them only."""
    return dedup_lines(docs, min_docs=10, keep="first")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are 0.8 alike or more in five-word shingles, the one with the smallest doc_id stays."""
    return keep_one_of_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The stages fit estimates, hash and tokenize, which SQL doesn't express; tests/llm/test_pipeline.py checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
