"""Corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, packing.

Each stage works on all that the stage before kept, written as Parquet in the
shared folder and read again. All but the last return the columns of documents.

Defined cases, which the operators' modules state in full: rows with null doc_id, text,
source or lang pass every filter (the text counts as empty, the null source as a source);
empty texts are clean, have no copies, and are not taken by the mix, which takes words;
repeated rows are copies, of which one doc_id stays (rows that share it stay together);
texts of any length are handled whole; further columns are kept up to the last stage;
empty documents give an empty result, empty labels a toxicity stage that keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm.common import read, save
from edgeloom.llm.mixing import mix_documents
from edgeloom.llm.neardup import keep_one
from edgeloom.llm.packing import pack_documents
from edgeloom.llm.substring import dedup_texts
from edgeloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is trained on the labels of sf_dir."""
    return reject_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest doc_id stays."""
    return keep_one(docs, n=5, threshold=0.8)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller doc_id has are cut from the text."""
    return dedup_texts(docs, window=50)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all included."""
    return mix_documents(docs, weights=(5, 2, 1), max_epochs=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of the kept texts in length buckets and batches."""
    return pack_documents(docs, context=2048, buckets=16, budget=32_768)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("mixing", mixing),
    ("packing", packing),
]

#: The toxicity model is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
