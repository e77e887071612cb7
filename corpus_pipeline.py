"""From raw documents to packed training sequences, one operator after another.

Every stage reads all rows the one before it kept, as Parquet, and its
decisions take effect on them; all but the last return the columns of
`documents`.  An empty table gives an empty result in every stage, and other
columns than doc_id, text, lang and n_chars are handed on as they are.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hammerline.llm._spark import shared_folder
from hammerline.llm.jaccard_join import keep_one
from hammerline.llm.packing import pack_documents
from hammerline.llm.pii import sanitise
from hammerline.llm.quality_rules import keep_good
from hammerline.llm.suffix_dedup import drop_repeats


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go.

    Null and empty texts have no words and go.  A null language is one of its
    own.  Equal rows share a verdict; the id plays no part in it.
    """
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Documents without words are no one's duplicate and stay, and so do rows
    without an id; rows that share the kept id all stay.
    """
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id holds are cut from the text, and n_chars follows.

    Rows that share an id cut nothing from one another; a null id is the largest.
    Null texts stay null; a text may become empty.
    """
    return _measured(drop_repeats(docs)).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are generalised or removed, and n_chars follows.

    Null texts stay null, with n_chars null; no row goes.
    """
    return _measured(sanitise(docs)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of at most 4,096 tokens in as few sequences as possible.

    A null or empty text is one piece with the end id alone; each of several
    equal rows is packed.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_dedup),
    ("PII", pii),
    ("best-fit packing", packing),
]

#: Perplexity bands, component search and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`.  What the last one returns rests on checkpoints, so the stages' own tables go at once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    _remove(spark, folder)
    return out
