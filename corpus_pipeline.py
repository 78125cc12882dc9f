"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept; run() writes what a stage returns as Parquet and reads it again.
Nulls, empty texts, repeated rows and empty tables have the results that the stages' operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulemark.llm import exact_dedup, language_id, mixing, ngram_join, packing
from joulemark.llm.common import discard, lookup, release, written

#: A document whose language has a lower probability than this, or that has no letter, is rejected.
LEAST_SCORE = 0.5
#: Near copies share this percentage of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled documents teach stay. A null or empty text, and one without a letter, goes;
    if no document is labelled, all go. Very long texts are scored whole, and repeated rows alike."""
    found = language_id.identify(docs, language_id.train(docs), docs.columns)
    pred, score = found.columns[-2:]
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*(f"`{c}`" for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, however long, the document with the largest doc_id stays, a null doc_id being smaller than any; of
    rows with one doc_id and text, one."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies the one with the smallest doc_id stays. Texts without a word link with nothing,
    and rows with a null doc_id stay. Rows that repeat a doc_id stay or go together."""
    found = ngram_join.ngram_components(docs, NEAR_WORDS, NEAR_PERCENT)
    lost = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-near-copies")
    return lookup(docs, lost, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target weights. A null source or language is a value of
    its own; texts without a token go; rows with a null doc_id are drawn by their texts, repeated rows alike."""
    return mixing.mix(docs, docs.columns).where(F.col(mixing.names(docs.columns)["sampled"])).select(*(f"`{c}`" for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences. A null text is empty, and packed as its end alone;
    repeated rows are packed as often as they come, longer texts than a sequence in pieces."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
        release(spark)
    return docs
