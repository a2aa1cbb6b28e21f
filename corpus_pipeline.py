"""A training-data pipeline over ``documents``: five stages, each one operator of serion.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; between stages the rows are written as Parquet and read again. All stages
but the last return the columns of documents; the last one adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serion.llm import decontaminate, jaccard_join, language_id, quality_rules, sentencepiece_codec
from serion.llm.queries import tokenizer_path
from serion.llm.storage import Scratch, table

#: Near duplicates: shared shingles of this many words, and the least share of the union in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: keeps what no quality rule rejects."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: keeps documents whose language is recognised."""
    return language_id.keep_recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: keeps the document of the smallest doc_id of each group of near copies."""
    return jaccard_join.keep_representatives(docs, shingle=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: drops documents that test items contaminate."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: doc_id, number of ids, the ids in decimal and the decoded text."""
    return sentencepiece_codec.round_trip_texts(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokens),
]

#: No stage after the first can be told in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(f"stage{k}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
