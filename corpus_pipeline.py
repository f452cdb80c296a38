"""From raw documents to token ids: five stages, each one operator of tessera.llm on what the stage before kept.

Defined cases, for every stage: an empty table gives an empty one; a null or empty text is a document without words; very
long texts are read whole; rows without a doc_id are never taken for copies of each other and come first among the
tokens; repeated rows of one doc_id and text are one document from near-dedup on; extra columns, whatever their names,
pass through to the last stage, which ignores them. Ties: of a class the smallest doc_id stays; see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, quality, simhash, tokens
from tessera.llm.common import written
from tessera.llm.queries import table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word shingles of five, similarity of 0.8 or more."""
    return simhash.keep_representatives(docs, simhash.similar_groups(docs, shingle_words=5, similarity=0.8))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources nearer to equal weights: every document once, those of small sources up to twice."""
    return mixing.mix(docs, max_repeats=2.0).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes into binary shards and reads them back: where each document's ids are, and their checksum."""
    return tokens.read_documents(tokens.write_shards(docs, tokenizer_path()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL can express neither the classifier nor the grammar; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
