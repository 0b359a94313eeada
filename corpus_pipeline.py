"""A training corpus from `documents`: five stages, each written as Parquet and read again.

1. language_id: documents whose language is unknown or uncertain go.
2. near_duplicates: SimHash; the smallest doc_id of each group stays.
3. decontamination: documents that hold a benchmark item go.
4. mixing: documents are repeated or left out so that sources meet their target weights.
5. token_ids: the mix as binary token files; returns what the files hold.

Every stage reads the documents' columns by name, keeps all others, takes null
or empty texts, repeated rows and empty tables as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendscope.llm import decontamination, langid, mixing, simhash, token_files
from spendscope.llm.common import stored
from spendscope.llm.queries import END_ID, table, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=3, radius=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the mix, copies included."""
    return token_files.encoded(docs, tokenizer_path(), END_ID)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_ids),
]

#: Tokenizing, majority fingerprints and string tiling are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
