"""The corpus pipeline: five stages, each one operator of millrace.llm over all that the stage before kept.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of documents whose 5-word shingles have a similarity of 0.8 or more (candidates by SimHash, then checked exactly), group by group, the one of least doc_id stays.
3. personal_data: personal data and terms that disclose it are replaced in the texts; n_chars follows the text.
4. mixing: documents are repeated or left out as their source's target says, in order of training position.
5. encoding: token ids of each document, in the mix's order, with the digest of the ids.

Defined cases: a null text is the empty text to every stage and stays null in the documents; texts without words pass the classifier
and are all copies of each other; a null doc_id is never rejected by the classifier (rows that share a doc_id are rejected together),
is the last of its group of near-duplicates, and is mixed like any other; repeated rows are one group; a null language has the threshold of
all languages, a null source is a source of its own; extra columns are carried along, whatever their names; empty tables give an empty
result; without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, pii, quality, simhash
from millrace.llm._shared import Workspace, table
from millrace.llm.queries import tokenizer_path


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def stage_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, tokenizer_path())


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("personal_data", stage_personal_data),
    ("mixing", stage_mixing),
    ("encoding", stage_encoding),
]

#: SQL cannot express the classifier, near-duplicate or BPE stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs
