"""From raw documents to token ids: quality rules, near duplicates, personal data, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
their documents; a stage that changes a text sets ``n_chars`` anew. Stages are written as Parquet and read again.

Defined results: null and blank texts fail the base rules and go in the first stage; null ids and sources are values like any
other; of repeated rows one stays, as of all near duplicates, and ties of ids go by a hash of the row; an empty table gives no
rows; other columns go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflux.llm import op01_mixing, op02_jaccard, op05_pieces, op06_pii, op09_quality
from cityflux.llm.common import Scratch, pinned, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no base rule and no low likelihood ratio rejects."""
    return op09_quality.judged(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links connect: the one with the smallest id."""
    return op02_jaccard.one_per_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _counted(op06_pii.masked(docs, op06_pii.fitted(docs)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once per epoch that takes it; the one at its source's budget is cut there."""
    return _counted(op01_mixing.mixed(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts as digests, with the documents' other columns."""
    return op05_pieces.encoded(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixing), ("pieces", pieces)]

#: SQL can't express the conditional random field and the piece model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
            scratch.drop(f"stage-{k - 1}")
        return pinned(STAGES[-1][1](spark, docs, sf_dir))
