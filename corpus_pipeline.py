"""Five operators in a row over documents: quality, near-duplicates, personal data, mixture, tokens.

Every stage keeps the columns of its documents, but for the last; texts are read whole, however long; an empty table goes
through as an empty table; further columns, also with names that the operators use inside, stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import copies, mixing, pieces, pii, quality, simhash
from strandloom.llm.common import table
from strandloom.llm.queries import MODEL
from strandloom.sources.tables import own_dir, scope


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their own labelled rows, accepts.

    A null text is judged as an empty one. Equal rows, and rows with a null key, are judged alike and stay or go together.
    """
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies: a similarity of five-word shingles of 0.8 or more.

    Null, empty and blank texts are copies of each other. Of rows that share the least id one stays; rows with a null id
    can't be named and all stay.
    """
    return simhash.least_of_each(docs, copies.near_copies(docs), "doc_id")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced, and n_chars set anew; null texts and equal rows stay."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by rates raked to the target margins; rows of rates above 1 are repeated, as in op3.

    A null source or language is a value of its own. Null and blank texts have no tokens and are never sampled; rows
    with equal or null ids draw the same number.
    """
    return mixing.mixed(docs, repeat=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with the check that they decode to the text; a null text has null pieces, equal texts equal ones."""
    return pieces.encode_checked(docs, MODEL)


STAGES = [("quality", accept), ("near_dedup", dedup), ("pii", sanitise), ("mixing", mix), ("tokens", tokens)]

#: SQL can't express the classifier, the fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, what it stored besides is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
