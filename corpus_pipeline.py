"""The corpus pipeline: stages that each write a table and read it again as the next one's documents.

1. toxicity: documents that the toxicity model rejects go.
2. exact dedup: one document of each group of equal texts stays.
3. SimHash near-dedup: one document of each component of near-duplicates stays.
4. secret scans: documents that hold a secret go.
5. best-fit packing: what is left becomes training sequences; one row per piece.

All but the last return the columns of documents. Empty tables, nulls and repeated rows are treated as
the operators define; a stage only sees what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialwise.llm.common import table
from dialwise.llm.exact_dedup import drop_copies
from dialwise.llm.packing import pack
from dialwise.llm.secrets import drop_secrets
from dialwise.llm.simhash import drop_near_duplicates
from dialwise.llm.toxicity import drop_toxic
from dialwise.session import frozen


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Toxicity, SimHash and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = frozen(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
