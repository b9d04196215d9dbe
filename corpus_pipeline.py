"""A corpus pipeline of the operators in ``strandline.llm``; every stage works on all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
to the shared folder and reads it as the documents of the next. All stages but the
last return the columns of ``documents``. Null and empty texts have no language and
end in the first stage; repeated rows end in the second; an empty table passes all
stages as an empty table. Other columns of the documents go along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import documents, stored
from strandline.llm.exact_dedup import drop_exact_duplicates
from strandline.llm.language import drop_rejected
from strandline.llm.mixing import mixed_rows
from strandline.llm.near_dedup import drop_near_duplicates
from strandline.llm.pieces import encoded


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model doesn't reject."""
    return drop_rejected(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    return drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    return mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return encoded(spark, docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("encoding", encoding)]

#: The stages learn models and draw at random, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
