"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents. Stages are written as Parquet in the shared folder and read again.

In every stage a null text counts as empty, other columns may be null and pass through, extra columns stay
whatever their names, and an empty table gives an empty one. Texts of any length are read whole. A row that
is there twice counts twice in toxicity and mixing; exact dedup leaves one of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from fathom.llm.common import table, written

#: What the mixture is made of after toxic documents are gone, and the shares of the tokens.
DOMAINS = {"high": "quality = 1", "low": "quality = 0"}
SHARES = (0.9, 0.1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic by a model of their labels. Null and empty texts are scored as any other."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the one with the most characters, then the smallest id; all null, empty and blank texts are one text."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 or more hold together, that of the smallest id; documents without words are linked with nothing and stay."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: once at least, so that no clean document is lost."""
    return mixing.mixed_rows(docs, table(spark, sf_dir, "labels"), DOMAINS, SHARES, low=1.0, keep_all=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is a piece of its end id alone."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores and library ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None
