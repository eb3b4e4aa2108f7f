"""A corpus pipeline: toxic and low-quality documents go, one document of each near-duplicate group stays, and what is left is
packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from navella.llm import jaccard_join, packing, quality
from navella.llm.queries import quality_model, toxicity_model
from navella.llm.shared import stored
from navella.llm.tokens import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns as they are. A null or empty text has no word and is scored
    like one of no evidence, so it stays; repeated rows are judged alike. Without documents or labels all stay."""
    return quality.kept(docs, toxicity_model(spark, sf_dir), 0)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are predicted to be of good quality, with their columns as they are. A null or empty text has no
    feature and gets the model's score for none; repeated rows are judged alike."""
    return quality.kept(docs, quality_model(spark, sf_dir), 1)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates, with its columns as they are. Texts that are null or
    without words are near nothing and all stay, as do documents of a null id's own; of repeated rows of one id one stays."""
    return jaccard_join.first_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of 2048 tokens; further columns go. A null text is an empty one, of
    one token; repeated rows are packed each; without documents there are no pieces."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0, 2048)


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("near duplicates", near_duplicate_stage), ("packing", packing_stage)]
#: SQL can express none of the models; the operators of the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
