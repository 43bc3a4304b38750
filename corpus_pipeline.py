"""The corpus pipeline: toxicity, language ID, near-duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. What a stage needs besides (labels, benchmark) it reads from sf_dir.

Defined results. Null, empty and blank texts: the toxicity stage scores them like a text of one unknown word, the language stage
rejects them (no letter). Null ids: kept by the first four stages if their text is; their near-duplicates are not looked for. Repeated
rows: all stay or all go, except that the near-duplicate stage keeps the rows with the smallest id of a group; the mix rounds each of
them. Empty tables give empty results; without labels nothing is toxic. Extra columns are carried through the first four
stages whatever their names; the mix returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm import decontaminate, langid, mixing, neardup, toxicity
from proseline.llm.common import Scratch, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the classifier learns from the labels of the documents at hand."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is English (``langid.WANTED``; more languages are a parameter of the operator), with a
    posterior of 0.5 or more. The classifier learns from the languages of other documents than those it judges."""
    return langid.keep_wanted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: doc_id, source, size, source_size, target, copies, taken."""
    mixed = mixing.mix(docs)
    return mixed.where("copies > 0").withColumn("taken", F.col("size") * F.col("copies"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express the trained stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's result written to the shared folder and read again as the next one's documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = scratch.save(out)
    return docs
