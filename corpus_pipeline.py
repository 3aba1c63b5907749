"""A training corpus from raw documents: reject toxic ones, thin out near duplicates, drop benchmark leaks, hide
personal data, pack into training sequences. Each stage is one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintline.llm import decontaminate, jaccard, packing, pii, toxicity
from faintline.llm.common import fresh, keep, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is learned from the labelled documents of sf_dir."""
    marks, base, model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return toxicity.scored(docs, marks, base, model, out=score).filter(F.col(score) < 0.5).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard.dedupe(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, with personal data replaced by its kind; n_chars follows the text."""
    length, before = F.length("text"), fresh(docs, "before")
    hidden = pii.redact(docs.withColumn(before, length))
    shorter = F.when(F.col(before) == length, F.col("n_chars")).otherwise(length.cast("bigint"))
    return hidden.withColumn("n_chars", shorter).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard join", one_of_each_group),
    ("decontamination", drop_leaks),
    ("personal data", hide_personal_data),
    ("packing", pack),
]

#: Models, edit distances and packing can't be put into SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
