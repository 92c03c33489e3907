"""The corpus pipeline: stages over ``documents``, each written and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklore.llm import decontam, langid, mixing, neardup, pii
from stacklore.llm.base import passing, shared_dir, table

#: What the learned stages decide has no SQL; tests hold the run against plain Python.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, and those that no language fits, go."""
    return langid.keep_known_languages(docs, langid.fit(docs.select("text", "lang")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return neardup.drop_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark as a twentieth of their words or more go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind; n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; those of which it takes nothing go.

    Columns whose names are those of the mix's own figures, in whatever case, are carried with underscores behind them.
    """
    own, names = ("doc_id", "source", "size", "source_size", "target", "taken"), [c.lower() for c in docs.columns]
    for c in docs.columns:
        if c.lower() in own[2:]:
            free = c + "_"
            while free.lower() in names:
                free += "_"
            docs, names = docs.withColumnRenamed(c, free), [*names, free.lower()]
    return mixing.mix(docs, carry=tuple(c for c in docs.columns if c.lower() not in own)).where("taken > 0")


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("personal_data", redacted),
    ("source_mix", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is Parquet in the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        with passing():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
