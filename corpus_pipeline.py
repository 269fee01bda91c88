"""A training corpus from documents: stages that each hand their rows to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearspark.llm import decontaminate, minhash, mixing, pii, quality, shared


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    machine = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=["n_chars"])
    return quality.score_quality(docs, machine, metadata=["n_chars"]).where("predicted = 1").select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id."""
    return minhash.deduplicate(docs).select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.contaminated()).select(*docs.columns)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact_pii(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


#: Target weights of domains (by a source's number) and languages.
WEIGHTS = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0, ("*", "en"): 5.0, ("*", "fr"): 2.0, ("*", "de"): 2.0, ("*", "es"): 1.0}
#: Tokens of the mix, as a share of the tokens that reach it.
BUDGET = 0.9


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by target weights: the columns of documents with domain, n_tokens and epoch."""
    domain = F.concat(F.lit("domain"), (F.regexp_extract("source", "[0-9]+", 0).try_cast("int") % 4).cast("string"))
    return mixing.mix(docs, BUDGET, WEIGHTS, domain)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("near-duplicates", remove_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("pii", remove_personal_data),
    ("mixing", mix_sources),
]

#: A fitted classifier and suffix arrays are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages keep of the table documents.

    Each stage but the last is written below the shared folder and read from
    there by the next.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared.work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
