"""The training-data pipeline: its stages in order, and a run over the documents.

Each stage takes (spark, docs, folder of the tables) and returns the documents
that it keeps; the last one adds how much of each the mix takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kemptable.llm.decontaminate import contamination
from kemptable.llm.langid import UNKNOWN, languages, learned
from kemptable.llm.mixing import mixed_sources
from kemptable.llm.neardup import distinct_documents
from kemptable.llm.pii import personal_spans, sanitised
from kemptable.llm.queries import quality_weights, table
from kemptable.session import scratch_path

# Score of a predicted language from which it overrules a given one.
SURE_SCORE = 0.75


def _rest(docs: DataFrame) -> tuple[str, ...]:
    """All columns but the text, which the operators hand on by itself."""
    return tuple(c for c in docs.columns if c != "text")


def _columns(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` from a struct ``row`` and the text, some of them changed."""
    return [
        changed.get(c, F.col("text") if c == "text" else F.col("row")[c]).cast(docs.schema[c].dataType).alias(c)
        for c in docs.columns
    ]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; it fills in where none is given and overrules a wrong one.

    Texts without letters go. A given language that the machines do not know is
    left alone, for they cannot predict it.
    """
    model = learned(docs)
    known = [name for members in model.families.values() for name in members]
    given = F.col("row")["lang"]
    found = languages(docs, model, _rest(docs), keep_text=True).filter(F.col("lang_pred") != UNKNOWN)
    overruled = given.isNull() | (given.isin(known) & (F.col("score") >= SURE_SCORE))
    return found.select(_columns(docs, lang=F.when(overruled, F.col("lang_pred")).otherwise(given)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return distinct_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=_rest(docs), keep_text=True)
    return found.filter(F.size("spans") == 0).select(_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced in the text."""
    found = personal_spans(docs, keep=_rest(docs), keep_text=True)
    touched = F.size("spans") > 0
    clean = found.withColumn("text", F.when(touched, sanitised(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    n_chars = F.when(touched, F.length("text")).otherwise(F.col("row")["n_chars"])
    return clean.select(_columns(docs, n_chars=n_chars))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with their size, source size, target and taken words."""
    made = ("size", "source_size", "target", "taken")
    weights = quality_weights(table(spark, sf_dir, "labels"))
    mixed = mixed_sources(docs, weights, keep=tuple(c for c in docs.columns if c not in made))
    return mixed.filter("taken > 0").select("row.*", *made)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("mix", mix),
]

# SQL cannot learn languages; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
