"""A corpus through five stages: language ID, line de-duplication, near-duplicate documents, benchmark
decontamination, tokens. Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; the last one
returns token ids in place of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, jaccard, langid, lines, pieces
from tickloom.llm.shared import cut


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str, model: langid.Model | None = None) -> DataFrame:
    """Documents that language identification doesn't reject: texts with a letter that aren't far from every
    language. Without a ``model`` one is fitted on the labelled rows of ``docs``; a language of few labelled rows
    rejects nothing, and without any labelled row all texts with a letter stay. Null, empty and letterless texts go;
    null ids and labels are kept as they are."""
    model = model or langid.fit(docs.where(langid.learnable()))
    return langid.identify(docs, model).where(~F.col("rejected")).select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that no earlier line equals or nearly equals; those left without one go, and so
    do null and empty texts. Rows that repeat an id are lines of one document."""
    return lines.without_repeated_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id. Null and empty texts are no
    duplicates; a row with a null id goes where it is linked with another id."""
    return jaccard.keep_one(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not. Null and empty texts hold none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, and the ids of each text; none of a null or empty one."""
    return pieces.tokenize(docs, pieces.model_path()).drop("text")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("ngram_jaccard", distinct_documents),
    ("decontaminate", clean_of_benchmarks),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
