"""Corpus preparation: five stages over the documents table.

language ID -> line dedup -> n-gram Jaccard join -> benchmark decontamination
-> mixing sources to target weights.  A stage takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sangam.llm import common, decontaminate, jaccard, langid, linededup, mixing
from sangam.llm.queries import MIX_TARGETS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; the field learns from all labelled rows."""
    return langid.reject_unknown(docs, langid.train(docs), min_score=0.4)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 40 words or more go; n_chars follows."""
    cut = linededup.dedup_lines(docs, min_words=40)
    return cut.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more."""
    return jaccard.keep_one(docs, k=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim benchmark passage of ten words."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target shares of source, language and topic."""
    return mixing.sample(docs, MIX_TARGETS)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("mix_sources", mix_sources),
]
#: A random field, prefix doubling, components and raking are no SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Every stage before it is written once, in the
    shared folder, and reread, so that none runs again when the next one reads
    its input several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
