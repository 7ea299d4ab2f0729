"""The registered queries opN_<name>: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, decontaminate, jaccard, langid, linededup, mixing, quality, suffixdedup, surrogates, urlfilter
from .common import table

#: Rules of the URL query: host + path, verdict.  The first five are the contract's.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Rules of the method itself, for URLs that none of the above fits.
OWN_URL_RULES = [("*spam*/", "block"), ("*cheap-pills*/", "block"), ("*casino*/", "block")]

#: Marginal targets of the mixing query and stage, as shares of tokens.
MIX_TARGETS = {
    "source": {"src0": 0.2},
    "lang": {"en": 0.52, "de": 0.17, "fr": 0.17, "es": 0.14},
    "topic": {"prose": 0.8, "contact": 0.09, "legal": 0.05, "listing": 0.03, "markup": 0.03},
}


def _crc(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), length=50, keep_text=False).drop("kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "chars", "chars_kept")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        # an extra column, longest_match, stays in the operator: the oracle has none
    )


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, key=b"query key")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = linededup.remove_runs(docs)
    n_lines = F.aggregate(F.coalesce("_runs", F.array().cast("array<struct<start:bigint,end:bigint>>")), F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return cut.select("doc_id", F.coalesce(F.array_size("_runs"), F.lit(0)).cast("long").alias("n_runs"), n_lines.alias("n_lines_removed"), "text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    field = langid.train(docs.where(_crc(5) != 0))
    return langid.identify(docs, field).select("doc_id", (_crc(5) == 0).alias("held_out"), "lang_pred", "score", "n_words", "n_foreign")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = compression.train(docs, labels.where(_crc(3) != 1))
    scored = compression.score(docs, model)
    return scored.select("doc_id", (_crc(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, MIX_TARGETS).drop("text", "lang", "source")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, further=OWN_URL_RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {k: v for k, v in vars(oracles).items() if k.startswith("op") and k in queries()}
