"""Line-first quality rules, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules (a line of
several words without any sentence end, with navigation bars, symbols, capitals
only, or boilerplate phrases fails); lines that fail are removed, and a document that loses too much text is rejected, as
is one that fails the base counts.  One pass over each row, nothing shuffled.

Defined cases: null or empty texts have no words and fail the base; blank
lines are kept out of the judgement; all columns of the input stay, and
columns of the input named like a result column are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of boilerplate lines, lower case.
BOILERPLATE = ("licensed under", "all rights reserved", "copyright", "cookie", "privacy policy", "terms of use", "terms of service", "click here", "subscribe to our", "javascript")
SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_removed", "chars", "chars_kept", "kept", "clean_text")


def line_passes(line: Column, plain: bool = False) -> Column:
    """Whether one line with a word passes all line rules; plain: the text is
    known to have no symbols and no boilerplate phrase, so these are not tried."""
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | F.contains(low, F.lit(phrase))
    navigation = F.size(F.split(line, "[|>]", -1)) > 3
    symbols = (F.size(F.split(line, f"[{SYMBOLS}]", -1)) - 1) * 20 > F.char_length(line)
    several_words = line.rlike(r"^[ \t-\r]*[^ \t-\r]+([ \t-\r]+[^ \t-\r]+){3}")
    unfinished = several_words & ~line.rlike(r"[.!?:;…。！？]([ \t-\r»”\"')\]]|$)")
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & several_words
    if plain:
        return ~(shouting | unfinished)
    return ~(boilerplate | navigation | symbols | shouting | unfinished)


def base_counts(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A window's identity is the 64-bit hash of its words' hashes.  Positions of
    repeated windows come from one sort per document; the words they cover are
    summed as min(window, gap to the next position)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    step = docs.select("*", F.filter(F.split(t, SPACE), lambda x: x != "").alias("_words"), lines.alias("_lines"))
    step = step.select(
        *[x for x in step.columns if x != "_words"],
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size(F.split(t, f"[{SYMBOLS}]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_grams"),
    )
    done = 1
    while done < window:  # hashes of runs, doubled (the last step may overlap)
        by = min(done, window - done)
        rest = F.size("_grams") - by
        runs = F.when(rest > 0, F.zip_with(F.slice("_grams", 1, F.greatest(rest, F.lit(0))), F.slice("_grams", by + 1, F.greatest(rest, F.lit(0))), lambda x, y: F.xxhash64(x, y)))
        step = step.select(*[x for x in step.columns if x != "_grams"], runs.otherwise(F.array().cast("array<bigint>")).alias("_grams"))
        done += by
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    placed = F.when(repeats, F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    step = step.select(*[x for x in step.columns if x != "_grams"], placed.alias("_placed"))
    s = F.col("_placed")
    twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["h"] == x["h"])))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, zero, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n")), lambda a: a["n"])
    return step.select(*[x for x in step.columns if x != "_placed"], covered.cast("long").alias("n_repeat_words"))


def judge_quality(docs: DataFrame, text: str = "text", min_words: int = 20, max_repeat_percent: int = 30, max_lost_percent: int = 50) -> DataFrame:
    """docs with the counts, the verdict `kept` and `clean_text` (the lines that pass)."""
    docs = docs.select(*[x for x in docs.columns if x not in RESULT])
    step = base_counts(docs, text)
    step = step.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    suspect = F.lit(False)
    for phrase in BOILERPLATE:
        suspect = suspect | F.contains(low, F.lit(phrase))
    # the choice stands outside the lambda, where it is evaluated once a row
    good = F.when((F.col("n_symbols") > 0) | suspect, F.filter("_lines", lambda x: line_passes(x))).otherwise(F.filter("_lines", lambda x: line_passes(x, plain=True)))
    step = step.withColumn("_good", good)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    step = step.select(
        *[x for x in step.columns if x not in ("_lines", "_good")],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_lines_removed"),
        total("_lines").alias("chars"),
        total("_good").alias("chars_kept"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    return step.withColumn("kept", ~F.col("base_failed") & (100 * F.col("chars_kept") >= (100 - max_lost_percent) * F.col("chars")))
