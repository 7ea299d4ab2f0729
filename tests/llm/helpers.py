import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts, langs=None, sources=None, partitions=3):
    """documents of these texts, doc_id by position."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    out = []
    for i in range(words):
        out.append("".join(chr(97 + (b * 7 + 3) % 26) for b in divmod(r.randrange(vocabulary), 20)) + "xo")
        if i % 9 == 8:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n") + "."


def awkward():
    """Nulls, empty texts, blank texts, ties, repeats, odd bytes, one long text."""
    a, b = prose(1, 120), prose(2, 90)
    long = "\n".join(prose(50 + i, 300) for i in range(12))
    return [None, "", " \n\t ", a, a, b, a[:200] + b[:300], "\n\n" + b + "\n", "ä" * 70, "x" + "ä" * 70, a.upper(), long, long[500:9000], "one", "one", "One two", a[:49], a[:50], a[1:51], "\x00" * 60, "\x00" * 61, b + " " + a, None]
