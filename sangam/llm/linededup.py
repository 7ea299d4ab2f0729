"""Line dedup: a suffix array of line sequences by distributed prefix doubling.

A text is a sequence of line ids (128-bit BLAKE2 digests of its lines with a
word, so that equal ids are equal lines).  Round k ranks the places by their
next 2**k lines: the rank of a place is the position of its prefix in the sorted
order of all prefixes that occur twice or more, found by a range sort of the
pairs (rank of the first half, rank of the second half) of the round before.
Places whose prefix occurs once drop out: their suffix shares fewer than 2**k
lines with any other.  From round 1 on names are ranks, not hashes, so that they
are exact.

A rank of round k is an interval of the suffix array with a longest common prefix
of 2**k lines or more, and two ranks that overlap name the interval of any length
between 2**k and 2**(k+1).  For every place the shortest runs with `min_words`
words that start and that end there are looked up so: an interval of two
suffixes or more is a repeated run, its first suffix (least doc_id, then place)
the copy that stays.  The union of the runs of the other suffixes is what the
maximal repeated runs of that many words cover, and is deleted.

Rows are (document, place) pairs of a few numbers; texts are read three times and
joined once with the runs to delete.  Counts per name combine before the
shuffle; a name of over `HOT` rows is dealt to as many tasks as its count asks
for.  Each round is checkpointed, its finds too, so that no plan spans two.

Defined cases: null or empty texts have no lines and stay as they are; blank
lines take no part, but go with a run that spans them; runs may overlap their
copies; rows of one doc_id with different texts are documents of their own (in
the order of a hash of the text), with the same text one document; documents
with null doc_id lose nothing and are no one's earlier copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

LINES = "doc_id long, v long, i long, line long, span long, length long, back_span long, back long, x long, y long"
DOC = ["doc_id", "v"]
HOT = 1 << 18


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per line with a word: i (its number among them), line (its number
    among all), length and span (lines with a word, and all lines, of the
    shortest run from here with min_words words; null if the text ends before),
    back and back_span (the same of the shortest run that ends here), x and y
    (the line's id); v is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, b, data, starts, ends in c.chunks(c.as_text(batch.column(2))):
                # the separator after each text ends its last line
                data = data.copy()
                data[ends] = 0x0A
                stop = np.flatnonzero(data == 0x0A)
                begin = np.concatenate([[0], stop[:-1] + 1])
                first, _ = c.words_of(data, c.VISIBLE)
                words = np.searchsorted(first, stop) - np.searchsorted(first, begin)
                doc = np.searchsorted(starts, begin, "right") - 1
                line = np.arange(len(begin)) - np.searchsorted(begin, starts)[doc]
                own = np.flatnonzero(words)
                begin, stop, words, doc, line = (x[own] for x in (begin, stop, words, doc, line))
                at = np.searchsorted(doc, np.arange(b - a + 1))
                total = np.concatenate([[0], np.cumsum(words)])
                until = np.searchsorted(total, total[:-1] + min_words)  # lines before it reach min_words
                inside = until <= at[doc + 1]
                length = until - np.arange(len(doc))
                span = line[np.minimum(until, len(doc)) - 1] - line + 1 if len(doc) else line
                since = np.searchsorted(total, total[1:] - min_words, "right") - 1
                behind = since >= at[doc]
                back = np.arange(len(doc)) + 1 - since
                back_span = line - line[np.maximum(since, 0)] + 1 if len(doc) else line
                raw = memoryview(data)
                name = np.frombuffer(b"".join(hashlib.blake2b(raw[p:q], digest_size=16).digest() for p, q in zip(begin.tolist(), stop.tolist(), strict=True)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a + doc].astype(np.int64)), pa.array(versions[a + doc].astype(np.int64)), pa.array(np.arange(len(doc)) - at[doc]), pa.array(line), pa.array(span, mask=~inside), pa.array(length, mask=~inside), pa.array(back_span, mask=~behind), pa.array(back, mask=~behind), pa.array(name[:, 0]), pa.array(name[:, 1])],
                    names=["doc_id", "v", "i", "line", "span", "length", "back_span", "back", "x", "y"],
                )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("v"), "text").mapInArrow(run, LINES)


def _ranked(names: DataFrame, *by: str) -> DataFrame:
    """names (distinct by `by`) with rank: growing in their sorted order."""
    ordered = names.repartitionByRange(*by).sortWithinPartitions(*by)
    return ordered.withColumn("rank", F.monotonically_increasing_id()).checkpoint()


def _joined(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with few (a row a key; n: how many of the rows have it), a
    key of over HOT rows in tasks of about HOT.  There are at most 1 / HOT as
    many such keys as rows."""
    parts = F.ceil(F.col("n") / HOT).cast("int")
    hot = few.where(F.col("n") > HOT).select(*keys, parts.alias("_parts"))
    n_hot = hot.count()
    if not n_hot:
        return rows.join(few.drop("n"), keys)
    rows = rows.join(F.broadcast(hot) if n_hot < 100_000 else hot, keys, "left")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*DOC, "i"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    dealt = few.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return rows.join(dealt, [*keys, "_part"]).drop("_part")


def repeated_runs(docs: DataFrame, min_words: int = 40) -> DataFrame:
    """doc_id, v, start, end: maximal runs of lines to delete (numbers of lines, half-open)."""
    c.ready(docs.sparkSession)
    lines = line_table(docs, min_words)
    names = _ranked(lines.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1"), "x", "y")
    rows = _joined(lines, names, ["x", "y"]).drop("x", "y").dropDuplicates([*DOC, "i"]).checkpoint()
    at = rows.select(*DOC, "i", F.col("rank").alias("r"))
    ahead = rows.where("length is not null").select(*DOC, "i", "line", "span", "length")
    behind = rows.where("back is not null").select(*DOC, (F.col("i") - F.col("back") + 1).alias("i"), (F.col("line") - F.col("back_span") + 1).alias("line"), F.col("back_span").alias("span"), F.col("back").alias("length"))
    todo, size, found = ahead.union(behind).distinct(), 1, []
    while True:
        # the interval of the first `size` lines of each run; runs without one do not repeat
        todo = todo.join(at.hint("merge"), [*DOC, "i"]).checkpoint()
        last = at.select(*DOC, F.col("i").alias("_j"), F.col("r").alias("r2")).hint("merge")
        own = todo.where(F.col("length") < 2 * size).withColumn("_j", F.col("i") + F.col("length") - size).join(last, [*DOC, "_j"])
        found.append(own.select(*DOC, "i", "line", "span", "length", F.col("r").alias("r1"), "r2").checkpoint())
        todo = todo.where(F.col("length") >= 2 * size).drop("r")
        if todo.isEmpty():
            break
        after = Window.partitionBy(*DOC).orderBy("i").rangeBetween(size, size)
        pairs = at.withColumn("r2", F.max("r").over(after)).where("r2 is not null")
        names = _ranked(pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1"), "r", "r2")
        at = _joined(pairs, names, ["r", "r2"]).select(*DOC, "i", F.col("rank").alias("r")).checkpoint()
        size *= 2
    runs = found[0]
    for part in found[1:]:
        runs = runs.unionByName(part)
    interval, place = ["length", "r1", "r2"], F.struct(*DOC, "i")  # ranks of different rounds differ in length
    first = runs.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").checkpoint()
    later = _joined(runs, first, interval).where(place > F.col("first")).select(*DOC, F.col("line").alias("start"), (F.col("line") + F.col("span")).alias("end"))
    order = Window.partitionBy(*DOC).orderBy("start", "end")
    later = later.withColumn("_upto", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("_run", F.sum(F.when(F.col("start") <= F.col("_upto"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return later.groupBy(*DOC, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def remove_runs(docs: DataFrame, min_words: int = 40, text: str = "text") -> DataFrame:
    """docs with the repeated runs cut from the text, and the columns _runs
    (array of (start, end), null where nothing goes) added."""
    runs = repeated_runs(docs.select("doc_id", F.col(text).alias("text")), min_words).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    runs = runs.select(F.col("doc_id").alias("_doc"), F.col("v").alias("_version"), "_runs")
    joined = docs.join(runs, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64(text) == F.col("_version")), "left")
    gone = lambda p: F.exists("_runs", lambda r: (p >= r["start"]) & (p < r["end"]))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, p: ~gone(p)), "\n")
    return joined.withColumn(text, F.when(F.col("_runs").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns, "_runs")


def dedup_lines(docs: DataFrame, min_words: int = 40) -> DataFrame:
    """docs without the later copies of repeated runs; documents of which
    nothing is left go.  Columns as they came."""
    cut = remove_runs(docs, min_words)
    return cut.where(F.col("_runs").isNull() | F.col("text").rlike(r"[^ \t-\r]")).select(docs.columns)
