"""Benchmark decontamination with suffix arrays of the training texts.

Each shard of training text (a piece of an Arrow batch) gets the suffix array of
its words: places sorted by the words from there to the end of their text, by
prefix doubling.  Every suffix of the test items is binary-searched in it, word by
word: the interval of places that share its first words narrows until it is empty
or has the wanted `n` words.  The intervals are the verbatim matches with their
locations; matches that follow each other in text and item alike make the
longest match.  Affected documents can go.

Words are told apart by 64-bit hashes modulo a prime (see common); suffixes are
sorted and compared word by word.  Nothing is shuffled: test suffixes travel to
the shards by broadcast, in blocks of at most `block_words` item words, so that
driver and executors hold one block at a time however large the benchmark is.
Each further block is one more pass over a checkpoint of the texts, whose finds
(rows with hits only) are written before the next block is read.

Defined cases: null or empty texts and items have no words and never match;
an item of 1 to n-1 words matches as a whole; items are told apart by item_id,
rows of one item_id count as one item, and so do those without, whose hits count
and whose id is a null at the end of `items`; rows of one doc_id, or without, are
judged each by itself; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

HITS = "doc_id long, n_words long, longest_match long, spans array<struct<start:long,end:long>>, items array<string>"


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, starts, _ in c.chunks(texts):
        low = c.LOWER[data]
        first, last = c.words_of(low, c.ALNUM)
        yield a, b, c.range_hash(c.prefix_hash(low), first, last), np.searchsorted(first, np.append(starts, len(data)))


class Tests:
    """The suffixes of a block of items that have a whole window: where in
    `words` they start, their item, their place in it, and the window's length."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.names = [name for name, _ in items]
        words, starts, item, place, length = ([np.zeros(0, kind)] for kind in (np.uint64, int, int, int, int))
        total = 0
        for a, b, own, at in _words(c.as_text(pa.array([t for _, t in items], pa.large_string()))):
            words.append(own)
            size = np.diff(at)
            window = np.minimum(size, n)
            many = np.where(size > 0, size - window + 1, 0)
            which = np.repeat(np.arange(b - a), many)
            offset = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            starts.append(total + at[which] + offset)
            item.append(a + which)
            place.append(offset)
            length.append(window[which])
            total += len(own)
        self.words, self.starts, self.item, self.place, self.length = (np.concatenate(x) for x in (words, starts, item, place, length))


class SuffixArray:
    """The suffixes of a shard's texts in order; at[i]:at[i + 1] are text i's words."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.vocabulary, self.rank = np.unique(words, return_inverse=True)
        self.rank = self.rank.astype(np.int64) + 1  # 0: the end of a text
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.end = at[1:][self.doc]
        self.places = self._sorted(len(words))

    def word(self, place: np.ndarray, ahead: int) -> np.ndarray:
        """The rank of the word so far ahead, 0 behind the text's end."""
        at = place + ahead
        return np.where(at < self.end[place], self.rank[np.minimum(at, len(self.rank) - 1)], 0)

    def _sorted(self, n: int) -> np.ndarray:
        bits = max(1, len(self.vocabulary).bit_length())
        every, key = np.arange(n), np.zeros(n, np.int64)
        depth = max(1, 62 // bits)
        for k in range(depth):  # as many words as one number holds
            key = key << bits | self.word(every, k)
        order = np.argsort(key, kind="stable")
        group = _group_starts(key[order])
        name = np.empty(n, np.int64)  # of each place: where its group starts
        name[order] = group
        while True:
            size = np.bincount(group, minlength=n)
            tied = np.flatnonzero(size[group] > 1)
            if not len(tied):
                return order
            places = order[tied]
            after = places + depth
            second = np.where(after < self.end[places], name[np.minimum(after, n - 1)] + 1, 0)
            by = np.lexsort((second, group[tied]))
            both = np.stack([group[tied], second[by]])  # a group stays where it is
            new = np.ones(len(tied), bool)
            new[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
            if new.sum() == len(np.unique(group[tied])):  # none was split, and none will be
                return order
            order[tied] = places[by]
            group[tied] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
            name[order[tied]] = group[tied]
            depth *= 2

    def search(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """For each test suffix the interval of suffixes that share its window."""
        n, many = len(self.rank), len(tests.starts)
        low, high = np.zeros(many, np.int64), np.zeros(many, np.int64)
        if not n or not many:
            return low, high
        at = np.minimum(np.searchsorted(self.vocabulary, tests.words), len(self.vocabulary) - 1)
        rank = np.where(self.vocabulary[at] == tests.words, at + 1, 0)
        high[:] = n
        todo, depth = np.arange(many), 0
        while len(todo):
            target = rank[tests.starts[todo] + depth]
            low[todo], high[todo] = self._narrow(low[todo], high[todo], depth, target), self._narrow(low[todo], high[todo], depth, target + 1)
            high[todo[target == 0]] = low[todo[target == 0]]  # a word that is not in the shard
            depth += 1
            todo = todo[(high[todo] > low[todo]) & (tests.length[todo] > depth)]
        return low, high

    def _narrow(self, low: np.ndarray, high: np.ndarray, depth: int, target: np.ndarray) -> np.ndarray:
        """The first place of [low, high) whose word `depth` ahead is not below
        target, by binary search; all suffixes there share the words before."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            below = self.word(self.places[middle], depth) < target[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[low[open_] < high[open_]]
        return low


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1] if len(ordered) else np.zeros(0, np.int64)


def search_shard(words: np.ndarray, at: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hit flag per word; text and item of each match; longest match per text."""
    array = SuffixArray(words, at)
    low, high = array.search(tests)
    found = np.flatnonzero(high > low)
    many = (high - low)[found]
    which = np.repeat(found, many)
    place = array.places[np.repeat(low[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())] if len(found) else found
    length = tests.length[which]
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, place, 1)
    np.add.at(covered, place + length, -1)
    longest = np.zeros(len(at) - 1, np.int64)
    text, item = array.doc[place], tests.item[which]
    if not len(place):
        return np.zeros(len(words), bool), text, item, longest
    # windows that follow each other in text and item are one longer match
    diagonal = place - tests.place[which]
    order = np.lexsort((place, diagonal, item))
    text, item, diagonal, place, length = (x[order] for x in (text, item, diagonal, place, length))
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] > place[:-1] + 1) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    np.maximum.at(longest, text[head], np.append(head[1:], len(place)) - head + length[head] - 1)
    pair = np.unique(text * np.int64(len(tests.names)) + item)
    return np.cumsum(covered[:-1]) > 0, pair // len(tests.names), pair % len(tests.names), longest


def _matches(texts: pa.Array, tests: Tests) -> tuple[np.ndarray, np.ndarray, list, list]:
    """n_words, longest_match, spans and items of each text."""
    n_words, longest, found, item_names = [np.zeros(0, int)], [np.zeros(0, int)], [], []
    for a, b, words, at in _words(texts):
        hit, text, item, own_longest = search_shard(words, at, tests)
        n_words.append(np.diff(at))
        longest.append(own_longest)
        by_text = np.searchsorted(text, np.arange(b - a + 1))
        first, last = c.spans(hit)
        # a run of hit words never crosses a text: cut it at the texts' starts
        starts = at[1:-1][at[1:-1] < len(hit)]  # empty texts at the end start behind the last word
        cut = np.unique(np.concatenate([first, starts[hit[starts]]]))
        stop = np.minimum(last[np.searchsorted(last, cut, "right")] if len(cut) else cut, at[np.searchsorted(at, cut, "right")] if len(cut) else cut)
        spans_at = np.searchsorted(cut, at)
        for i in range(b - a):
            found.append([{"start": int(s - at[i]), "end": int(e - at[i])} for s, e in zip(cut[spans_at[i] : spans_at[i + 1]], stop[spans_at[i] : spans_at[i + 1]], strict=True)])
            item_names.append(sorted({tests.names[k] for k in item[by_text[i] : by_text[i + 1]]}, key=lambda x: (x is None, x or "")))
    return np.concatenate(n_words), np.concatenate(longest), found, item_names


def _search(tests, only_hits: bool = False):
    """tests: a broadcast of Tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, longest, found, names = _matches(c.as_text(batch.column(1)), tests.value)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(longest, pa.int64()), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(names, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "longest_match", "spans", "items"],
            )
            yield out.filter(pa.array(longest > 0)) if only_hits else out

    return run


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in turn, together at most `block_words` words (one item at least)."""
    block: list = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator()
    for row in rows:
        words = len(row.text or "") // 2 + 1
        if block and size + words > block_words:
            yield block
            block, size = [], 0
        block.append((row.i, row.text))
        size += words
    yield block


def _in_blocks(docs: DataFrame, blocks: Iterator, n: int, key: str) -> DataFrame:
    """key, spans, items, longest_match of the rows with hits, block after block."""
    context, found = docs.sparkSession.sparkContext, None
    for block in blocks:
        tests = context.broadcast(Tests(block, n))
        part = docs.select(F.col(key).alias("doc_id"), "text").mapInArrow(_search(tests, only_hits=True), HITS).checkpoint()
        tests.destroy()
        found = part if found is None else found.unionAll(part)
    return found.groupBy(F.col("doc_id").alias(key)).agg(F.max("longest_match").alias("longest_match"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def find_matches(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = 4_000_000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, longest_match (words), spans of
    hit words (half-open, by word), items (ids as strings, sorted; null for the rows without an id)."""
    context = docs.sparkSession.sparkContext
    blocks = item_blocks(benchmark, block_words)
    head = list(islice(blocks, 2))
    if len(head) == 1:
        return docs.select("doc_id", "text").mapInArrow(_search(context.broadcast(Tests(head[0], n))), HITS)
    c.ready(docs.sparkSession)
    # rows are told apart by a key, which must be the same in every pass: hence the checkpoint
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), "text", F.col("doc_id").cast("long").alias("doc_id")).checkpoint()
    found = _in_blocks(keyed, chain(head, blocks), n, "_row").drop("n_words")
    count = keyed.select(F.col("_row").alias("doc_id"), "text").mapInArrow(_search(context.broadcast(Tests([], n))), HITS).select(F.col("doc_id").alias("_row"), "n_words")
    whole = keyed.select("_row", "doc_id").join(count, "_row").join(found, "_row", "left")
    return whole.select("doc_id", "n_words", F.coalesce("longest_match", F.lit(0).cast("long")).alias("longest_match"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def n_hit(spans: Column) -> Column:
    """Words inside any of the spans, which may overlap."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(ordered, start, lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto")), lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_hit_share: float = 0.0, block_words: int = 4_000_000) -> DataFrame:
    """The documents of which no more than the given share of words is hit;
    columns as they came.  Each row is judged by itself, in the pass that reads it."""
    context, names = docs.sparkSession.sparkContext, docs.columns
    blocks = item_blocks(benchmark, block_words)
    head = list(islice(blocks, 2))
    if len(head) == 1:
        tests, text = context.broadcast(Tests(head[0], n)), names.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, _, spans, _ = _matches(c.as_text(batch.column(text)), tests.value)
                hit = np.array([sum(x["end"] - x["start"] for x in own) for own in spans], int)
                yield batch.filter(pa.array(hit <= n_words * max_hit_share))

        return docs.mapInArrow(run, docs.schema)
    c.ready(docs.sparkSession)
    keyed = docs.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    hits = _in_blocks(keyed, chain(head, blocks), n, "_row")
    bad = hits.where(n_hit(F.col("spans")) > F.col("n_words") * max_hit_share).select("_row")
    return keyed.join(bad, "_row", "left_anti").select(names)
