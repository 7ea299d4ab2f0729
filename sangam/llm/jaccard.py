"""Exact n-gram Jaccard join with count vectors in R-trees, and its components.

A document's set is the hashes of its distinct `k`-word shingles.  Documents
with equal sets form a class, and only classes are compared.

Candidates: sets of similarity t share a part t of the larger one, so that with
any order of all shingles the first common one stands in both sets' prefixes of
n - ceil(t * n) + 1 shingles.  The order is rare shingles first.  A count sketch of
fixed size (2**SKETCH_BITS counters over all documents) tells which shingles may be
rare; over large inputs many shingles share a counter, so that those with a low
one, somewhat more than the prefixes need, are counted one by one, and each of
2**EXACT_BITS places keeps the most of its shingles.  Passages shared by many
documents then seldom stand in a prefix.  Both tables only make the order, which
is the same for all documents: no link hangs on them.  Each document sends its
prefix to the shards of its shingles, once for its size band and once for the
band below (linked sets are in one or in neighbouring bands), and a shard links
the documents of one shingle and band to the least of them.  No link is lost,
and a key costs a shard one entry a batch at most.  Each key comes with the one
before it in its document's prefix: documents that share both are linked by the
earlier one, in whatever shard that is, so that alike documents make a link where
their prefixes begin to agree and not at every key that they share.

Verification: the candidate components of each band are joined within.  Each set becomes
its vector of shingle counts in `DIMENSIONS` hash groups; an R-tree over these
points, packed by size, bounds the overlap with any subtree by the summed
minima of the coordinates, and surviving pairs are verified on the sets
themselves.  Pairs that are in one component already are skipped.  A component
of more than `group_shingles` shingles is dealt in chunks, and pairs of chunks
are joined as tasks of their own.

Defined cases: null or empty texts, or texts without words, have the empty set
and link with nothing; with fewer than k words the whole sequence is the one
shingle; rows of one doc_id are one document, which has the links of each of
its texts, and each row its own n_shingles; rows without doc_id link with
nothing; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import connected

DIMENSIONS = 32
SKETCH_BITS = 23
EXACT_BITS = 23
BATCH_COUNT = 8
SLICES = 16
LEAF = 16
HOT_PARTS = 1000
#: The bits of a key that hold its band; no percent has more bands.
SPACE = np.uint64(0xFFFF)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, data, starts, _ in c.chunks(texts):
        low = c.LOWER[data]
        first, last = c.words_of(low, c.VISIBLE)
        words = c.range_hash(c.prefix_hash(low), first, last)
        grams = c.sequences_hash(words, k)
        at = np.searchsorted(first, np.append(starts, len(data)))
        for i in range(b - a):
            n = at[i + 1] - at[i]
            if n >= k:
                yield np.unique(grams[at[i] : at[i + 1] - k + 1])
            elif n:
                yield c.sequences_hash(words[at[i] : at[i + 1]], int(n)) + np.uint64(n)
            else:
                yield np.zeros(0, np.uint64)


class Bands:
    """Size bands and prefixes for one threshold t = percent/100."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("percent must be 1 to 100")
        self.percent, self.t = percent, Fraction(percent, 100)
        self.edges = [1]
        # band i holds edges[i] <= n < edges[i + 1]; at 100 equal sets only link, which are one class
        while percent < 100 and self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] / self.t)))

    def of(self, n: int) -> int:
        import bisect

        return bisect.bisect_right(self.edges, n) - 1

    def reaches(self, overlap, a, b):
        """Whether sets of sizes a and b that share `overlap` shingles link."""
        return 100 * overlap >= self.percent * (a + b - overlap)

    def prefix(self, tokens: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the rarest shingles, for the set's band and the one below, and
        the key before each of them in its band (0 before the first)."""
        n = len(tokens)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        own, length = self.of(n), n - math.ceil(self.t * n) + 1
        rare = tokens[np.lexsort((tokens, order.of(tokens)))[:length]]
        keys = [np.sort(c.mix(rare + np.uint64(band * 0x1000003 + 1)) & ~SPACE | np.uint64(band)) for band in {own, max(own - 1, 0)}]
        return np.concatenate(keys), np.concatenate([np.append(np.zeros(1, np.uint64), x[:-1]) for x in keys])


def sketch_place(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (c.mix(tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def exact_hash(tokens: np.ndarray) -> np.ndarray:
    """Its first EXACT_BITS are the place among the exact counts."""
    return c.mix(tokens * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))


class Order:
    """One order of all shingles, rare ones first, from a count sketch and, once
    they are known, exact counts of the shingles with a low counter."""

    def __init__(self, counts: np.ndarray, part: float):
        """part: of all occurrences, those that are counted exactly."""
        self.bits = int(len(counts)).bit_length() - 1
        # in pieces, as bincount copies to 64 bits
        mass = sum(np.bincount(x, minlength=65_536) for x in np.array_split(counts, 64)) * np.arange(65_536, dtype=np.float64)
        most = int(np.searchsorted(np.cumsum(mass), part * mass.sum()))
        # levels of one byte that still tell twice that counter from others
        shift = max(0, (2 * most).bit_length() - 8)
        self.levels = np.minimum(counts >> shift, 255).astype(np.uint8)
        #: Levels up to `sure` hold one occurrence; those up to `low` are counted.
        self.sure, self.low = -1 if shift else 1, most >> shift
        self.exact: np.ndarray | None = None

    def level(self, tokens: np.ndarray) -> np.ndarray:
        return self.levels[sketch_place(tokens, self.bits)]

    def counted(self, tokens: np.ndarray) -> np.ndarray:
        """The tokens of which an exact count is of use."""
        level = self.level(tokens)
        return tokens[(level > self.sure) & (level <= self.low)]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        level = self.level(tokens).astype(np.int64)
        if self.exact is None:
            return level
        exact = self.exact[(exact_hash(tokens) >> np.uint64(64 - EXACT_BITS)).astype(np.int64)].astype(np.int64)
        exact[level <= self.sure] = 0
        exact[level > self.low] = 256
        return exact << 8 | level


def profile(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n (set size), h1, h2 (the set's identity); and rows with slice,
    counts: a part of the count sketch of each task."""
    names = ["doc_id", "n", "h1", "h2", "slice", "counts"]
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            sets = []
            for x in shingle_sets(c.as_text(batch.column(1)), k):
                place = sketch_place(x, bits)
                np.add.at(counts, place[counts[place] < 60_000], np.uint16(1))
                sets.append((len(x), int(c.mix(x).sum(dtype=np.uint64)), int(c.mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))))
            n, h1, h2 = (np.array(x, np.uint64).view(np.int64) for x in (zip(*sets, strict=True) if sets else ((), (), ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(h1), pa.array(h2), pa.nulls(len(n), kinds[4]), pa.nulls(len(n), kinds[5])], names=names)
        parts = [zstandard.ZstdCompressor(level=1).compress(np.minimum(x, 255).astype(np.uint8).tobytes()) for x in np.split(counts, SLICES)]
        empty = [pa.nulls(SLICES, kind) for kind in kinds[:4]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(range(SLICES), pa.int64()), pa.array(parts, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, slice long, counts binary")


def count_sketch(profiles: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """The tasks' sketches added up: 2**(bits + 1) bytes, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // SLICES, np.uint32)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
        return sliced(table.column("slice")[:1].combine_chunks(), np.minimum(total, 65_535).astype(np.uint16))

    parts = profiles.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice long, counts binary")
    return gathered_slices(parts, SLICES, (1 << bits) // SLICES, np.uint16)


def sliced(number: pa.Array, counts: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([number, pa.array([zstandard.ZstdCompressor(level=1).compress(counts.tobytes())], pa.binary())], names=["slice", "counts"])


def gathered_slices(parts: DataFrame, slices: int, length: int, kind: type) -> np.ndarray:
    """One table of the slices; those that are missing are zero."""
    out = np.zeros((slices, length), kind)
    for r in parts.collect():
        out[r.slice] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts), kind)
    return out.ravel()


def exact_counts(docs: DataFrame, k: int, order: Order, shards: int) -> np.ndarray:
    """The most occurrences (0: one at most, 255: or more) of a shingle at each of
    2**EXACT_BITS places, of those with a low counter.  A batch counts a shingle
    BATCH_COUNT times at most, so that many copies make no long rows."""
    bits = min(10, max(4, (shards // 4).bit_length()))
    given = docs.sparkSession.sparkContext.broadcast(order)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [given.value.counted(x) for x in shingle_sets(c.as_text(batch.column(0)), k)]
            if not sum(map(len, held)):
                continue
            value = np.sort(exact_hash(np.concatenate(held)))
            keep = np.ones(len(value), bool)
            keep[BATCH_COUNT:] = value[BATCH_COUNT:] != value[:-BATCH_COUNT]
            value = value[keep]
            cut = np.searchsorted(value >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rest = (value >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([rest[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], names=["slice", "counts"])
        c.trim()

    def add(table: pa.Table) -> pa.Table:
        value = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]))
        head = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        count = np.diff(np.append(head, len(value)))
        head, count = head[count > 1], np.minimum(count[count > 1], 255).astype(np.uint8)
        most = np.zeros(1 << EXACT_BITS - bits, np.uint8)
        np.maximum.at(most, value[head] >> np.uint32(32 - EXACT_BITS + bits), count)
        return sliced(table.column("slice")[:1].combine_chunks(), most)

    parts = docs.where("doc_id is not null").select("text").mapInArrow(send, "slice long, counts binary").groupBy("slice").applyInArrow(add, "slice long, counts binary")
    return gathered_slices(parts, 1 << bits, 1 << EXACT_BITS - bits, np.uint8)


def shingle_order(docs: DataFrame, k: int, bands: Bands, shards: int, counts: np.ndarray) -> Order:
    """By the sketch alone where its counters are exact for all that prefixes need."""
    order = Order(counts, min(1.0, 1.4 * (100 - bands.percent) / 100 + 0.01))
    if order.low > order.sure:
        order.exact = exact_counts(docs, k, order, shards)
    return order


def candidate_pairs(docs: DataFrame, k: int, bands: Bands, shards: int, order: Order) -> DataFrame:
    """(space, u, v), v < u: documents that share a prefix shingle in a band, as
    stars round the least."""
    given = docs.sparkSession.sparkContext.broadcast(order)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, before, docs = [], [], []
            for doc, tokens in zip(ids, shingle_sets(c.as_text(batch.column(1)), k), strict=True):
                own, previous = bands.prefix(tokens, given.value)
                keys.append(own)
                before.append(previous)
                docs.append(np.full(len(own), doc))
            if not keys:
                continue
            space, u, v, keys, before, docs = stars(np.concatenate(keys), np.concatenate(before), np.concatenate(docs))
            shard = ((keys >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            shard, keys, before, docs = shard[order], keys[order], before[order], docs[order]
            cut = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]).astype(int) if len(shard) else np.zeros(0, int)
            rows = [(int(shard[s]), keys[s:e].tobytes(), before[s:e].tobytes(), docs[s:e].tobytes(), b"") for s, e in zip(cut[:-1], cut[1:], strict=True)]
            rows.append((-1, u.tobytes(), b"", v.tobytes(), space.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 4))], names=["shard", "keys", "before", "docs", "spaces"])
        c.trim()

    def meet(table: pa.Table) -> pa.Table:
        keys, before, docs, space = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("keys", np.uint64), ("before", np.uint64), ("docs", np.int64), ("spaces", np.int64)))
        if table.column("shard")[0].as_py() < 0:
            u, v = keys.view(np.int64), docs
        else:
            space, u, v, *_ = stars(keys, before, docs)
        return pa.Table.from_arrays([pa.array(x) for x in distinct(space, u, v)], names=["space", "u", "v"])

    sent = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(send, "shard long, keys binary, before binary, docs binary, spaces binary")
    # a batch's own stars (shard < 0) need no meeting: spread them evenly
    sent = sent.withColumn("shard", F.when(F.col("shard") < 0, -1 - F.pmod(F.xxhash64("keys"), F.lit(shards))).otherwise(F.col("shard")))
    return sent.groupBy("shard").applyInArrow(meet, "space long, u long, v long")


def distinct(space: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct triples, sorted."""
    order = np.lexsort((v, u, space))
    space, u, v = space[order], u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (space[1:] != space[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return space[new], u[new], v[new]


def stars(keys: np.ndarray, before: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (band, document, least document of a key it has), and (key, key
    before it, least document).  Documents that have the same key before are
    linked by that one already, so that only the least of them stands for them here."""
    order = np.argsort(keys, kind="stable")
    keys, before, docs = keys[order], before[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    shared = ~new
    shared[:-1] |= ~new[1:]
    alone = [x[~shared] for x in (keys, before, docs)]
    keys, before, docs = keys[shared], before[shared], docs[shared]
    order = np.lexsort((docs, before, keys))
    keys, before, docs = keys[order], before[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (before[1:] != before[:-1]) | (before[1:] == 0)
    keys, before, docs = keys[new], before[new], docs[new]
    order = np.lexsort((docs, keys))
    keys, before, docs = keys[order], before[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    head = np.flatnonzero(new)
    star = np.repeat(docs[head], np.diff(np.append(head, len(keys))))
    other = docs != star
    heads = (np.concatenate([a, x[head]]) for a, x in zip(alone, (keys, before, docs), strict=True))
    return *distinct((keys[other] & SPACE).astype(np.int64), docs[other], star[other]), *heads


class CountTree:
    """An R-tree over count vectors, packed in the order of the sets' sizes.
    A node keeps the coordinates' maxima and the range of sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels = []
        high, least, most = points, sizes, sizes
        while len(high) > 1:
            cut = np.arange(0, len(high), LEAF)
            high, least, most = np.maximum.reduceat(high, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((high, least, most))

    def search(self, point: np.ndarray, size: int, bands: Bands) -> np.ndarray:
        """Entries whose bound does not rule out a link."""
        nodes = np.array([0])
        for high, least, most in reversed(self.levels):
            bound = np.minimum(high[nodes], point).sum(axis=1)
            # the union is least with the smallest set below that can hold the overlap
            small = np.clip(size, least[nodes], most[nodes])
            nodes = nodes[bands.reaches(np.minimum(bound, np.minimum(size, most[nodes])), size, np.minimum(small, np.maximum(least[nodes], bound)))]
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            below = len(self.points) if high is self.levels[0][0] else len(self.levels[self._at(high) - 1][0])
            nodes = nodes[nodes < below]
        bound = np.minimum(self.points[nodes], point).sum(axis=1)
        return nodes[bands.reaches(bound, size, self.sizes[nodes])]

    def _at(self, high: np.ndarray) -> int:
        return next(i for i, x in enumerate(self.levels) if x[0] is high)


def links_within(ids: np.ndarray, sets: list[np.ndarray], bands: Bands, part: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a spanning forest of the link graph.  part: only pairs of
    different parts are compared."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    part = part[order] if part is not None else None
    sizes = np.array([len(x) for x in sets])
    points = np.stack([np.bincount((c.mix(x) % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS) for x in sets])
    tree, label, edges = CountTree(points, sizes), np.arange(len(ids)), []
    for i in range(len(ids)):
        near = tree.search(points[i], int(sizes[i]), bands)
        near = near[near < i][::-1]
        if part is not None:
            near = near[part[near] != part[i]]
        near = near[label[near] != label[i]]
        while len(near):
            # one candidate of each component at a time: the rest may be linked by then
            first = np.sort(np.unique(label[near], return_index=True)[1])
            tried = near[first]
            for j in tried[bands.reaches(overlaps(sets[i], [sets[j] for j in tried]), len(sets[i]), sizes[tried])]:
                low, high = sorted((int(label[i]), int(label[j])))
                if low != high:
                    label[label == high] = low
                    edges.append((max(int(ids[i]), int(ids[j])), min(int(ids[i]), int(ids[j]))))
            near = np.delete(near, first)
            near = near[label[near] != label[i]]
    return edges, sizes


def overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the sets (none is empty) shares with `own`."""
    every = np.concatenate(others)
    hits = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
    return np.add.reduceat(hits.astype(np.int64), np.cumsum([0, *(len(x) for x in others[:-1])]))


def join(docs: DataFrame, k: int = 5, percent: int = 80, group_shingles: int = 4_000_000, batch_bytes: int = 12 << 20, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach."""
    c.ready(docs.sparkSession)
    gathered = profile(docs, k, sketch_bits).checkpoint()
    profiles = gathered.where("slice is null").select("doc_id", "n", "h1", "h2")
    known = profiles.where("n > 0 and doc_id is not null")
    classes = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n"), F.count("*").alias("copies")).checkpoint()
    member = known.join(classes.select("h1", "h2", "class_id"), ["h1", "h2"]).select("doc_id", "class_id")
    # a document whose rows are in several classes links them
    own = member.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("most")).checkpoint()
    several = member.join(own.where("class_id <> most").select("doc_id"), "doc_id", "left_semi")
    links = several.select(F.col("doc_id").alias("u"), F.col("class_id").alias("v"))
    if percent < 100:
        links = links.union(class_links(docs, k, Bands(percent), count_sketch(gathered, sketch_bits), classes, member.where("doc_id <> class_id").union(several).distinct(), group_shingles, c.spread(docs, "text", batch_bytes)).checkpoint())
        c.release(docs.sparkSession)
    groups = connected(links.select(F.lit(0).cast("long").alias("space"), "u", "v")).select(F.col("node").alias("class_id"), F.col("component").alias("linked"))
    found = own.join(groups, "class_id", "left").select("doc_id", F.coalesce("linked", "class_id").alias("component_id"))
    return profiles.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def class_links(docs: DataFrame, k: int, bands: Bands, counts: np.ndarray, classes: DataFrame, moved: DataFrame, group_shingles: int, shards: int) -> DataFrame:
    """(u, v): links between classes, enough to join what is linked.  moved: the
    classes of the documents that are not just their own."""
    # a pair comes from every shard where it has a fingerprint: each once from here on
    pairs = candidate_pairs(docs, k, bands, shards, shingle_order(docs, k, bands, shards, counts)).distinct().checkpoint()
    c.release(docs.sparkSession)  # the keys are by far the largest shuffle
    raised = lambda e, end: e.join(moved.withColumnRenamed("doc_id", end), end, "left").withColumn(end, F.coalesce("class_id", end)).drop("class_id")
    pairs = raised(raised(pairs, "u"), "v").select("space", "u", "v")
    # components of each band by itself: a set is in two bands at most, and sets
    # too unlike in size for a link don't gather in one component
    possible = connected(pairs).checkpoint()
    load = possible.join(classes.select(F.col("class_id").alias("node"), "n"), "node").groupBy("space", "component").agg(F.sum("n").alias("load"), F.min("n").alias("least"), F.count("*").alias("members")).checkpoint()
    # without a set of the lower band, the component is compared in its own band
    upper = F.element_at(F.array(*[F.lit(x) for x in bands.edges]), F.col("space").cast("int") + 2)
    dealt = with_load(possible, load).where(F.col("least") < upper).drop("least").withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("load") * 2 / group_shingles)).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # a chunk meets itself once and every other chunk once
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("node", "space", "component", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(dealt, "node")

    def verify(table: pa.Table) -> pa.Table:
        # once for each text of a document that has several
        rows: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for i, (node, x) in enumerate(zip(table.column("node").to_pylist(), shingle_sets(c.as_text(table.column("text")), k), strict=True)):
            if len(x):
                rows.setdefault((node, hash(x.tobytes())), (i, x))
        if not rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 2, names=["u", "v"])
        at = [i for i, _ in rows.values()]
        part = table.column("chunk").to_numpy()[at] if table.column("a")[0].as_py() != table.column("b")[0].as_py() else None
        edges, _ = links_within(np.array([node for node, _ in rows]), [x for _, x in rows.values()], bands, part)
        return pa.Table.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return texts.groupBy("space", "component", "a", "b").applyInArrow(verify, "u long, v long")


def with_load(possible: DataFrame, load: DataFrame) -> DataFrame:
    """possible with the load of its components.  Those that hold a `HOT_PARTS`-th
    of all rows or more are `HOT_PARTS` at most, whatever the input: they are
    broadcast, so that the shuffle deals no component with a larger part."""
    key = ["space", "component"]
    is_hot = F.col("members") * HOT_PARTS >= possible.count()
    hot, rest = load.where(is_hot).drop("members"), load.where(~is_hot).drop("members")
    return possible.join(F.broadcast(hot), key).union(possible.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component (the least doc_id); columns as they came.
    Documents without doc_id stay."""
    groups = join(docs, k, percent)
    gone = groups.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
