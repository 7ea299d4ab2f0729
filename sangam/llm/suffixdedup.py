"""Removal of long repeated byte strings with a logarithmic suffix-array index.

Texts are dealt by a hash of doc_id to batches of a few MB.  A batch's sparse
suffix array holds the suffixes at sampled places only: a place is sampled when
the hash of the `ANCHOR` bytes there is the least among the anchors of some
window of `length` bytes.  Equal windows hold the same sampled anchor, so no
match of `length` bytes is missed.

1. each batch sends the distinct anchors of its suffixes to their shard, which
   returns those found in two documents or more (most are found in one);
2. each batch sends the remaining suffixes, with the bytes around them that a
   window can reach, to the shard of the anchor (equal ones once a batch, with
   the least and largest document);
3. a shard keeps a logarithmic index family of sparse suffix arrays: suffixes
   sorted by the bytes behind the place, then by those before it, read backwards.
   It takes its suffixes in slices, in order of their least document.  Every
   slice gets its suffix array, is merge-scanned against the levels for matches
   of `length` bytes, and becomes a level itself; two levels of equal size merge
   into the next;
4. each batch marks the windows held by a smaller document, and cuts the bytes.

A match is read off common prefixes: of neighbours in the order of the bytes
behind (so far to the right) and in that of the bytes before (so far to the
left); a window that starts o bytes before the place is shared by the suffixes
that agree in o bytes before it and length - o behind it.  These are bytes, no
fingerprints.  As slices come in order of their least documents, the least
document of a window stands in the slice itself or in a level, and no earlier
slice has to be seen again.

A hot string costs a shard one entry a batch, however many documents hold it,
and a batch holds whole texts of about `batch_bytes`; the number of batches and
shards follows the input.  The dealt texts are one exchange, read three times.
Within a batch contexts are told apart by a 64-bit hash modulo a prime.

Defined cases: null and empty texts have no bytes and lose none; texts shorter
than `length` are kept whole; repeats within one document stay; of equal
documents the one with the least doc_id stays whole; rows with equal doc_id
count as one document each but never remove from each other; doc_id null is
treated as larger than all others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

ANCHOR = 24
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ANCHOR bytes at each place where they exist."""
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = np.ascontiguousarray(np.lib.stride_tricks.as_strided(data.view(np.uint8), (len(data) - 7, 8), (1, 1))).view(np.uint64)[:, 0]
    out = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        out ^= out >> np.uint64(31)
        out += word[k : k + n]
        out *= np.uint64(factor)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32)) | np.uint64(1 << 63)  # never 0


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` entries."""
    done = 1
    while done < width:
        by = min(done, width - done)
        x = pick(x[:-by], x[by:])
        done += by
    return x


def sampled_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sampled places, anchor hash at each place, least hash of each window;
    windows that cross a text have 0)."""
    h, reach = anchor_hashes(data), length - ANCHOR + 1
    if len(data) < length:
        return np.zeros(0, int), h, np.zeros(0, np.uint64)
    least = _slide(h, reach, np.minimum)
    valid = np.zeros(len(least) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    least[np.cumsum(valid[:-1]) == 0] = 0
    pad = np.zeros(reach - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), reach, np.maximum)  # over the windows that hold the place
    return np.flatnonzero((most == h) & (most > 0)), h, least


class Texts:
    """The texts of one batch in order of doc_id, and their sampled suffixes."""

    def __init__(self, table: pa.Table, length: int):
        ids = table.column("doc_id").combine_chunks().cast(pa.int64())
        order = pc.sort_indices(table.select(["doc_id"]), sort_keys=[("doc_id", "ascending")]) if len(table) else pa.array([], pa.uint64())
        self.null = pc.is_null(ids).take(order).to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, int(c.NO_DOC) - 1).take(order).to_numpy()
        self.text = c.as_text(table.column("text")).take(order)
        self.length = length

    def parts(self) -> Iterator[tuple]:
        for a, b, data, starts, ends in c.chunks(self.text):
            places, h, least = sampled_places(data, starts, ends, self.length)
            doc = a + np.searchsorted(starts, places, "right") - 1
            yield a, data, starts, ends, places, h[places], least, doc

    def contexts(self, a: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, anchors: np.ndarray, least: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sampled places: reach to the left, fingerprint of the bytes that
        its windows can reach, and the flags of the windows that it stands for
        (bit o: the window that starts o bytes before)."""
        reach = self.length - ANCHOR
        left = np.minimum(places - starts[doc - a], reach)
        stop = np.minimum(places + self.length, ends[doc - a])
        flags = np.zeros(len(places), np.uint64)
        for o in range(reach + 1):
            at = places - o
            own = (at >= 0) & (at < len(least))
            own[own] = least[at[own]] == anchors[own]
            flags |= own.astype(np.uint64) << np.uint64(o)
        mark = c.range_hash(c.prefix_hash(data), places - left, stop)
        return left, c.mix(mark + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + flags), flags


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_binary(x))


def _unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _blobs(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in table.column(name).to_pylist()]


def _group_ends(keys: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))


def anchors_of(length: int, shards: int):
    """Batch -> (shard, batch, distinct anchors, those in several documents)."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        texts = Texts(table, length)
        keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for *_, anchors, _, doc in texts.parts():
            keys.append(anchors)
            docs.append(doc)
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(keys, kind="stable")  # documents stay in order within a key
        keys, docs = keys[order], docs[order]
        last = _group_ends(keys) - 1 if len(keys) else np.zeros(0, int)
        first = np.concatenate([[0], last[:-1] + 1]).astype(int)[: len(last)]
        several = docs[first] != docs[last]
        keys = keys[first]
        shard = (keys % np.uint64(shards)).astype(np.int64)
        rows = []
        for k, own in _by_shard(shard):
            short = (keys[own] >> np.uint64(32)).astype(np.uint32)
            rows.append((k, batch, _binary(np.unique(short)), _binary(np.unique(short[several[own]]))))
        return _rows(rows, [("shard", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("several", pa.binary())])

    return run


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    ends = _group_ends(shard[order]) if len(shard) else []
    start = 0
    for end in ends:
        yield int(shard[order[start]]), order[start:end]
        start = end


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)], names=[n for n, _ in schema])


def shared_anchors(table: pa.Table) -> pa.Table:
    """Shard: for each batch, its anchors that stand in two documents or more."""
    keys, several = _blobs(table, "keys", np.uint32), _blobs(table, "several", np.uint32)
    every = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *several]))
    shard, rows = table.column("shard")[0].as_py(), []
    for batch, own in zip(table.column("batch").to_pylist(), keys, strict=True):
        kept = np.intersect1d(own, shared, assume_unique=True)
        if len(kept):
            rows.append((batch, shard, _binary(kept)))
    return _rows(rows, [("batch", pa.int64()), ("shard", pa.int64()), ("shared", pa.binary())])


def suffixes_of(length: int, shards: int):
    """Batch and its shared anchors -> (shard, batch, suffixes)."""
    reach = length - ANCHOR

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        schema = [("shard", pa.int64()), ("batch", pa.int64()), ("marks", pa.binary()), ("bytes", pa.binary()), ("flags", pa.binary()), ("first", pa.binary()), ("last", pa.binary())]
        if not len(table) or not len(found):
            return _rows([], schema)
        batch = table.column("batch")[0].as_py()
        wanted = np.sort(np.concatenate([x.astype(np.uint64) | np.uint64(s) << np.uint64(32) for s, x in zip(found.column("shard").to_pylist(), _blobs(found, "shared", np.uint32), strict=True)]))
        parts: list[tuple[np.ndarray, ...]] = []
        texts = Texts(table, length)
        for a, data, starts, ends, places, anchors, least, doc in texts.parts():
            shard = anchors % np.uint64(shards)
            key = anchors >> np.uint64(32) | shard << np.uint64(32)
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            own = wanted[at] == key
            places, anchors, doc, shard = places[own], anchors[own], doc[own], shard[own]
            left, marks, flags = texts.contexts(a, data, starts, ends, places, anchors, least, doc)
            _, one = np.unique(marks, return_index=True)  # within the part, documents are in order
            wide = np.zeros(len(data) + reach + length, np.uint8)
            wide[reach : reach + len(data)] = data
            cut = np.lib.stride_tricks.sliding_window_view(wide, reach + length)[places[one]]
            order = np.argsort(marks, kind="stable")
            last = doc[order][_group_ends(marks[order]) - 1] if len(marks) else doc
            parts.append((marks[one], cut, flags[one], texts.ids[doc[one]], texts.ids[last], shard[one].astype(np.int64)))
        marks, cut, flags, first, last, shard = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(marks, kind="stable")
        ends = _group_ends(marks[order]) if len(marks) else np.zeros(0, int)
        begins = np.concatenate([[0], ends[:-1]]).astype(int)[: len(ends)]
        one = order[begins]
        last = last[order][ends - 1] if len(ends) else last
        rows = []
        for k, own in _by_shard(shard[one]):
            pick = one[own]
            # texts of neighbours overlap, and pack well in order of place
            order = np.argsort(pick)
            pick, ends = pick[order], last[own[order]]
            rows.append((k, batch, _binary(marks[pick]), _packed(cut[pick]), _packed(flags[pick].astype(np.uint32)), _packed(first[pick]), _packed(ends)))
        return _rows(rows, schema)

    return run


class SuffixIndex:
    """Sorted suffix arrays of one shard, at most one of each size class: a new
    one is merged with one of its class, and the result with one of the next,
    so that n slices cost log n merges each.

    An array has rows of bytes (`length` behind the place, then those before it,
    last first), the flags of the windows that they stand for, and the least
    document of each."""

    def __init__(self, length: int):
        self.length, self.reach = length, length - ANCHOR
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @staticmethod
    def array(text: np.ndarray, flags: np.ndarray, docs: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """The suffix array of the rows, equal ones once; where each row is in it."""
        order = np.argsort(_as_strings(text), kind="stable")
        text, flags, docs = text[order], flags[order], docs[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]).any(axis=1) | (flags[1:] != flags[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        return (text[head], flags[head], np.minimum.reduceat(docs, head) if len(head) else docs), place

    def add(self, new: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        level = 0
        while level in self.levels:
            old = self.levels.pop(level)
            new, _ = self.array(*(np.concatenate(x) for x in zip(old, new, strict=True)))
            level += 1
        self.levels[level] = new

    def scan(self, new: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Least document that holds each window of the new array's rows, in it
        or in a level: one row a suffix, one column an offset (NO_DOC: no window)."""
        text = new[0]
        anchor = np.ones(len(text), bool)
        anchor[1:] = (text[1:, :ANCHOR] != text[:-1, :ANCHOR]).any(axis=1)
        ends = []
        for fill in (0, 255):
            bound = np.full((int(anchor.sum()), text.shape[1]), fill, np.uint8)
            bound[:, :ANCHOR] = text[anchor, :ANCHOR]
            ends.append(_as_strings(bound))
        parts = [new]
        for level in self.levels.values():  # the rows of a level that begin like one of ours
            have = _as_strings(level[0])
            low, high = np.searchsorted(have, ends[0], "left"), np.searchsorted(have, ends[1], "right")
            many = high - low
            pick = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            parts.append(tuple(x[pick] for x in level))
        (text, flags, docs), place = self.array(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        behind = _common_prefix(text[:, : self.length])
        before = np.ascontiguousarray(text[:, self.length :])
        by_left = np.argsort(_as_strings(before), kind="stable")
        ahead = _common_prefix(before[by_left])
        least = np.full((len(text), self.reach + 1), c.NO_DOC)
        left = np.empty(len(text), np.int64)
        for o in range(self.reach + 1):
            own = np.flatnonzero((flags >> np.uint32(o)) & np.uint32(1))
            if not len(own):
                continue
            right = np.cumsum(behind < self.length - o)
            left[by_left] = np.cumsum(ahead < o)
            key = right[own] << 32 | left[own]
            order = np.argsort(key)
            key = key[order]
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            first = np.minimum.reduceat(docs[own[order]], np.flatnonzero(new_key))
            least[own[order], o] = first[np.cumsum(new_key) - 1]
        return least[place[: len(new[0])]]


def _as_strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as values that compare bytewise."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0] if len(rows) else np.zeros(0, f"S{rows.shape[1]}")


def _common_prefix(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the one before it (-1: none before)."""
    differ = np.ones((len(rows), rows.shape[1] + 1), bool)
    np.not_equal(rows[1:], rows[:-1], out=differ[1:, :-1])
    out = differ.argmax(axis=1)
    out[:1] = -1
    return out


def scan_shard(length: int, slice_rows: int = 1 << 15):
    """Shard: its suffixes slice by slice through the index family -> (batch,
    marks, flags of windows, the smaller document that holds them)."""
    reach = length - ANCHOR
    kinds = (("marks", np.uint64, False), ("bytes", np.uint8, True), ("flags", np.uint32, True), ("first", np.int64, True), ("last", np.int64, True))

    def run(table: pa.Table) -> pa.Table:
        marks, block, flags, first, last = ([_unpacked(x, kind) if packed else np.frombuffer(x, kind) for x in table.column(name).to_pylist()] for name, kind, packed in kinds)
        source = np.repeat(np.arange(len(marks)), [len(x) for x in marks])
        marks, flags, first, last = (np.concatenate(x) for x in (marks, flags, first, last))
        block = np.concatenate(block).reshape(-1, reach + length)
        order = np.argsort(first, kind="stable")
        index, found = SuffixIndex(length), []
        for at in range(0, len(order), slice_rows):
            own = order[at : at + slice_rows]
            text = np.concatenate([block[own, reach:], block[own, reach - 1 :: -1]], axis=1)
            new, place = index.array(text, flags[own], first[own])
            least = index.scan(new)[place]
            index.add(new)
            least[least >= last[own, None]] = c.NO_DOC
            todo = np.flatnonzero((least < c.NO_DOC).any(axis=1))
            while len(todo):
                doc = least[todo].min(axis=1)
                same = least[todo] == doc[:, None]
                found.append((source[own[todo]], marks[own[todo]], (same << np.arange(reach + 1, dtype=np.int64)).sum(axis=1).astype(np.uint32), doc))
                least[todo] = np.where(same, c.NO_DOC, least[todo])
                todo = todo[(least[todo] < c.NO_DOC).any(axis=1)]
        rows = []
        if found:
            source, *columns = (np.concatenate(x) for x in zip(*found, strict=True))
            batches = table.column("batch").to_pylist()
            rows = [(batches[k], *(_binary(x[own]) for x in columns)) for k, own in _by_shard(source)]
        return _rows(rows, [("batch", pa.int64()), ("marks", pa.binary()), ("flags", pa.binary()), ("docs", pa.binary())])

    return run


def cut_texts(length: int, keep_text: bool):
    """Batch and what its shards found -> RESULT."""
    reach = length - ANCHOR

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table):
            return pa.Table.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        texts = Texts(table, length)
        marks, flags, docs = (np.concatenate([np.zeros(0, k), *_blobs(found, name, k)]) for name, k in (("marks", np.uint64), ("flags", np.uint32), ("docs", np.int64)))
        order = np.argsort(marks)
        marks, flags, docs = marks[order], flags[order], docs[order]
        n_bytes, removed, n_spans, digests, kept = [], [], [], [], []
        for a, data, starts, ends, places, anchors, least, doc in texts.parts():
            gone = np.zeros(len(data), bool)
            if len(marks) and len(places):
                _, own, _ = texts.contexts(a, data, starts, ends, places, anchors, least, doc)
                lo, hi = np.searchsorted(marks, own, "left"), np.searchsorted(marks, own, "right")
                n = hi - lo
                place = np.repeat(places, n)
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                smaller = docs[at] < np.repeat(texts.ids[doc], n)
                place, bits = place[smaller], flags[at[smaller]]
                begun = np.zeros(len(data) + 1, np.int32)
                for o in range(reach + 1):
                    begun[place[(bits >> np.uint32(o)) & np.uint32(1) == 1] - o] = 1
                total = np.concatenate([np.zeros(length, np.int64), np.cumsum(begun[:-1])])
                gone = total[length:] > total[:-length]
            keep = ~gone
            first, _ = c.spans(gone)
            text_spans = np.searchsorted(first, starts), np.searchsorted(first, ends)
            n_spans.append(text_spans[1] - text_spans[0])
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed.append(sums[ends] - sums[starts])
            n_bytes.append(ends - starts)
            for s, e, n in zip(starts, ends, removed[-1], strict=True):
                rest = data[s:e][keep[s:e]].tobytes() if n else data[s:e].tobytes()
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if keep_text else None)
        join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        ids = pa.array(texts.ids, pa.int64(), mask=texts.null)
        return pa.Table.from_arrays([ids, join(n_bytes), join(removed), join(n_spans), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, batch_bytes: int = 6 << 20, keep_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    and kept (the remaining bytes; they need not be whole characters)."""
    if not ANCHOR < length <= ANCHOR + 31:
        raise ValueError(f"length must be over {ANCHOR} and at most {ANCHOR + 31}")
    n = c.spread(docs, "text", batch_bytes)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = (
        dealt.groupBy("batch")
        .applyInArrow(anchors_of(length, n), "shard long, batch long, keys binary, several binary")
        .groupBy("shard")
        .applyInArrow(shared_anchors, "batch long, shard long, shared binary")
    )
    suffixes = dealt.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(suffixes_of(length, n), "shard long, batch long, marks binary, bytes binary, flags binary, first binary, last binary")
    found = suffixes.groupBy("shard").applyInArrow(scan_shard(length), "batch long, marks binary, flags binary, docs binary")
    return dealt.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(cut_texts(length, keep_text), RESULT)
